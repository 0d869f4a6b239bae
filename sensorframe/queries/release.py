"""Names, paths, messages and release plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorframe.functions import text
from sensorframe.plans import release
from sensorframe.queries.registry import query, r6, samples, table
from sensorframe.sources import catalog

# Stream paths: the page's own path below a recorder folder chosen by its number.
_FOLDERS = ("gripper/aria_human_1/aria_human", "wrist/aria_wrist", "gripper/aria_gripper", "umi/umi_gripper", "gripper/gripper/zedm", "hand/iphone_2", "x/gripper/zed_node", "y/wrench/imu", "z/zedm/depth", "spot/camera_depth", "spot/digit")
_PATH = "'root/' || ([" + ", ".join(f"'{f}'" for f in _FOLDERS) + "])[page_id % 11 + 1] || regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^https?://', '/')"


def _paths(spark, sf):
    folder = F.get(F.array(*[F.lit(f) for f in _FOLDERS]), (F.col("page_id") % 11).cast("int"))
    tail = F.regexp_replace(F.substring_index(F.substring_index("url", "?", 1), "#", 1), "^https?://", "/")
    return table(spark, sf, "pages").select("page_id", "url", F.concat(F.lit("root/"), folder, tail).alias("path"))


@query("path_classifier", f"""WITH p AS (SELECT page_id, lower({_PATH}) AS path FROM pages), s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS a FROM p)
SELECT page_id, CASE WHEN list_contains(a, 'aria_human') THEN 'ego' WHEN list_contains(a, 'aria_wrist') THEN 'wrist' WHEN list_contains(a, 'aria_gripper') OR list_contains(a, 'umi_gripper') THEN 'gripper'
 WHEN path LIKE '%/gripper/gripper/%' THEN 'gripper' WHEN path LIKE '%/iphone%' THEN 'third_person' WHEN (list_contains(a, 'zedm') OR list_contains(a, 'zed_node')) AND list_contains(a, 'gripper') THEN 'gripper' ELSE 'unknown' END AS viewpoint,
 CASE WHEN list_contains(a, 'wrench') THEN 'wrench' WHEN list_contains(a, 'imu') THEN 'imu' WHEN list_contains(a, 'joint_states') THEN 'joint_states' WHEN list_contains(a, 'telemetry') THEN 'telemetry' WHEN list_contains(a, 'digit') THEN 'haptics'
 WHEN list_contains(a, 'camera_depth') OR list_contains(a, 'depth_registered') THEN 'depth' WHEN list_contains(a, 'zedm') AND list_contains(a, 'depth') THEN 'depth' ELSE a[len(a)] END AS sensor FROM s""")
def path_classifier(spark, sf):
    rows = _paths(spark, sf)
    return rows.select("page_id", text.viewpoint(F.col("path"))["viewpoint"].alias("viewpoint"), text.sensor_module(F.col("path"), F.lit(False)).alias("sensor"))


_STEM = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[()]', ' ', 'g'), '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '^[._]+|[._]+$', '', 'g'))"


@query("archive_stems", f"SELECT page_id, {_STEM.format(x='url')} AS stem FROM pages")
def archive_stems(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.archive_stem(F.col("url"), False).alias("stem"))


@query("stem_collisions", """WITH d AS (SELECT doc_id, lang AS location, source || ' (' || doc_id || ')' AS name, source AS clean, source || '_' || doc_id AS raw FROM documents),
c AS (SELECT *, count(*) OVER (PARTITION BY location, clean) AS n FROM d) SELECT doc_id, CASE WHEN n = 1 THEN clean ELSE raw END AS output_stem FROM c""")
def stem_collisions(spark, sf):
    # Folder names with a trailing remark; the remark tells same-named folders apart again.
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("location"), F.concat("source", F.lit(" ("), F.col("doc_id").cast("string"), F.lit(")")).alias("name"))
    return release.resolve_stems(docs, ["location"]).select("doc_id", "output_stem")


@query("stem_numbering", """WITH d AS (SELECT doc_id, lang AS location, source || ' (' || repeat('x', CAST(doc_id % 3 AS INT)) || ')' AS name FROM documents), r AS (SELECT *, split_part(name, ' ', 1) AS clean, regexp_replace(replace(replace(name, ' (', '_'), ')', ''), '_$', '') AS raw FROM d),
c AS (SELECT *, count(*) OVER (PARTITION BY location, clean) AS n FROM r), w AS (SELECT *, CASE WHEN n = 1 THEN clean ELSE raw END AS want FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY location, want ORDER BY lower(name), name) AS i FROM w)
SELECT location, CASE WHEN i = 1 THEN want ELSE want || '_' || i END AS output_stem, count(*) AS n FROM k GROUP BY 1, 2""")
def stem_numbering(spark, sf):
    name = F.concat("source", F.lit(" ("), F.expr("repeat('x', cast(doc_id % 3 as int))"), F.lit(")"))
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("location"), name.alias("name"))
    return release.resolve_stems(docs, ["location"]).groupBy("location", "output_stem").agg(F.count("*").alias("n"))


@query("module_diff", """WITH s AS (SELECT DISTINCT lang AS location, source AS module FROM documents), w AS (SELECT location, unnest(['src0','src1','src99','gripper']) AS module FROM (SELECT DISTINCT location FROM s))
SELECT *, 'missing' AS status FROM (SELECT * FROM w EXCEPT SELECT * FROM s) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM s EXCEPT SELECT * FROM w)""")
def module_diff(spark, sf):
    seen = table(spark, sf, "documents").select(F.col("lang").alias("location"), F.col("source").alias("module"))
    return release.module_difference(seen, ["location"], ("src0", "src1", "src99", "gripper"))


@query("message_flatten", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k, value AS sample_value, event_type AS sample_topic FROM events""")
def message_flatten(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", F.from_json("props", "k BIGINT").alias("props"), F.struct("value", F.col("event_type").alias("topic")).alias("sample")
    )
    return text.flatten(rows)


@query("message_text", """SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, vec_id AS sec, label::BIGINT AS nanosec FROM embeddings""")
def message_text(spark, sf):
    e = [F.col("embedding")[i].cast("double") for i in range(3)]
    # Messages are printed from the table and parsed back.
    printed = F.concat(F.lit("geometry_msgs__msg__Vector3(x="), e[0].cast("string"), F.lit(", y="), e[1].cast("string"), F.lit(", z="), e[2].cast("string"), F.lit(", __msgtype__='geometry_msgs/msg/Vector3')"))
    stamp = F.concat(F.lit("builtin_interfaces__msg__Time(sec="), F.col("vec_id").cast("string"), F.lit(", nanosec="), F.col("label").cast("string"), F.lit(", __msgtype__='builtin_interfaces/msg/Time')"))
    rows = table(spark, sf, "embeddings").select("vec_id", text.message(printed, "Vector3").alias("v"), text.message(stamp, "Time").alias("t"))
    return rows.select("vec_id", "v.x", "v.y", "v.z", "t.sec", "t.nanosec")


@query("float_lists", "SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5)+0.0 AS total FROM embeddings")
def float_lists(spark, sf):
    printed = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), ", "), F.lit("]"))
    rows = table(spark, sf, "embeddings").select("vec_id", text.float_list(printed).alias("a"))
    return rows.select("vec_id", F.size("a").cast("bigint").alias("n"), r6(F.aggregate("a", F.lit(0.0), lambda x, y: x + y), 5).alias("total"))


@query("human_sizes", """WITH s AS (SELECT o_orderkey, CAST(round(o_totalprice*o_custkey) AS BIGINT) AS b, CAST(round(o_totalprice/10) AS BIGINT) AS sec FROM orders)
SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1024**2 THEN printf('%.1f KiB', b/1024.0) WHEN b < 1024**3 THEN printf('%.1f MiB', b/1024.0**2) ELSE printf('%.1f GiB', b/1024.0**3) END AS size,
 CASE WHEN sec >= 3600 THEN (sec//3600) || 'h ' || (sec//60%60) || 'm ' || (sec%60) || 's' WHEN sec >= 60 THEN (sec//60) || 'm ' || (sec%60) || 's' ELSE sec || 's' END AS took FROM s""")
def human_sizes(spark, sf):
    size, sec = F.round(F.col("o_totalprice") * F.col("o_custkey")).cast("bigint"), F.round(F.col("o_totalprice") / 10).cast("bigint")
    return table(spark, sf, "orders").select("o_orderkey", text.human_size(size).alias("size"), text.human_duration(sec.cast("double")).alias("took"))


@query("index_parse", r"""WITH n AS (SELECT s_suppkey, 'kitchen_' || s_nationkey || 'p_' || (CASE WHEN s_suppkey % 3 = 0 THEN 'x' ELSE (s_suppkey % 9) || '-' || (s_suppkey % 5) END) || '_take.vrs' AS name FROM supplier)
SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey % 9) || '-' || (s_suppkey % 5) END AS idx, s_suppkey % 3 <> 0 AS named, coalesce(s_suppkey % 3 <> 0 AND (s_suppkey % 9 = 4 OR s_suppkey % 5 = 4), false) AS has4 FROM n""")
def index_parse(spark, sf):
    k = F.col("s_suppkey")
    idx = F.when(k % 3 == 0, "x").otherwise(F.concat((k % 9).cast("string"), F.lit("-"), (k % 5).cast("string")))
    name = F.concat(F.lit("kitchen_"), F.col("s_nationkey").cast("string"), F.lit("p_"), idx, F.lit("_take.vrs"))
    rows = table(spark, sf, "supplier").select("s_suppkey", name.alias("name")).withColumn("idx", text.interaction_index(F.col("name")))
    return rows.select("s_suppkey", "idx", text.is_recording_name(F.col("name")).alias("named"), F.coalesce(text.index_contains(F.col("idx"), "4"), F.lit(False)).alias("has4"))


@query("config_keys", """SELECT p_partkey, substr(sha1('{"brand":"' || p_brand || '","size":' || p_size || '}'), 1, 16) AS key FROM part""")
def config_keys(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.config_key(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("key"))


def _tree(spark, sf):
    """Listing derived from parts: ten locations, modules by type, streams by name, with files and folders."""
    part = table(spark, sf, "part")
    loc = F.concat(F.lit("loc_"), (F.col("p_partkey") % 10).cast("string"))
    mod = F.get(F.array(*[F.lit(m) for m in release.EXPECTED_MODULES]), (F.col("p_size") % 5).cast("int"))
    stream = F.translate("p_name", " ", "_")
    file = F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 7 == 0, ".json").otherwise(".png"))
    path = F.when(F.col("p_size") % 3 == 0, F.concat_ws("/", mod, stream, file)).when(F.col("p_size") % 3 == 1, F.concat_ws("/", mod, stream, F.lower("p_type"), file)).otherwise(
        F.concat_ws("/", mod, stream, F.lower("p_type"), F.lower(F.regexp_replace("p_brand", "#", "_")), file)
    )
    files = part.select(loc.alias("location"), path.alias("path"), (F.col("p_retailprice") * 10).cast("bigint").alias("size"), F.lit(False).alias("is_dir"), F.lit(False).alias("is_symlink"))
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    dirs = files.select("location", F.explode(up).alias("path")).distinct().select("location", "path", F.lit(0).cast("bigint").alias("size"), F.lit(True).alias("is_dir"), F.lit(False).alias("is_symlink"))
    return files.unionByName(dirs)


@query("release_plan")
def release_plan(spark, sf):
    return release.plan(_tree(spark, sf))


@query("release_manifest")
def release_manifest(spark, sf):
    from sensorframe.session import stage
    from sensorframe.sources.sinks import manifest_rows

    files = stage(_tree(spark, sf))
    return manifest_rows(release.artifacts(stage(release.plan(files)), files))


# Recorder folders of five locations and which of them are known.
_TAKES = """r AS (SELECT 'loc_' || (page_id % 5) AS location, (['gripper','hand','umi','spot','wrist'])[page_id % 5 + 1] AS interaction, (['aria_human_1','iphone_2','umi_gripper','spot','gripper','aria_wrist'])[page_id % 6 + 1] AS recorder, (page_id % 4) || '-' || (page_id % 3) AS idx FROM pages),
k AS (SELECT * FROM r WHERE (interaction IN ('gripper','hand','umi','spot','wrist') AND recorder LIKE 'iphone_%') OR (interaction, recorder) IN (('gripper','gripper'),('hand','gripper'),('wrist','gripper'),('spot','spot'),('umi','umi_gripper'),('wrist','aria_wrist')))"""


def _takes(spark, sf):
    def pick(mod, *names):
        return F.get(F.array(*[F.lit(n) for n in names]), (F.col("page_id") % mod).cast("int"))

    name = F.concat(F.lit("kitchen_1_"), (F.col("page_id") % 4).cast("string"), F.lit("-"), (F.col("page_id") % 3).cast("string"), F.lit("_take.vrs"))
    files = table(spark, sf, "pages").select(F.concat_ws(
        "/", F.lit("/data"), F.concat(F.lit("loc_"), (F.col("page_id") % 5).cast("string")), pick(5, "gripper", "hand", "umi", "spot", "wrist"),
        pick(6, "aria_human_1", "iphone_2", "umi_gripper", "spot", "gripper", "aria_wrist"), name,
    ).alias("path"))
    return catalog.with_levels(files, "/data")


@query("catalog_query", f"WITH {_TAKES} SELECT DISTINCT location, interaction, recorder, idx AS interaction_index FROM k WHERE idx = '1' OR idx LIKE '1%'")
def catalog_query(spark, sf):
    cat = catalog.catalog(_takes(spark, sf))
    return catalog.query_catalog(cat, index="1").select("location", "interaction", "recorder", "interaction_index")


@query("container_files", f"WITH {_TAKES} SELECT DISTINCT '/data/' || location || '/' || interaction || '/' || recorder || '/kitchen_1_' || idx || '_take.vrs' AS path FROM k")
def container_files(spark, sf):
    files = _takes(spark, sf)
    return catalog.container_files(files, catalog.recorders(files))


@query("dataset_statistics", f"""WITH p AS (SELECT 'loc_' || (event_id % 3) AS location, (['aria_human','aria_wrist','iphone_1','gripper/gripper'])[event_id % 4 + 1] AS f, epoch_us(ts)*1000 AS ts FROM events),
d AS (SELECT location, f, (max(ts)-min(ts))/1e9 AS s FROM p GROUP BY 1, 2), v AS (SELECT *, CASE f WHEN 'aria_human' THEN 'ego' WHEN 'aria_wrist' THEN 'wrist' WHEN 'iphone_1' THEN 'third_person' ELSE 'gripper' END AS view, CASE f WHEN 'iphone_1' THEN 'iphone' ELSE f END AS module FROM d)
SELECT location, CASE WHEN grouping(view)=0 THEN 'viewpoint' WHEN grouping(module)=0 THEN 'module' ELSE 'total' END AS level, coalesce(view, module, 'all') AS name, round(sum(s), 2)+0.0 AS seconds FROM v GROUP BY GROUPING SETS ((location), (location, view), (location, module))""")
def dataset_statistics(spark, sf):
    from sensorframe.plans.evaluation import dataset_statistics as stats

    folder = F.get(F.array(*[F.lit(f) for f in ("aria_human", "aria_wrist", "iphone_1", "gripper/gripper")]), (F.col("event_id") % 4).cast("int"))
    files = samples(spark, sf).select(F.concat(F.lit("/data/loc_"), (F.col("event_id") % 3).cast("string"), F.lit("/x/"), folder, F.lit("/camera_rgb/"), F.col("ts").cast("string"), F.lit(".png")).alias("path"))
    out = stats(catalog.with_levels(files, "/data"))
    return out.select("location", "level", "name", r6("seconds", 2).alias("seconds"))


@query("articulation_matches", """WITH f AS (SELECT epoch_us(ts)*1000 AS ts, row_number() OVER (ORDER BY ts)-1 AS i FROM events WHERE event_type='view'), t AS (SELECT event_id AS gt_id, epoch_us(ts)*1000 AS s, epoch_us(ts)*1000 + 7200000000000 AS e FROM events WHERE event_type='purchase'),
a AS (SELECT t.*, b.i AS sb, b.ts AS st, c.i AS sc, c.ts AS sct FROM t ASOF LEFT JOIN f b ON t.s >= b.ts ASOF LEFT JOIN f c ON t.s <= c.ts), b AS (SELECT a.*, b.i AS eb, b.ts AS ebt, c.i AS ec, c.ts AS ect FROM a ASOF LEFT JOIN f b ON a.e >= b.ts ASOF LEFT JOIN f c ON a.e <= c.ts),
c AS (SELECT gt_id, CASE WHEN sct IS NULL OR s-st <= sct-s THEN sb ELSE sc END//2 AS cs, CASE WHEN ect IS NULL OR e-ebt <= ect-e THEN eb ELSE ec END//2 AS ce FROM b),
g AS (SELECT cs, ce, min(gt_id) AS gt_id FROM c GROUP BY 1, 2), x AS (SELECT event_id AS est, cs AS sf, ce AS ef FROM c JOIN events ON event_id = gt_id)
SELECT gt_id, max(est) AS est FROM x JOIN g ON cs = sf AND ce = ef GROUP BY gt_id""")
def articulation_matches(spark, sf):
    # Estimates take the frame ranges of the truth windows, so that windows of equal frames compete.
    from sensorframe.plans.evaluation import articulation_matches as match, cue_frames
    from sensorframe.queries.registry import RIG, rig, topic
    from sensorframe.session import stage

    frames = rig(topic(spark, sf, "view")).select("rig", "ts")
    truth = rig(topic(spark, sf, "purchase")).select(
        "rig", F.col("event_id").alias("gt_order"), F.col("event_id").alias("gt_id"), F.col("ts").alias("start_ns"), (F.col("ts") + F.lit(7_200_000_000_000)).alias("end_ns")
    )
    est = stage(cue_frames(truth, frames, RIG, 2)).select(
        "rig", F.col("gt_id").alias("est_order"), F.col("gt_id").alias("est"), F.col("cue_start").alias("start_frame"), F.col("cue_end").alias("end_frame")
    )
    return match(est, truth, frames, RIG, 2).select("gt_id", "est")
