"""Row, column and time functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorframe.functions import geometry as g
from sensorframe.functions import text, timecols, wrench
from sensorframe.operators import relational as rel
from sensorframe.plans.release import artifact_summary
from sensorframe.queries.geometry import _E, _axes, _out, _vec
from sensorframe.queries.registry import SAMPLES, query, r6, samples, table

# A time inside the tables, for a clock that starts in between.
_EPOCH = 1_705_000_000_000_000_000


@query("non_negative_time", f"WITH {SAMPLES} SELECT event_id, ts - {_EPOCH} AS t FROM samples WHERE ts - {_EPOCH} >= 0")
def non_negative_time(spark, sf):
    return rel.non_negative(samples(spark, sf).select("event_id", (F.col("ts") - F.lit(_EPOCH)).alias("t")), "t")


@query("confident_rows", f"WITH {SAMPLES} SELECT event_id, topic FROM samples WHERE value / 100.0 > 0.99")
def confident_rows(spark, sf):
    rows = samples(spark, sf).withColumn("right_tracking_confidence", F.col("value") / 100.0)
    return rel.confident(rows).select("event_id", "topic")


@query("fill_or_drop", f"""WITH {SAMPLES}, r AS (SELECT event_id, CASE WHEN value > 100 THEN NULL ELSE value END AS a, CASE WHEN topic = 'error' THEN NULL ELSE value END AS b FROM samples)
SELECT event_id, coalesce(a, -1.0) AS a, b FROM r WHERE b IS NOT NULL""")
def fill_or_drop(spark, sf):
    # Missing values come as NaN in one column and as null in the other.
    rows = samples(spark, sf).select(
        "event_id", F.when(F.col("value") > 100, float("nan")).otherwise(F.col("value")).alias("a"), F.when(F.col("topic") != "error", F.col("value")).alias("b")
    )
    return rel.fill_or_drop(rows, {"a": -1.0}, ["b"])


@query("rename_columns", "SELECT l_orderkey AS recording, l_linenumber AS row, l_quantity AS fx FROM lineitem")
def rename_columns(spark, sf):
    rows = rel.drop_matching(table(spark, sf, "lineitem"), "l_(.*date|.*flag|.*status|extendedprice)")
    return rel.rename_select(rows, {"l_orderkey": "recording", "l_linenumber": "row", "l_quantity": "fx"})


@query("cut_topics", f"WITH {SAMPLES} SELECT event_id, topic FROM samples WHERE topic IN ('click', 'view') AND ts BETWEEN {_EPOCH} AND {_EPOCH + 10 * 86_400_000_000_000}")
def cut_topics(spark, sf):
    rows = samples(spark, sf)
    both = rel.cut_topics({t: rows.where(F.col("topic") == t) for t in ("click", "view")}, (_EPOCH, _EPOCH + 10 * 86_400_000_000_000))
    return both["click"].unionByName(both["view"]).select("event_id", "topic")


@query("row_at", f"WITH {SAMPLES} SELECT DISTINCT ts FROM samples WHERE ts = (SELECT max(ts) FROM samples)")
def row_at(spark, sf):
    rows = samples(spark, sf)
    last = rows.agg(F.max("ts")).first()[0]
    return rel.row_at(rows, last, must=True).select("ts")


@query("suffix_numbers", r"SELECT c_name, TRY_CAST(nullif(regexp_extract(c_name, '(\d+)$', 1), '') AS BIGINT) AS number FROM customer UNION ALL SELECT p_name, TRY_CAST(nullif(regexp_extract(p_name, '(\d+)$', 1), '') AS BIGINT) FROM part")
def suffix_numbers(spark, sf):
    names = table(spark, sf, "customer").select("c_name").union(table(spark, sf, "part").select("p_name"))
    return names.select("c_name", rel.suffix_number(F.col("c_name")).alias("number"))


@query("files_by_extension", r"WITH f AS (SELECT page_id, regexp_replace(url, '[?#].*', '') AS name FROM pages) SELECT page_id, name FROM f WHERE lower(regexp_extract(name, '\.([^.]+)$', 1)) IN ('html', 'net/')")
def files_by_extension(spark, sf):
    files = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "[?#].*", "").alias("name"))
    return rel.with_extensions(files, ("html", "net/"))


@query("header_times", f"""WITH {SAMPLES}, h AS (SELECT event_id, ts, value, CASE WHEN topic = 'view' THEN NULL ELSE ts // 1000000000 END AS s, ts % 1000000000 AS n FROM samples),
t AS (SELECT event_id, value, coalesce(s * 1000000000 + n, ts - 1) AS ts FROM h)
SELECT event_id, ts AS stamp, ts + CAST(trunc((value - 100.0) * 1e9) AS BIGINT) AS shifted, least(ts, {_EPOCH}) AS win_start, greatest(ts, {_EPOCH}) AS win_end FROM t""")
def header_times(spark, sf):
    second = F.lit(1_000_000_000).cast("bigint")
    rows = samples(spark, sf)
    stamp = timecols.header_ns(F.when(F.col("topic") != "view", F.expr("ts div 1000000000")), F.col("ts") % second, F.col("ts") - 1)
    rows = rows.select("event_id", "value", stamp.alias("stamp"))
    start, end = timecols.ordered_window(F.col("stamp"), F.lit(_EPOCH))
    return rows.select("event_id", "stamp", timecols.shift_imu(F.col("stamp"), F.col("value") - 100.0).alias("shifted"), start.alias("win_start"), end.alias("win_end"))


@query("text_values", r"""SELECT event_id, coalesce(json_extract_string(props, '$.none'), json_extract_string(props, '$.k')) AS k, coalesce(TRY_CAST(event_type AS DOUBLE), 0.0) AS zero,
coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS number, CAST(event_id % 1000 AS DOUBLE) AS first, CASE WHEN value > 150 THEN 0.0 ELSE value END AS kept FROM events""")
def text_values(spark, sf):
    k = text.first_present(F.col("props"), ["none", "k"])
    listed = F.concat(F.lit("[ "), (F.col("event_id") % 1000).cast("string"), F.lit(", 7]"))
    return table(spark, sf, "events").select(
        "event_id", k.alias("k"), text.coerced(F.col("event_type")).alias("zero"), text.coerced(k).alias("number"), wrench.first_of_list(listed).alias("first"),
        wrench.drop_outlier(F.col("value"), 150.0).alias("kept"),
    )


@query("depth_pixels", "SELECT l_orderkey, l_linenumber, round(l_quantity * (256.0 / 1920), 6)+0.0 AS u, round(l_discount * 1000 * (192.0 / 1440), 6)+0.0 AS v FROM lineitem")
def depth_pixels(spark, sf):
    u, v = g.scale_pixel(F.col("l_quantity"), F.col("l_discount") * 1000, (1920, 1440), (256, 192))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(u).alias("u"), r6(v).alias("v"))


@query("turn_rates", "SELECT vec_id, round(radians(embedding[11]::DOUBLE * 100), 6)+0.0 AS wx, round(radians(embedding[12]::DOUBLE * 100), 6)+0.0 AS wy, round(radians(embedding[13]::DOUBLE * 100), 6)+0.0 AS wz FROM embeddings")
def turn_rates(spark, sf):
    degrees = [F.col(c) * 100 for c in ("wx", "wy", "wz")]
    return _out(_vec(spark, sf), ["vec_id"], dict(zip(("wx", "wy", "wz"), g.to_radians(degrees))))


@query("world_wrench", f"""{_E}, f AS (SELECT vec_id, px, py, pz, m0*vx+m1*vy+m2*vz AS fx, m3*vx+m4*vy+m5*vz AS fy, m6*vx+m7*vy+m8*vz AS fz, m0*wx+m1*wy+m2*wz AS a, m3*wx+m4*wy+m5*wz AS b, m6*wx+m7*wy+m8*wz AS c FROM m)
SELECT vec_id, round(fx, 6)+0.0 AS fx, round(fy, 6)+0.0 AS fy, round(fz, 6)+0.0 AS fz, round(a + py*fz - pz*fy, 6)+0.0 AS tx, round(b + pz*fx - px*fz, 6)+0.0 AS ty, round(c + px*fy - py*fx, 6)+0.0 AS tz FROM f""")
def world_wrench(spark, sf):
    P, Q, V, W = _axes()
    force, torque = wrench.world_wrench(g.quat_to_matrix(Q), V, W, P)
    return _out(_vec(spark, sf), ["vec_id"], dict(zip(("fx", "fy", "fz", "tx", "ty", "tz"), [*force, *torque])))


@query("moved_wrench", f"""{_E} SELECT vec_id, round(wx + py*vz - pz*vy, 6)+0.0 AS tx, round(wy + pz*vx - px*vz, 6)+0.0 AS ty, round(wz + px*vy - py*vx, 6)+0.0 AS tz FROM m""")
def moved_wrench(spark, sf):
    P, _, V, W = _axes()
    return _out(_vec(spark, sf), ["vec_id"], dict(zip(("tx", "ty", "tz"), g.move_wrench(V, W, P))))


@query("artifact_totals", "SELECT source, lang AS artifact_type, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY source, lang")
def artifact_totals(spark, sf):
    items = table(spark, sf, "documents").select("source", F.col("lang").alias("artifact_type"), F.col("n_chars").alias("size_bytes"))
    return artifact_summary(items, ["source"])
