"""Error metrics, statistics, roll-ups and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorframe.functions.wrench import from_log, to_log
from sensorframe.operators import metrics, selection
from sensorframe.operators.ordered import DAY_NS, Series
from sensorframe.queries.registry import HOUR_NS, SAMPLES, ns, query, r6, samples, table

# Predictions: quantity times list price against the charged price, both in thousands.
_PRED = """WITH p AS (SELECT l_orderkey*10 + l_linenumber AS id, l_returnflag AS flag, l_linestatus AS status, l_shipdate, l_suppkey,
 l_extendedprice/1000.0 AS y, l_quantity*p_retailprice/1000.0 AS yhat FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_METRICS = """count(*) AS n, round(sqrt(avg((yhat-y)*(yhat-y))), 6)+0.0 AS rmse, round(avg(abs(yhat-y)), 6)+0.0 AS mae, round(avg(yhat-y), 6)+0.0 AS bias,
 round(corr(y, yhat), 6)+0.0 AS pearson_r, round(avg(y), 6)+0.0 AS y_mean, round(avg(yhat), 6)+0.0 AS yhat_mean,
 round(100*sqrt(avg(((yhat-y)/greatest(abs(y), 1e-6))*((yhat-y)/greatest(abs(y), 1e-6)))), 4)+0.0 AS rmspe_pct"""
_NAMES = ("rmse", "mae", "bias", "pearson_r", "y_mean", "yhat_mean", "rmspe_pct")


def _pred(spark, sf):
    li, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"), "l_shipdate", "l_suppkey", (F.col("l_extendedprice") / 1000.0).alias("y"),
        (F.col("l_quantity") * F.col("p_retailprice") / 1000.0).alias("yhat"),
    )


def _round(df, names=_NAMES):
    return df.select(*[
        (r6(c, 4 if c == "rmspe_pct" else 6).alias(c) if c in names else F.col(c)) for c in df.columns
    ])


@query("metric_block", f"{_PRED} SELECT flag, status, {_METRICS} FROM p GROUP BY flag, status")
def metric_block(spark, sf):
    return _round(metrics.metric_block(_pred(spark, sf), ["flag", "status"], "y", "yhat"))


_CUBE = f"""{_PRED}, long AS (SELECT flag, 'price' AS head, 'raw' AS mode, y, yhat, y <= 40 AS inside FROM p
 UNION ALL SELECT flag, 'price', 'clipped', least(y, 40), least(yhat, 40), y <= 40 FROM p
 UNION ALL SELECT flag, 'root', 'raw', sqrt(y), sqrt(yhat), sqrt(y) <= 5 FROM p
 UNION ALL SELECT flag, 'root', 'clipped', least(sqrt(y), 5), least(sqrt(yhat), 5), sqrt(y) <= 5 FROM p),
s AS (SELECT flag, mode, head, 'overall' AS split, y, yhat FROM long UNION ALL SELECT flag, mode, head, CASE WHEN inside THEN 'in' ELSE 'out' END, y, yhat FROM long)"""


def _cube(spark, sf):
    y, yh = F.col("y"), F.col("yhat")
    ry, ryh = F.sqrt("y"), F.sqrt("yhat")
    return metrics.metric_cube(
        _pred(spark, sf), ["flag"],
        {
            "price": {"limit": 40.0, "raw": (y, yh), "clipped": (F.least(y, F.lit(40.0)), F.least(yh, F.lit(40.0)))},
            "root": {"limit": 5.0, "raw": (ry, ryh), "clipped": (F.least(ry, F.lit(5.0)), F.least(ryh, F.lit(5.0)))},
        },
    )


@query("metric_cube", f"{_CUBE} SELECT flag, mode, head, split, n, rmse, mae, bias, y_mean, yhat_mean FROM (SELECT flag, mode, head, split, {_METRICS} FROM s GROUP BY ALL)")
def metric_cube(spark, sf):
    return _round(_cube(spark, sf)).drop("pearson_r", "rmspe_pct")


@query("weighted_merge", f"""{_CUBE}, b AS (SELECT flag, mode, head, split, count(*) AS n, sqrt(avg((yhat-y)*(yhat-y))) AS rmse, avg(abs(yhat-y)) AS mae FROM s GROUP BY ALL)
SELECT mode, head, split, CAST(sum(n) AS BIGINT) AS n, round(sum(n*rmse)/sum(n), 6)+0.0 AS rmse, round(sum(n*mae)/sum(n), 6)+0.0 AS mae FROM b GROUP BY ALL""")
def weighted_merge(spark, sf):
    out = metrics.weighted_merge(_cube(spark, sf), ["mode", "head", "split"], ["rmse", "mae"])
    return out.select("mode", "head", "split", "n", r6("rmse").alias("rmse"), r6("mae").alias("mae"))


def _steps_sql(name: str, source: str, column: str, keep: str) -> str:
    """One mixing as a chain of subqueries, each shift and product a step of its own."""
    out, at = [], source
    for i, (shift, times) in enumerate(metrics.MIX):
        out.append(f"{name}{i} AS (SELECT {keep}, (xor({column}, {column} >> {shift}) * {times}) & {metrics.WORD} AS {column} FROM {at})")
        at = f"{name}{i}"
    out.append(f"{name} AS (SELECT {keep}, xor({column}, {column} >> 15) AS {column} FROM {at})")
    return ", ".join(out)


_REPLICATES = 2000
_WEIGHT = " + ".join(f"CAST(x >= {t} AS INTEGER)" for t in metrics.poisson_steps())


@query("bootstrap_ci", f"""{_PRED}, e AS (SELECT flag, id, pow(yhat-y, 2) AS e FROM p),
r AS (SELECT flag, e, (id >> 32) & {metrics.WORD} AS high, id & {metrics.WORD} AS x FROM e), {_steps_sql('ra', 'r', 'x', 'flag, e, high')},
rb AS (SELECT flag, e, xor(x, high) AS x FROM ra), {_steps_sql('rc', 'rb', 'x', 'flag, e')},
t AS (SELECT b, (b * {metrics.SPREAD} + 1) & {metrics.WORD} AS x FROM range({_REPLICATES}) t(b)), {_steps_sql('ta', 't', 'x', 'b')},
m AS (SELECT rc.flag, rc.e, ta.b, (rc.x + ta.x) & {metrics.WORD} AS x FROM rc, ta), {_steps_sql('ma', 'm', 'x', 'flag, e, b')},
w AS (SELECT flag, e, b, {_WEIGHT} AS w FROM ma),
s AS (SELECT flag, b, sqrt(sum(w*e)/sum(w)) AS s FROM w GROUP BY flag, b),
c AS (SELECT flag, quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi FROM s GROUP BY flag),
z AS (SELECT flag, count(*) AS n, sqrt(avg(e)) AS rmse FROM e GROUP BY flag)
SELECT flag, n, round(rmse, 6)+0.0 AS rmse, round(lo, 6)+0.0 AS ci_low, round(hi, 6)+0.0 AS ci_high, round((hi-lo)/2, 6)+0.0 AS ci_halfwidth FROM z JOIN c USING (flag)""")
def bootstrap_ci(spark, sf):
    out = metrics.bootstrap_rmse(_pred(spark, sf), ["flag"], "id", "y", "yhat", _REPLICATES)
    return out.select("flag", "n", *[r6(c).alias(c) for c in ("rmse", "ci_low", "ci_high", "ci_halfwidth")])


@query("class_priors", """WITH o AS (SELECT lower(trim(o_orderpriority)) AS label, ln(1 + o_totalprice) AS v FROM orders)
SELECT label, round(avg(v), 6)+0.0 AS prior, count(*) AS n FROM o GROUP BY ROLLUP (label)""")
def class_priors(spark, sf):
    out = metrics.class_priors(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")
    return out.select("label", r6("prior").alias("prior"), "n")


@query("log_forces", f"""WITH {SAMPLES} SELECT event_id, round(ln(1 + value), 6)+0.0 AS logged, round(least(greatest(exp(value/20 - 1) - 1, 0), 80), 6)+0.0 AS force FROM samples""")
def log_forces(spark, sf):
    out = samples(spark, sf).select("event_id", to_log(F.col("value")).alias("logged"), from_log(F.col("value") / 20 - 1).alias("force"))
    return out.select("event_id", r6("logged").alias("logged"), r6("force").alias("force"))


@query("prior_lookup", """WITH o AS (SELECT lower(trim(o_orderpriority)) AS label, ln(1 + o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F'),
k AS (SELECT label, avg(v) AS p FROM o WHERE label <> '5-low' GROUP BY label), g AS (SELECT avg(v) AS g FROM o WHERE label <> '5-low')
SELECT o_orderkey, round(coalesce(p, g), 6)+0.0 AS prior FROM orders LEFT JOIN k ON k.label = lower(trim(o_orderpriority)), g""")
def prior_lookup(spark, sf):
    # Priors come from finished orders without one of the classes, so that class falls back to the mean.
    orders = table(spark, sf, "orders")
    priors = metrics.class_priors(orders.where("o_orderstatus = 'F' and o_orderpriority <> '5-LOW'"), "o_orderpriority", "o_totalprice")
    return metrics.prior_lookup(orders, priors, "o_orderpriority").select("o_orderkey", r6("prior").alias("prior"))


@query("stream_durations", f"""WITH {SAMPLES} SELECT topic, recorder, max(ts)-min(ts) AS duration_ns, round((max(ts)-min(ts))/1e9, 3)+0.0 AS seconds,
 round((max(ts)-min(ts))/1e9/60, 3)+0.0 AS minutes, round((max(ts)-min(ts))/1e9/3600, 3)+0.0 AS hours FROM samples GROUP BY topic, recorder""")
def stream_durations(spark, sf):
    out = metrics.stream_durations(samples(spark, sf), ["topic", "recorder"])
    return out.select("topic", "recorder", "duration_ns", *[r6(c, 3).alias(c) for c in ("seconds", "minutes", "hours")])


_DUR = f"""WITH {SAMPLES}, d AS (SELECT recorder % 4 AS location, recorder % 3 AS viewpoint, topic AS module, recorder, (max(ts)-min(ts))/1e9 AS s FROM samples GROUP BY 1, 2, 3, 4)"""


def _durations(spark, sf):
    rows = samples(spark, sf).select(
        (F.col("recorder") % 4).alias("location"), (F.col("recorder") % 3).cast("string").alias("viewpoint"),
        F.col("topic").alias("module"), "recorder", "ts",
    )
    return metrics.stream_durations(rows, ["location", "viewpoint", "module", "recorder"])


@query("duration_rollup", _DUR + """ SELECT location, CASE WHEN grouping(viewpoint)=0 THEN 'viewpoint' WHEN grouping(module)=0 THEN 'module' ELSE 'total' END AS level,
 coalesce(CAST(viewpoint AS VARCHAR), module, 'all') AS name, round(sum(s), 2)+0.0 AS seconds, count(*) AS streams
FROM d GROUP BY GROUPING SETS ((location), (location, viewpoint), (location, module))""")
def duration_rollup(spark, sf):
    out = metrics.duration_rollup(_durations(spark, sf), ["location"])
    return out.select("location", "level", "name", r6("seconds", 2).alias("seconds"), "streams")


@query("duration_columns", _DUR + """ SELECT location, round(coalesce(sum(s) FILTER (module='click'), 0), 2)+0.0 AS click, round(coalesce(sum(s) FILTER (module='view'), 0), 2)+0.0 AS view,
 0.0::DOUBLE AS wrench FROM d GROUP BY location""")
def duration_columns(spark, sf):
    roll = metrics.duration_rollup(_durations(spark, sf), ["location"])
    out = metrics.fixed_columns(roll, ["location"], "module", ["click", "view", "wrench"])
    return out.select("location", *[r6(c, 2).alias(c) for c in ("click", "view", "wrench")])


@query("hist_mode_scale", """WITH x AS (SELECT l_returnflag AS flag, l_extendedprice/l_quantity AS r FROM lineitem), q AS (SELECT flag, quantile_cont(r, 0.01) AS lo, quantile_cont(r, 0.99) AS hi FROM x GROUP BY flag),
b AS (SELECT x.flag, lo, hi, least(floor((r-lo)/((hi-lo)/200)), 199) AS bin FROM x JOIN q USING (flag) WHERE r BETWEEN lo AND hi),
c AS (SELECT flag, any_value(lo) AS lo, any_value(hi) AS hi, bin, count(*) AS c FROM b GROUP BY flag, bin),
k AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY c DESC, bin) AS r FROM c) SELECT flag, round(lo + (bin+0.5)*((hi-lo)/200), 4)+0.0 AS scale FROM k WHERE r = 1""")
def hist_mode_scale(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("r"))
    return metrics.histogram_mode(rows, ["flag"], F.col("r")).select("flag", r6("scale", 4).alias("scale"))


@query("frame_statistics", """WITH v AS (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT label, round(avg(v), 6)+0.0 AS mean, round(stddev_pop(v)/(avg(v)+1e-6), 2)+0.0 AS rel_std,
 round((quantile_cont(v, 0.95)-quantile_cont(v, 0.05))/(quantile_cont(v, 0.95)+1e-6), 6)+0.0 AS rel_range, round(max(v)-min(v), 6)+0.0 AS range
FROM (SELECT label, abs(v) AS v FROM v) GROUP BY label HAVING max(abs(v)) > 0""")
def frame_statistics(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", F.explode("embedding").alias("v")).select("label", F.abs(F.col("v").cast("double")).alias("v"))
    out = metrics.frame_statistics(rows, ["label"], "v")
    return out.select("label", r6("mean").alias("mean"), r6("rel_std", 2).alias("rel_std"), r6("rel_range").alias("rel_range"), r6("range").alias("range"))


@query("masked_features", """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT vec_id, round(coalesce(avg(v) FILTER (v > 0.2), 0), 6)+0.0 AS mean, round(coalesce(stddev_pop(v) FILTER (v > 0.2), 0), 6)+0.0 AS std,
 round(avg(CASE WHEN v > 0.2 THEN 1.0 ELSE 0.0 END), 6)+0.0 AS area FROM v GROUP BY vec_id""")
def masked_features(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.explode("embedding").alias("v"))
    rows = rows.select("vec_id", F.col("v").cast("double").alias("v"))
    out = metrics.masked_features(rows, ["vec_id"], "v", F.col("v") > 0.2)
    return out.select("vec_id", *[r6(c).alias(c) for c in ("mean", "std", "area")])


@query("robust_center", """WITH v AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)
SELECT label, """ + ", ".join(f"round((quantile_cont({a}, 0.05)+quantile_cont({a}, 0.95))/2, 6)+0.0 AS c{a}" for a in "xyz") + " FROM v GROUP BY label")
def robust_center(spark, sf):
    from sensorframe.operators.pointcloud import robust_center as center

    e = [F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")]
    out = center(table(spark, sf, "embeddings").select("label", *e), ["label"])
    return out.select("label", *[r6(f"c{a}").alias(f"c{a}") for a in "xyz"])


@query("normalize_by_max", "SELECT l_orderkey, l_linenumber, round(l_extendedprice/max(l_extendedprice) OVER (PARTITION BY l_suppkey), 6)+0.0 AS norm FROM lineitem")
def normalize_by_max(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    out = metrics.normalize_by_max(rows, ["l_suppkey"], "l_extendedprice", "norm")
    return out.select("l_orderkey", "l_linenumber", r6("norm").alias("norm"))


@query("scale_to_range", f"""WITH {SAMPLES} SELECT event_id, round((value-min(value) OVER w)/(max(value) OVER w-min(value) OVER w), 6)+0.0 AS scaled FROM samples WINDOW w AS (PARTITION BY topic)""")
def scale_to_range(spark, sf):
    return metrics.scale_to_range(samples(spark, sf), ["topic"], "value", "scaled").select("event_id", r6("scaled").alias("scaled"))


@query("keep_drop_counts", f"WITH {SAMPLES} SELECT topic, count(*) FILTER (value < 60) AS kept, count(*) FILTER (value >= 60) AS dropped FROM samples GROUP BY topic")
def keep_drop_counts(spark, sf):
    return metrics.keep_drop_counts(samples(spark, sf), ["topic"], F.col("value") < 60)


_CAND = """WITH c AS (SELECT p_brand AS rig, p_partkey AS candidate, p_size % 5 <> 0 AS success, p_retailprice % 97 AS acc_max, p_retailprice % 89 AS ang_acc_max,
 round(p_retailprice % 13, 4)/13 + 1 AS rms_t, p_retailprice % 11 AS rms_f, p_size AS win, p_partkey % 4 AS ord FROM part)"""


def _candidates(spark, sf):
    price, size, key = F.col("p_retailprice"), F.col("p_size"), F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("rig"), key.alias("candidate"), (size % 5 != 0).alias("success"), (size % 5 != 0).alias("valid"),
        (price % 97).alias("acc_max"), (price % 89).alias("ang_acc_max"), (F.round(price % 13, 4) / 13 + 1).alias("rms_t"),
        (price % 11).alias("rms_f"), size.alias("window"), (key % 4).alias("order"), ((size % 9 - 4) * 5.0).alias("offset_ms"),
        (key % 100).alias("n"), (key % 2 == 1).alias("gyro"),
    )


@query("best_smoothing", _CAND + """, p AS (SELECT *, bool_or(success) OVER (PARTITION BY rig) AS has FROM c), a AS (SELECT * FROM p WHERE success OR NOT has),
m AS (SELECT rig, quantile_cont(acc_max, 0.5) AS ma, quantile_cont(ang_acc_max, 0.5) AS mg FROM a GROUP BY rig),
s AS (SELECT a.*, acc_max <= 3*ma AND ang_acc_max <= 3*mg AS st FROM a JOIN m USING (rig)), h AS (SELECT *, bool_or(st) OVER (PARTITION BY rig) AS hs FROM s),
b AS (SELECT *, min(rms_t) OVER (PARTITION BY rig) AS low FROM h WHERE st OR NOT hs),
k AS (SELECT rig, candidate, row_number() OVER (PARTITION BY rig ORDER BY rms_t, rms_f, -win, ord, candidate) AS r FROM b WHERE rms_t <= 1.05*low) SELECT rig, candidate FROM k WHERE r = 1""")
def best_smoothing(spark, sf):
    return selection.best_smoothing(_candidates(spark, sf), ["rig"])


@query("best_time_offset", _CAND + """, o AS (SELECT c.*, (p_size % 9 - 4)*5.0 AS off, p_partkey % 100 AS n FROM c JOIN part ON p_partkey = candidate),
p AS (SELECT *, bool_or(success) OVER (PARTITION BY rig) AS has FROM o), b AS (SELECT *, min(rms_t) OVER (PARTITION BY rig) AS low FROM p WHERE success OR NOT has),
k AS (SELECT rig, candidate, row_number() OVER (PARTITION BY rig ORDER BY CASE WHEN abs(off) < 1e-12 THEN 0 ELSE 1 END, rms_t, abs(off), rms_f, -n, candidate) AS r FROM b WHERE rms_t <= low + 0.05)
SELECT rig, candidate FROM k WHERE r = 1""")
def best_time_offset(spark, sf):
    return selection.best_time_offset(_candidates(spark, sf), ["rig"], tolerance=0.05)


@query("best_gyro", _CAND + """, g AS (SELECT candidate // 2 AS pair, max(CASE WHEN candidate % 2 = 1 THEN candidate END) AS y, max(CASE WHEN candidate % 2 = 0 THEN candidate END) AS n,
 bool_or(success) FILTER (candidate % 2 = 1) AS vy, bool_or(success) FILTER (candidate % 2 = 0) AS vn, max(rms_t) FILTER (candidate % 2 = 1) AS ty, max(rms_t) FILTER (candidate % 2 = 0) AS tn,
 max(rms_f) FILTER (candidate % 2 = 1) AS fy, max(rms_f) FILTER (candidate % 2 = 0) AS fn FROM c GROUP BY 1)
SELECT pair, CASE WHEN vn AND NOT vy THEN n WHEN vy AND NOT vn THEN y WHEN NOT vy AND NOT vn THEN (CASE WHEN ty < tn OR (ty = tn AND fy < fn) THEN y ELSE n END)
 WHEN tn - ty > 1e-4 THEN y ELSE n END AS candidate FROM g""")
def best_gyro(spark, sf):
    rows = _candidates(spark, sf).withColumn("pair", F.floor(F.col("candidate") / 2))
    return selection.best_gyro(rows, ["pair"])


@query("merge_configs", """SELECT p_brand, p_size, arg_min(p_partkey, p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY p_brand, p_size""")
def merge_configs(spark, sf):
    rows = table(spark, sf, "part").select("p_brand", "p_size", "p_partkey", "p_name")
    return selection.merge_configs(rows, ["p_brand", "p_size"], "p_partkey")


@query("even_keyframes", f"""WITH {SAMPLES}, n AS (SELECT event_id, recorder, row_number() OVER (PARTITION BY recorder ORDER BY ts)-1 AS i, count(*) OVER (PARTITION BY recorder) AS n FROM samples)
SELECT event_id, recorder FROM n WHERE i % greatest(n//10, 1) = 0 OR i = n-1""")
def even_keyframes(spark, sf):
    ser = Series(["recorder"], cell_ns=30 * DAY_NS)
    return selection.even_keyframes(samples(spark, sf), ser, 10).select("event_id", "recorder")


@query("percentile_gate", """WITH g AS (SELECT l_linestatus AS s, quantile_cont(l_quantity, 0.1) AS a, quantile_cont(l_extendedprice, 0.5) AS b, quantile_cont(l_discount, 0.1) AS c FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber FROM lineitem JOIN g ON s = l_linestatus WHERE l_quantity >= a AND l_extendedprice >= b AND l_discount >= c""")
def percentile_gate(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount")
    out = selection.percentile_gate(rows, ["l_linestatus"], {"l_quantity": 0.1, "l_extendedprice": 0.5, "l_discount": 0.1})
    return out.select("l_orderkey", "l_linenumber")


def _fps_sql(k):
    dist = "list_distance(e.embedding::DOUBLE[], p.v::DOUBLE[])"
    steps = ["p0 AS (SELECT label, min(vec_id) AS id, 0 AS pick FROM embeddings GROUP BY label)", "q0 AS (SELECT p0.*, embedding AS v FROM p0 JOIN embeddings ON vec_id = id)"]
    for i in range(1, k):
        chosen = " UNION ALL ".join(f"SELECT label, id, v FROM q{j}" for j in range(i))
        steps.append(f"d{i} AS (SELECT e.label, e.vec_id, min({dist}) AS d FROM embeddings e JOIN ({chosen}) p ON p.label = e.label GROUP BY 1, 2)")
        steps.append(f"q{i} AS (SELECT x.label, x.id, {i} AS pick, embedding AS v FROM (SELECT label, arg_max(vec_id, (round(d, 9), -vec_id)) AS id FROM d{i} GROUP BY label) x JOIN embeddings ON vec_id = x.id)")
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT label, id AS vec_id, pick FROM q{j}" for j in range(k))


@query("farthest_points", _fps_sql(5))
def farthest_points(spark, sf):
    return selection.farthest_points(table(spark, sf, "embeddings"), ["label"], "vec_id", "embedding", 5)


@query("match_by_cue", """WITH t AS (SELECT l_suppkey AS site, l_orderkey % 40 AS cs, l_linenumber AS ce, l_partkey AS gt_id, l_orderkey*10+l_linenumber AS o FROM lineitem WHERE l_returnflag = 'R'),
g AS (SELECT site, cs, ce, arg_min(gt_id, (o, gt_id)) AS gt_id FROM t GROUP BY 1, 2, 3),
e AS (SELECT l_suppkey AS site, l_orderkey % 40 AS sf, l_linenumber AS ef, l_orderkey*10+l_linenumber AS o, l_partkey AS est FROM lineitem WHERE l_returnflag = 'A'),
h AS (SELECT e.site, gt_id, o, est, row_number() OVER (PARTITION BY e.site, gt_id ORDER BY o DESC, est DESC) AS r FROM e JOIN g ON g.site = e.site AND cs = sf AND ce = ef)
SELECT site, gt_id, o AS est_order, est FROM h WHERE r = 1""")
def match_by_cue(spark, sf):
    li = table(spark, sf, "lineitem")
    order = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), F.col("l_partkey").alias("p"))
    truth = li.where("l_returnflag = 'R'").select(
        F.col("l_suppkey").alias("site"), (F.col("l_orderkey") % 40).alias("cue_start"), F.col("l_linenumber").alias("cue_end"),
        F.col("l_partkey").alias("gt_id"), order.alias("gt_order"),
    )
    est = li.where("l_returnflag = 'A'").select(
        F.col("l_suppkey").alias("site"), (F.col("l_orderkey") % 40).alias("start_frame"), F.col("l_linenumber").alias("end_frame"),
        order.alias("est_order"), F.col("l_partkey").alias("est"),
    )
    out = selection.match_by_cue(est, truth, ["site"])
    return out.select("site", "gt_id", F.col("est_order.o").alias("est_order"), "est")


@query("quasi_static", """WITH v AS (SELECT l_suppkey AS rig, l_orderkey, l_linenumber, l_discount AS speed, l_tax*4 AS turn, l_quantity/50 AS acc, l_extendedprice/60000 AS ang FROM lineitem),
s AS (SELECT * FROM v WHERE speed <= 0.1 AND turn <= 0.2), h AS (SELECT *, bool_or(acc <= 0.5 AND ang <= 1.0) OVER (PARTITION BY rig) AS has FROM s)
SELECT l_orderkey, l_linenumber FROM h WHERE NOT has OR (acc <= 0.5 AND ang <= 1.0)""")
def quasi_static(spark, sf):
    li = table(spark, sf, "lineitem")
    out = selection.quasi_static(
        li, ["l_suppkey"], F.col("l_discount"), F.col("l_tax") * 4, F.col("l_quantity") / 50, F.col("l_extendedprice") / 60000
    )
    return out.select("l_orderkey", "l_linenumber")


@query("face_filter", """WITH f AS (SELECT l_orderkey, l_linenumber, l_quantity/800 AS area, l_discount*8 AS score FROM lineitem)
SELECT l_orderkey, l_linenumber FROM f WHERE score > CASE WHEN area < 0.005 THEN 0.7 WHEN area > 0.05 THEN 0.3 ELSE 0.7 - (0.7-0.3)*((area-0.005)/(0.05-0.005)) END""")
def face_filter(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("area", F.col("l_quantity") / 800).withColumn("score", F.col("l_discount") * 8)
    return rows.where(F.col("score") > selection.face_threshold(F.col("area"), 0.3, 0.7)).select("l_orderkey", "l_linenumber")


@query("anonymization_counts", f"WITH {SAMPLES} SELECT recorder, topic, count(*) AS images, count(*) FILTER (value > 100) AS flagged, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS faces FROM samples GROUP BY 1, 2")
def anonymization_counts(spark, sf):
    # A31 with the value as the face count of an image.
    return samples(spark, sf).groupBy("recorder", "topic").agg(
        F.count("*").alias("images"), F.count_if(F.col("value") > 100).alias("flagged"), F.sum(F.floor("value")).alias("faces")
    )


@query("valid_overlap", f"""WITH {SAMPLES}, e AS (SELECT recorder, min(ts) AS a, max(ts) AS b FROM samples WHERE topic = 'error' GROUP BY recorder)
SELECT event_id, coalesce(ts BETWEEN a AND b, false) AS valid FROM samples LEFT JOIN e USING (recorder)""")
def valid_overlap(spark, sf):
    from sensorframe.operators.relational import within_extent

    rows = samples(spark, sf)
    return within_extent(rows, rows.where("topic = 'error'"), ["recorder"]).select("event_id", "valid")


@query("motor_state_filter", f"WITH {SAMPLES} SELECT event_id FROM samples WHERE recorder/100.0 - 0.9 > radians(85.0+64.0-180.0) AND value/100 - 0.1 >= 0 AND abs(value*4 - 100) > 50")
def motor_state_filter(spark, sf):
    from sensorframe.operators.relational import loaded_motor

    v = F.col("value")
    rows = samples(spark, sf).select("event_id", (F.col("recorder") / 100.0 - 0.9).alias("position"), (v / 100 - 0.1).alias("velocity"), (v * 4 - 100).alias("effort"))
    return loaded_motor(rows).select("event_id")


@query("any_present", "WITH r AS (SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id FROM r WHERE quality IS NOT NULL OR toxic IS NOT NULL")
def any_present(spark, sf):
    from sensorframe.operators.relational import any_present as keep

    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return keep(rows, ["quality", "toxic"]).select("doc_id")


@query("key_sets", """WITH a AS (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1), b AS (SELECT source FROM documents JOIN labels USING (doc_id) WHERE quality = 0)
SELECT source, 'first' AS part FROM (SELECT source FROM a EXCEPT SELECT source FROM b) UNION ALL SELECT source, 'both' FROM (SELECT source FROM a INTERSECT SELECT source FROM b)""")
def key_sets(spark, sf):
    # U4 and U5 of the sources of two overlapping groups of documents.
    from sensorframe.operators.relational import in_both, only_in_first

    docs = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    a, b = docs.where("toxic = 1"), docs.where("quality = 0")
    return only_in_first(a, b, ["source"]).withColumn("part", F.lit("first")).unionByName(in_both(a, b, ["source"]).withColumn("part", F.lit("both")))


@query("time_range", f"WITH {SAMPLES}, s AS (SELECT *, ts - 1704067200000000000 AS rel FROM samples) SELECT event_id FROM s WHERE rel BETWEEN 864000000000000 AND 1728000000000000")
def time_range(spark, sf):
    from sensorframe.operators.relational import time_range as crop

    base = 1704067200000000000
    return crop(samples(spark, sf), base + 864000000000000, base + 1728000000000000).select("event_id")
