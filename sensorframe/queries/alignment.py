"""Clock offsets, shared windows and interaction splitting over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorframe.functions import timecols
from sensorframe.operators import intervals, offsets
from sensorframe.operators.ordered import DAY_NS, Series
from sensorframe.plans import alignment
from sensorframe.queries.registry import HOUR_NS, MIN_NS, SAMPLES, ns, query, r6, rig, samples, table
from sensorframe.session import stage

# Detections: every sample shows the clock of its minute; device clocks are off by the module number in seconds.
_DET = f"""WITH {SAMPLES}, det AS (SELECT recorder % 20 AS module, ts - (recorder % 20)*1000000000 - CAST(round(value*100) AS BIGINT)*1000 AS device_ts,
 ts - ts % {MIN_NS} AS qr_ts FROM samples),
pairs AS (SELECT module, qr_ts, CAST(trunc(min(device_ts) + 0.0) AS BIGINT)*0 + min(device_ts) + CAST(floor(quantile_cont(device_ts - b, 0.5)) AS BIGINT) AS device_ts
 FROM (SELECT *, min(device_ts) OVER (PARTITION BY module, qr_ts) AS b FROM det) GROUP BY module, qr_ts)"""
_ROBUST = """, o AS (SELECT module, qr_ts - device_ts AS off FROM pairs), m AS (SELECT module, count(*) AS n_pairs, CAST(trunc(quantile_cont(off, 0.5)) AS BIGINT) AS med FROM o GROUP BY module),
d AS (SELECT o.module, off, abs(off - med) AS dev FROM o JOIN m USING (module)), q AS (SELECT module, CAST(trunc(quantile_cont(dev, 0.5)) AS BIGINT) AS mad FROM d GROUP BY module),
i AS (SELECT d.module, CAST(trunc(quantile_cont(off, 0.5)) AS BIGINT) AS fine FROM d JOIN q USING (module) WHERE dev <= 3.5*mad GROUP BY d.module),
robust AS (SELECT module, n_pairs, CASE WHEN n_pairs < 3 OR mad = 0 THEN med ELSE coalesce(fine, med) END AS offset_ns FROM m JOIN q USING (module) LEFT JOIN i USING (module))"""


def _detections(spark, sf):
    module = F.col("recorder") % 20
    return samples(spark, sf).select(
        module.alias("module"),
        (F.col("ts") - module * F.lit(1_000_000_000) - F.round(F.col("value") * 100).cast("bigint") * 1000).alias("device_ts"),
        (F.col("ts") - F.col("ts") % F.lit(MIN_NS).cast("bigint")).alias("qr_ts"),
    )


@query("time_payload", """SELECT event_id, epoch_us(ts)//1000*1000000 AS qr_ts FROM events""")
def time_payload(spark, sf):
    at = F.col("ts").cast("timestamp")
    text = F.concat(F.lit("oT"), F.date_format(at, "yyMMddHHmmss.SSS"), F.lit("oT"))
    return table(spark, sf, "events").select("event_id", timecols.parse_time_payload(text).alias("qr_ts"))


@query("qr_dedup_median", _DET + " SELECT module, qr_ts, device_ts FROM pairs")
def qr_dedup_median(spark, sf):
    return offsets.collapse_detections(_detections(spark, sf), ["module"]).select("module", "qr_ts", "device_ts")


@query("robust_offset", _DET + _ROBUST + " SELECT module, n_pairs, offset_ns FROM robust")
def robust_offset(spark, sf):
    pairs = offsets.collapse_detections(_detections(spark, sf), ["module"])
    return offsets.robust_offset(pairs, ["module"])


@query("offset_cascade", _DET + _ROBUST + """,
s AS (SELECT module, CASE WHEN module % 2 = 0 THEN arg_min(device_ts, device_ts) END AS fd, CASE WHEN module % 2 = 0 THEN arg_min(qr_ts, device_ts) END AS fq FROM det GROUP BY module)
SELECT module, CASE WHEN coalesce(n_pairs, 0) >= 1 THEN offset_ns ELSE fq - fd END AS offset_ns,
 CASE WHEN n_pairs >= 2 THEN 'robust' WHEN n_pairs = 1 THEN 'single' WHEN fq IS NOT NULL THEN 'stored' ELSE 'manual' END AS method
FROM s LEFT JOIN robust USING (module)""")
def offset_cascade(spark, sf):
    det = _detections(spark, sf)
    pairs = stage(offsets.collapse_detections(det, ["module"]))
    first = offsets.first_detection(det, ["module"])
    even = F.col("module") % 2 == 0
    stored = first.select(
        "module", F.when(even, F.col("device_ts")).alias("first_device_ts"), F.when(even, F.col("qr_ts")).alias("first_qr_ts")
    )
    return offsets.offset_cascade(offsets.robust_offset(pairs, ["module"]), stored, ["module"])


@query("first_detection", _DET + """ SELECT module, min(device_ts) AS device_ts, arg_min(qr_ts, device_ts) AS qr_ts FROM det GROUP BY module""")
def first_detection(spark, sf):
    return offsets.first_detection(_detections(spark, sf), ["module"])


@query("limit_unique_detections", _DET + """, f AS (SELECT module, qr_ts, min(device_ts) AS seen FROM det GROUP BY module, qr_ts),
k AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY seen, qr_ts) AS r FROM f)
SELECT det.module, device_ts, det.qr_ts FROM det JOIN k ON k.module = det.module AND r = 25 WHERE device_ts <= seen""")
def limit_unique_detections(spark, sf):
    ser = Series(["module"], ts="device_ts", cell_ns=7 * DAY_NS)
    return offsets.limit_unique(_detections(spark, sf), ser, 25)


@query("event_pair_delta", f"""WITH {SAMPLES}, p AS (SELECT recorder % 7 AS sensor_1, recorder % 11 AS sensor_2, ts AS ts_1, lead(ts) OVER (PARTITION BY recorder ORDER BY ts) AS ts_2 FROM samples)
SELECT sensor_1, sensor_2, CAST(trunc(quantile_cont(ts_1 - ts_2, 0.5)) AS BIGINT) AS pair_delta FROM p WHERE ts_2 IS NOT NULL GROUP BY 1, 2""")
def event_pair_delta(spark, sf):
    from sensorframe.operators.ordered import prev_next
    from sensorframe.queries.registry import REC

    rows = prev_next(samples(spark, sf), REC, ["ts"], None, "n").where("n is not null")
    pairs = rows.select(
        (F.col("recorder") % 7).alias("sensor_1"), (F.col("recorder") % 11).alias("sensor_2"),
        F.col("ts").alias("ts_1"), F.col("n.ts").alias("ts_2"),
    )
    return offsets.event_pair_delta(stage(pairs), ["sensor_1", "sensor_2"])


@query("chained_delta", f"""WITH {SAMPLES}, d AS (SELECT topic AS site, recorder % 7 AS sensor, CAST(sum(CAST(round(value*100) AS BIGINT)) AS BIGINT) AS delta FROM samples GROUP BY 1, 2),
p AS (SELECT topic AS site, recorder % 7 AS sensor_1, 100 + recorder % 11 AS sensor_2, CAST(trunc(quantile_cont(ts % 1000003, 0.5)) AS BIGINT) AS pair_delta FROM samples GROUP BY 1, 2, 3)
SELECT site, sensor_2 AS sensor, delta + pair_delta AS delta FROM p JOIN d USING (site) WHERE d.sensor = p.sensor_1""")
def chained_delta(spark, sf):
    rows = samples(spark, sf).withColumnRenamed("topic", "site")
    deltas = rows.groupBy("site", (F.col("recorder") % 7).alias("sensor")).agg(
        F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("delta")
    )
    pairs = rows.select(
        "site", (F.col("recorder") % 7).alias("sensor_1"), (F.col("recorder") % 11 + 100).alias("sensor_2"),
        (F.col("ts") % 1000003).alias("ts_1"), F.lit(0).cast("bigint").alias("ts_2"),
    )
    return offsets.chain_delta(deltas, offsets.event_pair_delta(pairs, ["site", "sensor_1", "sensor_2"]), ["site"])


_DELTAS = "dl AS (SELECT recorder, recorder*1000000007 - 50000000000 AS delta FROM samples WHERE recorder % 4 <> 0 GROUP BY recorder)"


def _deltas(spark, sf):
    rec = F.col("recorder")
    return samples(spark, sf).where(rec % 4 != 0).select("recorder").distinct().withColumn(
        "delta", rec * F.lit(1000000007).cast("bigint") - F.lit(50000000000).cast("bigint")
    )


@query("clock_delta_apply", f"""WITH {SAMPLES}, {_DELTAS} SELECT event_id, ts + coalesce(delta, 0) AS ts FROM samples LEFT JOIN dl USING (recorder)""")
def clock_delta_apply(spark, sf):
    return offsets.apply_delta(samples(spark, sf), _deltas(spark, sf), ["recorder"]).select("event_id", "ts")


@query("module_extent", f"WITH {SAMPLES} SELECT topic, recorder % 10 AS site, min(ts) AS min_ns, max(ts) AS max_ns FROM samples GROUP BY 1, 2")
def module_extent(spark, sf):
    rows = samples(spark, sf).withColumn("site", F.col("recorder") % 10)
    extent, _ = intervals.shared_window(rows, ["site"], "topic", "ts")
    return extent.select("topic", "site", "min_ns", "max_ns")


_SHARED = f"""WITH {SAMPLES}, e AS (SELECT recorder % 10 AS site, topic, min(ts) AS a, max(ts) AS b FROM samples GROUP BY 1, 2),
c AS (SELECT site, max(a) AS start_ns, min(b) AS end_ns FROM e GROUP BY site)"""


@query("shared_window", _SHARED + " SELECT site, start_ns, end_ns, start_ns < end_ns AS valid FROM c")
def shared_window(spark, sf):
    rows = samples(spark, sf).withColumn("site", F.col("recorder") % 10)
    return intervals.shared_window(rows, ["site"], "topic", "ts")[1]


@query("crop_to_shared", _SHARED + """ SELECT event_id, topic, ts FROM samples s JOIN c ON c.site = s.recorder % 10
WHERE start_ns < end_ns AND ts BETWEEN start_ns AND end_ns""")
def crop_to_shared(spark, sf):
    rows = samples(spark, sf).withColumn("site", F.col("recorder") % 10).withColumnRenamed("topic", "sensor")
    none = rows.select("site", "sensor", F.lit(0).cast("bigint").alias("delta")).limit(0)
    return alignment.apply_and_crop(rows, none, ["site"]).select("event_id", F.col("sensor").alias("topic"), "ts")


@query("align_first_pair", f"""WITH {SAMPLES}, d AS (SELECT recorder % 6 AS site, topic AS sensor, ts - recorder*1000 AS device_ts,
 CASE WHEN event_id % 3 = 0 AND topic <> 'view' THEN ts - ts % {MIN_NS} END AS qr_ts FROM samples),
f AS (SELECT site, sensor, min(device_ts) AS dv, arg_min(qr_ts, device_ts) AS qr FROM d WHERE qr_ts IS NOT NULL GROUP BY 1, 2),
s AS (SELECT DISTINCT site, sensor FROM d), o AS (SELECT site, sensor, qr - dv AS off FROM s LEFT JOIN f USING (site, sensor))
SELECT o.site, o.sensor, CASE WHEN o.off IS NULL THEN 'manual' ELSE 'first' END AS method, coalesce(o.off - r.off, c.off - r.off + 1234) AS delta
FROM o LEFT JOIN o r ON r.site = o.site AND r.sensor = 'click' LEFT JOIN o c ON c.site = o.site AND c.sensor = 'error' AND o.sensor = 'view'""")
def align_first_pair(spark, sf):
    # One topic decodes nothing and is aligned through event pairs with another.
    rows = samples(spark, sf).select(
        (F.col("recorder") % 6).alias("site"), F.col("topic").alias("sensor"),
        (F.col("ts") - F.col("recorder") * 1000).alias("device_ts"),
        F.when((F.col("event_id") % 3 == 0) & (F.col("topic") != "view"), F.col("ts") - F.col("ts") % F.lit(MIN_NS).cast("bigint")).alias("qr_ts"),
    )
    sensors = rows.select("site", "sensor").distinct()
    pairs = rows.where("sensor = 'view'").select(
        "site", F.lit("error").alias("sensor_1"), F.lit("view").alias("sensor_2"),
        (F.col("device_ts") + 1234).alias("ts_1"), F.col("device_ts").alias("ts_2"),
    )
    return alignment.align_first_pair(rows, sensors, ["site"], "click", pairs)


@query("align_high_precision", _DET + _ROBUST + """, r AS (SELECT offset_ns AS ref FROM robust WHERE module = 3)
SELECT 0 AS site, 'm' || module AS sensor, CASE WHEN n_pairs >= 2 THEN 'robust' ELSE 'single' END AS method, offset_ns - ref AS delta FROM robust, r""")
def align_high_precision(spark, sf):
    det = _detections(spark, sf).select(
        F.lit(0).alias("site"), F.concat(F.lit("m"), F.col("module")).alias("sensor"), "device_ts", "qr_ts"
    )
    sensors = det.select("site", "sensor").distinct()
    return alignment.align_high_precision(det, sensors, ["site"], "m3")


@query("split_interactions", f"""WITH {SAMPLES}, h AS (SELECT recorder % 4 AS site, CASE WHEN recorder % 3 = 0 THEN 'iphone_' || (recorder % 2) ELSE 'cam' END AS sensor, ts, topic FROM samples),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY site, sensor ORDER BY ts) > {HOUR_NS} THEN 1 ELSE 0 END AS brk FROM h WHERE topic IN ('click','error')),
q AS (SELECT *, sum(brk) OVER (PARTITION BY site, sensor ORDER BY ts) AS c FROM g),
b AS (SELECT site, sensor, min(ts) AS s, max(ts) AS e FROM q GROUP BY site, sensor, c HAVING count(*) >= 2),
n AS (SELECT site, sensor, count(*) AS n, min(s) AS b0, max(e) AS b1 FROM b GROUP BY 1, 2 HAVING count(*) >= 3),
p AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY CASE WHEN sensor LIKE 'iphone%' THEN 0 ELSE 1 END, CASE WHEN sensor LIKE 'iphone%' THEN sensor END DESC, sensor) AS r FROM n),
c AS (SELECT * FROM p WHERE r = 1), ext AS (SELECT site, sensor, min(ts) AS f, max(ts) AS l FROM h GROUP BY 1, 2),
ga AS (SELECT b.site, b.sensor, e AS s, lead(s) OVER (PARTITION BY b.site ORDER BY s) AS e FROM b JOIN c USING (site, sensor)),
u AS (SELECT c.site, c.sensor, 0 AS part, f AS s, b0 AS e FROM c JOIN ext USING (site, sensor) UNION ALL SELECT site, sensor, 1, s, e FROM ga WHERE e > s
 UNION ALL SELECT c.site, c.sensor, 2, b1, l FROM c JOIN ext USING (site, sensor)),
i AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY s, part)-1 AS k, (e-s)/1e9 AS d FROM u)
SELECT site, sensor, 'window_' || k AS name, s AS start_ns, e AS end_ns, round(d, 6)+0.0 AS duration_s FROM i WHERE d >= 7200""")
def split_interactions(spark, sf):
    rec = F.col("recorder")
    rows = samples(spark, sf).select(
        (rec % 4).alias("site"),
        F.when(rec % 3 == 0, F.concat(F.lit("iphone_"), (rec % 2).cast("string"))).otherwise(F.lit("cam")).alias("sensor"),
        "ts",
        F.when(F.col("topic") == "click", timecols.ACTION_CODES["yellow"])
        .when(F.col("topic") == "error", timecols.ACTION_CODES["blue"]).otherwise(F.col("topic")).alias("payload"),
    )
    extent = rows.groupBy("site", "sensor").agg(F.min("ts").alias("first_ns"), F.max("ts").alias("last_ns"))
    ser = Series(["site", "sensor"], cell_ns=10 * DAY_NS)
    out = alignment.split_interactions(rows, extent, ["site"], ser, eps_ns=HOUR_NS, min_s=7200.0)
    return out.select("site", "sensor", "name", "start_ns", "end_ns", r6("duration_s").alias("duration_s"))


@query("renumber_windows", """WITH w AS (SELECT o_custkey % 50 AS site, 'window_' || o_orderkey AS name, epoch_us(o_orderdate)*1000 + o_orderkey AS start_ns, o_orderkey, o_orderpriority, o_orderstatus FROM orders)
SELECT site, 'window_' || (row_number() OVER (PARTITION BY site ORDER BY start_ns) - 1) AS name, start_ns, o_orderpriority AS label, o_orderkey AS idx FROM w WHERE o_orderstatus = 'F'""")
def renumber_windows(spark, sf):
    # Windows of finished orders are the confirmed ones.
    rows = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    windows = rows.select(
        (F.col("o_custkey") % 50).alias("site"), F.concat(F.lit("window_"), key).alias("name"),
        (ns("o_orderdate") + key).alias("start_ns"), (ns("o_orderdate") + key + F.lit(HOUR_NS)).alias("end_ns"),
    )
    confirmed = rows.where("o_orderstatus = 'F'").select(
        (F.col("o_custkey") % 50).alias("site"), F.concat(F.lit("window_"), key).alias("name"),
        F.col("o_orderpriority").alias("single_word_description"), key.alias("index"),
    )
    out = alignment.renumber_confirmed(windows, confirmed, Series(["site"], cell_ns=365 * DAY_NS))
    return out.select("site", "name", "start_ns", F.col("single_word_description").alias("label"), F.col("index").alias("idx"))


@query("window_linspace", """SELECT o_orderkey AS window_id, i AS k, epoch_us(o_orderdate)*1000 + CAST(trunc(i*(o_totalprice*1000)/4) AS BIGINT) AS ts
FROM (SELECT *, unnest(range(5)) AS i FROM (SELECT o_orderkey, o_orderdate, CAST(floor(o_totalprice) AS BIGINT) AS o_totalprice FROM orders))""")
def window_linspace(spark, sf):
    start = ns("o_orderdate")
    span = F.floor("o_totalprice") * 1000
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("window_id"), timecols.linspace(start, start + span, 5).alias("t"))
    return rows.select("window_id", F.posexplode("t").alias("k", "ts"))
