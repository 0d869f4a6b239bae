"""Wrench physics, filters, fits, load evaluation and trajectories."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sensorframe.functions import geometry as g
from sensorframe.functions import wrench as wr
from sensorframe.operators import filters, fits, metrics
from sensorframe.operators.ordered import DAY_NS, Series
from sensorframe.plans import load, trajectories
from sensorframe.plans import wrench as wplan
from sensorframe.queries.geometry import _E, _vec
from sensorframe.queries.registry import HOUR_NS, MIN_NS, REC, RIG, SAMPLES, query, r6, rig, samples, table, topic
from sensorframe.queries.sequences import _nearest_sql, _windows, _WINDOWS

_HALF = 3


def _fit_matrix(window: int, order: int) -> np.ndarray:
    x = np.arange(-(window // 2), window // 2 + 1, dtype=float)
    hat = np.vander(x, order + 1, increasing=True)
    return hat @ np.linalg.pinv(hat)


def _fit_sql(window: int, order: int) -> str:
    return "[" + ", ".join("[" + ", ".join(repr(float(v)) for v in row) + "]" for row in _fit_matrix(window, order)) + "]"


@query("savgol", f"""WITH {SAMPLES}, n AS (SELECT event_id, recorder, row_number() OVER (PARTITION BY recorder ORDER BY ts) AS k, count(*) OVER (PARTITION BY recorder) AS c,
 list(value) OVER (PARTITION BY recorder ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a FROM samples),
p AS (SELECT *, greatest(1, least(k-3, c-6)) AS s, greatest(1, least(k-2, c-4)) AS t FROM n)
SELECT event_id, round(CASE WHEN c >= 7 THEN list_dot_product(a[s:s+6], ({_fit_sql(7, 2)})[k-s+1]) WHEN c >= 5 THEN list_dot_product(a[t:t+4], ({_fit_sql(5, 2)})[k-t+1]) WHEN c >= 3 THEN a[k] END, 6)+0.0 AS smooth FROM p""")
def savgol(spark, sf):
    out = filters.savgol(samples(spark, sf).select("event_id", "ts", "recorder", "value"), REC, ["value"], 7, 2)
    return out.select("event_id", r6(F.when(~F.isnan("value_smooth"), F.col("value_smooth"))).alias("smooth"))


@query("lowpass")
def lowpass(spark, sf):
    out = filters.lowpass(samples(spark, sf).select("event_id", "ts", "topic", "value"), Series(["topic"], cell_ns=DAY_NS), ["value"], 100.0)
    return out.select("event_id", r6("value_filt").alias("filt"))


@query("rate_cap", f"""WITH RECURSIVE {SAMPLES}, k AS (SELECT topic, min(ts) AS ts FROM samples GROUP BY topic
 UNION ALL SELECT s.topic, min(s.ts) FROM k JOIN samples s ON s.topic = k.topic AND s.ts >= k.ts + {2 * HOUR_NS} GROUP BY s.topic)
SELECT topic, ts FROM k""")
def rate_cap(spark, sf):
    out = filters.rate_cap(samples(spark, sf).select("topic", "ts"), Series(["topic"], cell_ns=DAY_NS), 1e9 / (2 * HOUR_NS), rows=500)
    return out.select("topic", "ts")


@query("contact_free_segments", f"""WITH {SAMPLES}, d AS (SELECT topic, ts, value AS fx, value*0.5 AS fy, value*value/100 + 0.49*9.81 AS fz FROM samples),
b AS (SELECT topic, quantile_cont(fx, 0.5) AS bx, quantile_cont(fy, 0.5) AS by_, quantile_cont(fz, 0.5) AS bz FROM d GROUP BY topic),
r AS (SELECT topic, ts, sqrt((fx-bx)*(fx-bx)+(fy-by_)*(fy-by_)+(fz-bz)*(fz-bz)) AS r FROM d JOIN b USING (topic)),
n AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY topic) AS c, first_value(r) OVER w AS fv,
 last_value(r) OVER (PARTITION BY topic ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv,
 list(r) OVER (PARTITION BY topic ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS a FROM r WINDOW w AS (PARTITION BY topic ORDER BY ts)),
s AS (SELECT topic, ts, k, list_sort(list_concat(list_concat(list_transform(range(greatest(0, 8-k)), lambda x: fv), a), list_transform(range(greatest(0, k+7-c)), lambda x: lv)))[8] AS s FROM n),
m AS (SELECT topic, quantile_cont(s, 0.5) AS med FROM s GROUP BY topic), q AS (SELECT topic, quantile_cont(abs(s-med), 0.5) AS mad FROM s JOIN m USING (topic) GROUP BY topic),
f AS (SELECT topic, ts, k, s <= med + 0.2*1.4826*mad AS free FROM s JOIN m USING (topic) JOIN q USING (topic)),
dt AS (SELECT topic, quantile_cont(d, 0.5) AS dt FROM (SELECT topic, ts - lag(ts) OVER (PARTITION BY topic ORDER BY ts) AS d FROM f) WHERE d IS NOT NULL GROUP BY topic),
i AS (SELECT topic, ts, k, k - row_number() OVER (PARTITION BY topic ORDER BY ts) AS g FROM f WHERE free),
w AS (SELECT topic, g, min(ts) AS t0, max(ts) AS t1, min(k) AS i, max(k) AS j FROM i GROUP BY topic, g),
z AS (SELECT w.*, dt, CAST(round_even({HOUR_NS}/dt, 0) AS BIGINT) AS mg, greatest(1, CAST(round_even(dt, 0) AS BIGINT)) AS tl FROM w JOIN dt USING (topic)),
v AS (SELECT * FROM z WHERE (t1 + tl - t0)/1e9 >= 7200 AND j - i + 1 > 2*mg)
SELECT v.topic, a.ts AS start_ns, b.ts + tl AS end_ns FROM v JOIN f a ON a.topic = v.topic AND a.k = v.i + mg JOIN f b ON b.topic = v.topic AND b.k = v.j - mg""")
def contact_free_segments(spark, sf):
    v = F.col("value")
    zero = F.lit(0.0)
    rows = samples(spark, sf).select(
        "topic", "ts", v.alias("fx"), (v * 0.5).alias("fy"), (v * v / 100 + 0.49 * 9.81).alias("fz"), zero.alias("tx"), zero.alias("ty"), zero.alias("tz"),
        zero.alias("gx"), zero.alias("gy"), F.lit(-9.81).alias("gz"),
    )
    _, windows = wplan.contact_free(
        rows, Series(["topic"], cell_ns=DAY_NS), mass=0.49, cog=(0.0, 0.0, 0.0), use_torque=False, k=0.2, min_free_s=7200.0, erode_s=3600.0
    )
    return windows


@query("gravity_compensation", f"""{_E}, gr AS (SELECT *, -9.81*m2 AS gx, -9.81*m5 AS gy, -9.81*m8 AS gz FROM m), f AS (SELECT *, 0.49*gx AS wx_, 0.49*gy AS wy_, 0.49*gz AS wz_ FROM gr)
SELECT vec_id, round(px-0.1-wx_, 6)+0.0 AS fx, round(py-0.2-wy_, 6)+0.0 AS fy, round(pz-0.3-wz_, 6)+0.0 AS fz, round(vx-0.01-(0.02*wz_-0.059*wy_), 6)+0.0 AS tx,
 round(vy-0.02-(0.059*wx_-0.021*wz_), 6)+0.0 AS ty, round(vz-0.03-(0.021*wy_-0.02*wx_), 6)+0.0 AS tz FROM f""")
def gravity_compensation(spark, sf):
    cols = {n: F.col(n) for n in ("px", "py", "pz", "qx", "qy", "qz", "qw", "vx", "vy", "vz")}
    grav = wr.gravity_in_sensor(g.transpose(g.transpose(g.quat_to_matrix([cols[c] for c in ("qx", "qy", "qz", "qw")]))))
    rows = _vec(spark, sf).select("*", *[c.alias(n) for c, n in zip(grav, ("gx", "gy", "gz"))])
    f, t = wr.compensate(
        [cols[c] for c in ("px", "py", "pz")], [cols[c] for c in ("vx", "vy", "vz")], [F.col(c) for c in ("gx", "gy", "gz")], F.lit(0.49),
        g.lits((0.021, 0.020, 0.059)), g.lits((0.1, 0.2, 0.3)), g.lits((0.01, 0.02, 0.03)),
    )
    return rows.select("vec_id", *[r6(c).alias(n) for c, n in zip([*f, *t], ("fx", "fy", "fz", "tx", "ty", "tz"))])


@query("internal_wrench", f"""{_E}, a AS (SELECT vec_id, px AS ax, py AS ay, pz AS az, vx AS ox, vy AS oy, vz AS oz, wx AS lx, wy AS ly, wz AS lz FROM e),
c AS (SELECT *, oy*0.06-oz*0.02 AS kx, oz*0.03-ox*0.06 AS ky, ox*0.02-oy*0.03 AS kz FROM a),
f AS (SELECT *, 0.5*(ax + ly*0.06-lz*0.02 + oy*kz-oz*ky) AS fx, 0.5*(ay + lz*0.03-lx*0.06 + oz*kx-ox*kz) AS fy, 0.5*(-9.81 + az + lx*0.02-ly*0.03 + ox*ky-oy*kx) AS fz,
 0.01*lx+0.001*ly AS hx, 0.001*lx+0.02*ly AS hy, 0.03*lz AS hz, 0.01*ox+0.001*oy AS jx, 0.001*ox+0.02*oy AS jy, 0.03*oz AS jz FROM c)
SELECT vec_id, round(fx, 6)+0.0 AS fx, round(fy, 6)+0.0 AS fy, round(fz, 6)+0.0 AS fz, round(0.02*fz-0.06*fy + hx + oy*jz-oz*jy, 6)+0.0 AS tx, round(0.06*fx-0.03*fz + hy + oz*jx-ox*jz, 6)+0.0 AS ty,
 round(0.03*fy-0.02*fx + hz + ox*jy-oy*jx, 6)+0.0 AS tz FROM f""")
def internal_wrench(spark, sf):
    c = [[F.col(f"{p}{a}") for a in "xyz"] for p in ("p", "v", "w")]
    f, t = wr.internal_wrench(g.lits((0, 0, -9.81)), *c, F.lit(0.5), g.lits((0.03, 0.02, 0.06)), g.lits((0.01, 0.02, 0.03, 0.001, 0, 0)), gyro=True)
    return _vec(spark, sf).select("vec_id", *[r6(x).alias(n) for x, n in zip([*f, *t], ("fx", "fy", "fz", "tx", "ty", "tz"))])


_ETA = ", ".join(repr(v) for v in wr.ETA_BINS)


@query("gripper_kinematics", f"""WITH a AS (SELECT l_orderkey, l_linenumber, l_discount*10 + 0.3 AS al, l_quantity*30 - 250 AS ma FROM lineitem),
k AS (SELECT *, 0.038*cos(al) + sqrt(greatest(0.0444*0.0444 - (0.038*sin(al))*(0.038*sin(al)), 0)) AS x, 2*(-0.038*sin(al) - 0.038*0.038*sin(al)*cos(al)/sqrt(greatest(0.0444*0.0444-0.038*0.038*sin(al)*sin(al), 1e-12))) AS dg,
 1.769*ma/1000 - 0.2214 AS tau, greatest(least((ma + 165)/70, 19), 0) AS p, [{_ETA}] AS eta FROM a),
e AS (SELECT *, eta[CAST(least(floor(p), 18) AS INT)+1] + (p - least(floor(p), 18))*(eta[CAST(least(floor(p), 18) AS INT)+2]-eta[CAST(least(floor(p), 18) AS INT)+1]) AS et FROM k)
SELECT l_orderkey, l_linenumber, round(x, 6)+0.0 AS x, round(dg, 6)+0.0 AS dg, round(tau, 6)+0.0 AS tau, round(et, 6)+0.0 AS eta, round(abs(et*tau)/greatest(abs(dg), 1e-9), 4)+0.0 AS force FROM e""")
def gripper_kinematics(spark, sf):
    al, ma = F.col("l_discount") * 10 + 0.3, F.col("l_quantity") * 30 - 250
    eta = wr.efficiency(ma)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(wr.finger_position(al)).alias("x"), r6(wr.gap_slope(al)).alias("dg"), r6(wr.motor_torque(ma)).alias("tau"),
        r6(eta).alias("eta"), r6(wr.clamp_force(al, ma, eta), 4).alias("force"),
    )


@query("load_lower_bound", f"""{_E}, d AS (SELECT *, px-vx AS dx, py-vy AS dy, pz-vz AS dz, (px+vx)/2 AS cx, (py+vy)/2 AS cy, (pz+vz)/2 AS cz FROM e),
l AS (SELECT *, sqrt(dx*dx+dy*dy+dz*dz) AS gap FROM d), a AS (SELECT *, (dy*wz-dz*wy)/gap AS ax, (dz*wx-dx*wz)/gap AS ay, (dx*wy-dy*wx)/gap AS az FROM l),
s AS (SELECT *, sqrt(ax*ax+ay*ay+az*az) AS n FROM a)
SELECT vec_id, round(2*abs(((0.1-(cy*3-cz*2))*ax + (0.2-(cz*1-cx*3))*ay + (0.3-(cx*2-cy*1))*az)/n)/gap, 5)+0.0 AS bound FROM s""")
def load_lower_bound(spark, sf):
    p, v, w = [[F.col(f"{k}{a}") for a in "xyz"] for k in "pvw"]
    bound = wr.load_lower_bound(g.lits((1, 2, 3)), g.lits((0.1, 0.2, 0.3)), p, v, w)
    return _vec(spark, sf).select("vec_id", r6(bound, 5).alias("bound"))


@query("ls_origin", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity*l_extendedprice)/sum(l_quantity*l_quantity), 4)+0.0 AS slope FROM lineitem GROUP BY 1")
def ls_origin(spark, sf):
    out = fits.through_origin(table(spark, sf, "lineitem"), ["l_returnflag"], F.col("l_quantity"), F.col("l_extendedprice"))
    return out.select("l_returnflag", "n", r6("slope", 4).alias("slope"))


@query("binned_ls", """WITH r AS (SELECT l_returnflag AS f, least(CAST(floor((l_extendedprice/70 + 200)/70) AS INT), 19) AS b, l_quantity AS x, l_quantity*(l_discount+0.2)*4 AS y, l_extendedprice/70 AS w FROM lineitem),
p AS (SELECT f, b, count(*) AS n, sum(x*y)/sum(x*x) AS s FROM r WHERE w BETWEEN -200 AND 1200 GROUP BY f, b),
g AS (SELECT f, unnest(range(20)) AS b FROM (SELECT DISTINCT f FROM r)), a AS (SELECT g.f, g.b, coalesce(n, 0) AS n, CASE WHEN n >= 5 THEN s END AS s FROM g LEFT JOIN p USING (f, b)),
l AS (SELECT a.*, (SELECT max(b) FROM a q WHERE q.f = a.f AND q.b <= a.b AND q.s IS NOT NULL) AS lo, (SELECT min(b) FROM a q WHERE q.f = a.f AND q.b >= a.b AND q.s IS NOT NULL) AS hi FROM a)
SELECT l.f AS flag, l.b AS bin, l.n, round(greatest(least(coalesce(l.s, x.s + (l.b-l.lo)/(CASE WHEN l.hi <> l.lo THEN l.hi-l.lo END)*(y.s-x.s), x.s, y.s), 1.5), 0), 6)+0.0 AS eta
FROM l LEFT JOIN a x ON x.f = l.f AND x.b = l.lo LEFT JOIN a y ON y.f = l.f AND y.b = l.hi""")
def binned_ls(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("x"), (F.col("l_quantity") * (F.col("l_discount") + 0.2) * 4).alias("y"), (F.col("l_extendedprice") / 70).alias("w"))
    return fits.binned_slope(rows, ["flag"], F.col("w"), F.col("x"), F.col("y")).select("flag", "bin", "n", r6("eta").alias("eta"))


@query("contact_free_bias", f"WITH {SAMPLES} SELECT topic, round(quantile_cont(value, 0.5), 6)+0.0 AS value FROM samples WHERE value < 40 GROUP BY topic")
def contact_free_bias(spark, sf):
    return metrics.median_bias(samples(spark, sf), ["topic"], ["value"], F.col("value") < 40).select("topic", r6("value").alias("value"))


@query("bias_subtracted", f"WITH {SAMPLES}, b AS (SELECT topic, quantile_cont(value, 0.5) AS b FROM samples WHERE value < 40 GROUP BY topic) SELECT event_id, round(value - b, 6)+0.0 AS value FROM samples JOIN b USING (topic)")
def bias_subtracted(spark, sf):
    rows = samples(spark, sf)
    bias = metrics.median_bias(rows, ["topic"], ["value"], F.col("value") < 40)
    return metrics.subtract_bias(rows, bias, ["topic"], ["value"]).select("event_id", r6("value").alias("value"))


@query("stage_metrics", f"""{_E} SELECT label, count(*) AS sample_count, """ + ", ".join(
    f"round(sqrt(avg({a}x*{a}x+{a}y*{a}y+{a}z*{a}z)), 6)+0.0 AS {n}_rms_norm, round(avg(sqrt({a}x*{a}x+{a}y*{a}y+{a}z*{a}z)), 6)+0.0 AS {n}_norm_mean, "
    f"round(stddev_pop(sqrt({a}x*{a}x+{a}y*{a}y+{a}z*{a}z)), 6)+0.0 AS {n}_norm_std, round(max(sqrt({a}x*{a}x+{a}y*{a}y+{a}z*{a}z)), 6)+0.0 AS {n}_norm_max, "
    + ", ".join(f"round(avg({a}{k}), 6)+0.0 AS {n}_{k}_mean, round(stddev_pop({a}{k}), 6)+0.0 AS {n}_{k}_std" for k in "xyz")
    for a, n in (("p", "force"), ("v", "torque"))) + " FROM e GROUP BY label")
def stage_metrics(spark, sf):
    out = metrics.stage_metrics(_vec(spark, sf), ["label"], [F.col(f"p{a}") for a in "xyz"], [F.col(f"v{a}") for a in "xyz"])
    return out.select("label", "sample_count", *[r6(c).alias(c) for c in out.columns if c not in ("label", "sample_count")])


@query("signal_statistics", f"""{_E}, s AS (SELECT label, 'a' AS signal, sqrt(px*px+py*py+pz*pz) AS n FROM e WHERE px > 0 UNION ALL SELECT label, 'omega', sqrt(vx*vx+vy*vy+vz*vz) FROM e WHERE px > 0)
SELECT label, signal, round(avg(n), 6)+0.0 AS norm_mean, round(max(n), 6)+0.0 AS norm_max FROM s GROUP BY 1, 2""")
def signal_statistics(spark, sf):
    sig = {"a": [F.col(f"p{a}") for a in "xyz"], "omega": [F.col(f"v{a}") for a in "xyz"]}
    out = metrics.signal_statistics(_vec(spark, sf), ["label"], sig, F.col("px") > 0)
    return out.select("label", "signal", r6("norm_mean").alias("norm_mean"), r6("norm_max").alias("norm_max"))


def _tool_rows(spark, sf):
    """Wrench of a tool of known parameters held in the embeddings' orientations, moved as their vectors say."""
    rows = _vec(spark, sf)
    m = g.quat_to_matrix([F.col(c) for c in ("qx", "qy", "qz", "qw")])
    rows = rows.select("vec_id", "label", "px", "py", "pz", "vx", "vy", "vz", "wx", "wy", "wz", *[c.alias(n) for c, n in zip(wr.gravity_in_sensor(m), wplan.GRAV)])
    return rows


_TRUE = {"mass": 0.5, "cog": (0.02, -0.01, 0.06), "f0": (1.0, -2.0, 0.5), "t0": (0.1, 0.05, -0.2), "inertia": (0.012, 0.015, 0.02, 0.001, -0.002, 0.0005)}


def _measured(rows, moving, gyro=False, noise=1e-3):
    zero = g.lits((0, 0, 0))
    acc, om, al = ([F.col(f"{p}{a}") for a in "xyz"] for p in "pvw") if moving else (zero, zero, zero)
    f, t = wr.internal_wrench([F.col(c) for c in wplan.GRAV], acc, om, al, F.lit(_TRUE["mass"]), g.lits(_TRUE["cog"]), g.lits(_TRUE["inertia"]), gyro=gyro)
    noise = F.col("px") * noise
    return rows.select("*", *[(c + b + noise).alias(n) for c, b, n in zip(f, _TRUE["f0"], ("fx", "fy", "fz"))], *[(c + b + noise).alias(n) for c, b, n in zip(t, _TRUE["t0"], ("tx", "ty", "tz"))])


@query("tool_params_known", f"""{_E}, gr AS (SELECT *, -9.81*m2 AS gx, -9.81*m5 AS gy, -9.81*m8 AS gz FROM m)
SELECT label, 0.5::DOUBLE AS m, """ + ", ".join(f"round(sum(({b}) + px*1e-3)/(count(*)+1e-6), 5)+0.0 AS f0{a}" for a, b in zip("xyz", _TRUE["f0"])) + " FROM gr GROUP BY label")
def tool_params_known(spark, sf):
    rows = _measured(_tool_rows(spark, sf), False)
    out = fits.tool_params_static(rows, ["label"], *[[F.col(c) for c in n] for n in (wplan.FORCE, wplan.TORQUE, wplan.GRAV)], mass=0.5, cog=_TRUE["cog"])
    return out.select("label", "m", *[r6(c, 5).alias(c) for c in fits.F0])


@query("tool_params_ls")
def tool_params_ls(spark, sf):
    rows = _measured(_tool_rows(spark, sf), False)
    out = fits.tool_params_static(rows, ["label"], *[[F.col(c) for c in n] for n in (wplan.FORCE, wplan.TORQUE, wplan.GRAV)])
    return out.select("label", *[r6(c, 4).alias(c) for c in out.columns if c != "label"])


_PARAMS = [*zip(fits.F0, _TRUE["f0"]), *zip(fits.TAU0, _TRUE["t0"]), *zip(fits.COG, _TRUE["cog"]), *zip(fits.INERTIA, _TRUE["inertia"])]
_TRUTH = ", ".join(f"round({v}::DOUBLE, 5) AS {n}" for n, v in _PARAMS)


@query("dynamic_fit", f"""SELECT label, gyro, fit_cog, {_TRUTH}, count(*) AS n, true AS converged, true AS inertia_is_spd, 0.0::DOUBLE AS rms_t
FROM embeddings, (VALUES (false), (true)) a(gyro), (VALUES (false), (true)) b(fit_cog) GROUP BY label, gyro, fit_cog""")
def dynamic_fit(spark, sf):
    """Wrenches without noise give back the tool they were made with, in all four variants; a free centre starts elsewhere."""
    cols = [[F.col(c) for c in n] for n in (wplan.FORCE, wplan.TORQUE, wplan.GRAV)]
    move = [[F.col(f"{p}{a}") for a in "xyz"] for p in "pvw"]
    parts = [_measured(_tool_rows(spark, sf), True, flag, 0.0).withColumn("gyro", F.lit(flag)) for flag in (False, True)]
    rows, out = parts[0].unionByName(parts[1]), None
    for free in (False, True):
        cog = (0.0, 0.0, 0.05) if free else _TRUE["cog"]
        fit = fits.tool_params_dynamic(rows, ["label", "gyro"], *cols, *move, mass=0.5, cog=cog, fit_cog=free, gyro=F.col("gyro")).withColumn("fit_cog", F.lit(free))
        out = fit if out is None else out.unionByName(fit)
    return out.select("label", "gyro", "fit_cog", *[r6(n, 5).alias(n) for n, _ in _PARAMS], "n", "converged", "inertia_is_spd", r6("rmsT", 5).alias("rms_t"))


_SMOOTHINGS = (wplan.Smoothing(5, 2, 5, 2), wplan.Smoothing(9, 3, 7, 2))
_LEVER = (0.1, -0.05, 0.2)
_EYE = (1, 0, 0, 0, 1, 0, 0, 0, 1)


@query("calibration_sweep", f"""SELECT label, 1 AS smoothing, true AS gyro, 0 AS offset_ns, {_TRUTH}, true AS converged, 0.0::DOUBLE AS rms_t FROM embeddings GROUP BY label""")
def calibration_sweep(spark, sf):
    """Of all candidates each recording finds the smoothing, the gyroscopic term and the time offset that its wrenches were made with."""
    rows = _vec(spark, sf)
    m = g.quat_to_matrix([F.col(c) for c in ("qx", "qy", "qz", "qw")])
    step = 10_000_000
    poses = rows.select("label", (F.col("vec_id") * step).alias("ts"), "qx", "qy", "qz", "qw", *[F.col(f"p{a}").alias(f"v{a}") for a in "xyz"], *[(F.col(f"v{a}") * 3).alias(f"o{a}") for a in "xyz"])
    s = Series(["label"], cell_ns=HOUR_NS)
    grav = [c.alias(n) for c, n in zip(wr.gravity_in_sensor(m), wplan.GRAV)]
    times = rows.select("label", (F.col("vec_id") * step + F.when(F.col("vec_id") % 3 == 0, 3_000_000).otherwise(0)).alias("ts"), *grav)
    truth = _SMOOTHINGS[1]
    signals = wplan.smoothed_signals(poses, s, (truth.linear_window, truth.angular_window), (truth.linear_order, truth.angular_order))
    moved = wplan.signals_at(times, signals, s, device_sensor=_EYE, lever=_LEVER)
    vectors = [[F.col(f"{p}{a}") for a in "xyz"] for p in "aol"]
    f, t = wr.internal_wrench([F.col(c) for c in wplan.GRAV], *vectors, F.lit(_TRUE["mass"]), g.lits(_TRUE["cog"]), g.lits(_TRUE["inertia"]), gyro=True)
    wrench = moved.select("label", "ts", *wplan.GRAV, *[(c + b).alias(n) for c, b, n in zip((*f, *t), (*_TRUE["f0"], *_TRUE["t0"]), (*wplan.FORCE, *wplan.TORQUE))])
    chosen, _ = wplan.calibrate(
        wrench, poses, s, _SMOOTHINGS, (0, 4_000_000), device_sensor=_EYE, lever=_LEVER, mass=0.5, cog=_TRUE["cog"], tol=1e-6, rounds=25,
    )
    return chosen.select("label", "smoothing", "gyro", F.col("offset_ns").cast("int").alias("offset_ns"), *[r6(n, 5).alias(n) for n, _ in _PARAMS], "converged", r6("rmsT", 5).alias("rms_t"))


_M = "SELECT event_id, ts, recorder/100.0 AS position, value/100 - 0.1 AS velocity, value*4 - 100 AS effort FROM samples WHERE topic='click'"


def _motor(spark, sf):
    v = F.col("value")
    return rig(topic(spark, sf, "click")).select(
        "rig", "event_id", "ts", (F.col("recorder") / 100.0).alias("position"), (v / 100 - 0.1).alias("velocity"), (v * 4 - 100).alias("effort")
    )


def _force(spark, sf):
    v = F.col("value")
    return rig(topic(spark, sf, "error")).select("rig", "ts", (v / 10).alias("fx"), (v / 20).alias("fy"), (v / 30).alias("fz"))


_AL = "(position + radians(116.0))"
_DG = f"(2*(-0.038*sin({_AL}) - 0.038*0.038*sin({_AL})*cos({_AL})/sqrt(greatest(0.0444*0.0444-0.038*0.038*sin({_AL})*sin({_AL}), 1e-12))))"


@query("load_ground_truth", f"""WITH {SAMPLES}, mo AS (SELECT ts, ts AS mts, position, effort FROM ({_M}) WHERE position > radians(85.0+64.0-180.0) AND velocity >= 0 AND abs(effort) > 50),
w AS (SELECT ts, value/10 AS fx, value/20 AS fy, value/30 AS fz FROM samples WHERE topic='error'), {_nearest_sql('mo', 'w', 'h', ['fx', 'fy', 'fz'], 20 * MIN_NS)},
k AS (SELECT *, greatest(least((effort + 165)/70, 19), 0) AS p, [{_ETA}] AS eta FROM h WHERE fx IS NOT NULL),
e AS (SELECT *, eta[CAST(least(floor(p), 18) AS INT)+1] + (p - least(floor(p), 18))*(eta[CAST(least(floor(p), 18) AS INT)+2]-eta[CAST(least(floor(p), 18) AS INT)+1]) AS et FROM k),
c AS (SELECT ts, mts AS load_ts, abs(fy) AS lx, abs(fz) AS ly, 2*abs(et*(1.769*effort/1000-0.2214))/greatest(abs({_DG}), 1e-9) + abs(fx) AS lz FROM e),
r AS (SELECT ts, load_ts, lx, ly, lz, (lx+ly+lz)/max(lx+ly+lz) OVER () AS nrm FROM c), im AS (SELECT event_id, ts FROM samples WHERE topic='view'),
{_nearest_sql('im', 'r', 'n', ['load_ts', 'lx', 'ly', 'lz', 'nrm'], 30 * MIN_NS)}
SELECT event_id, load_ts, round(lx, 4)+0.0 AS lx, round(ly, 4)+0.0 AS ly, round(lz, 4)+0.0 AS lz, round(sqrt(least(lx,8)*least(lx,8)+least(ly,8)*least(ly,8)+least(lz,10)*least(lz,10)), 4)+0.0 AS l2_clipped, round(nrm, 5)+0.0 AS nrm FROM n WHERE load_ts IS NOT NULL""")
def load_ground_truth(spark, sf):
    images = rig(topic(spark, sf, "view")).select("rig", "event_id", "ts")
    eye = (1, 0, 0, 0, 1, 0, 0, 0, 1)
    out = load.load_ground_truth(_motor(spark, sf).drop("event_id"), _force(spark, sf), images, RIG, eye, tolerance=20 * MIN_NS, image_tolerance=30 * MIN_NS)
    return out.select(
        "event_id", "load_ts", r6("L_star_x", 4).alias("lx"), r6("L_star_y", 4).alias("ly"), r6("L_star_z", 4).alias("lz"), r6("L_star_L2_clipped", 4).alias("l2_clipped"),
        r6("L_star_normalized", 5).alias("nrm"),
    )


_SIDE = "SELECT l_suppkey AS k, l_orderkey AS ts, l_quantity/10 AS fx, l_discount*50 AS fy, l_tax*80 AS fz, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_quantity DESC, l_discount DESC, l_tax DESC) AS r FROM lineitem WHERE l_returnflag = '{f}'"
_PREDS = f"""WITH a AS (SELECT * FROM ({_SIDE.format(f='A')}) WHERE r = 1), b AS (SELECT * FROM ({_SIDE.format(f='R')}) WHERE r = 1),
both_ AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.ts, b.ts) AS ts, a.fx AS ax, a.fy AS ay, a.fz AS az, b.fx AS bx, b.fy AS b_y, b.fz AS bz FROM a FULL JOIN b ON a.k = b.k AND a.ts = b.ts),
gt AS (SELECT l_suppkey AS k, l_orderkey AS ts, max(l_extendedprice)/20000 AS tan_, max(l_extendedprice)/9000 AS z FROM lineitem GROUP BY 1, 2),
j AS (SELECT gt.*, abs(coalesce(ax,0))+abs(coalesce(bx,0)) AS sx, abs(coalesce(ay,0))+abs(coalesce(b_y,0)) AS sy, abs(coalesce(az,0))+abs(coalesce(bz,0)) AS sz FROM gt JOIN both_ USING (k, ts))"""


def _merged(spark, sf):
    li = table(spark, sf, "lineitem")
    order = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax")

    def side(flag):
        return li.where(F.col("l_returnflag") == flag).select(
            F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("ts"), order.alias("index"), (F.col("l_quantity") / 10).alias("Fx"),
            (F.col("l_discount") * 50).alias("Fy"), (F.col("l_tax") * 80).alias("Fz"),
        )

    tan, z = F.max("l_extendedprice") / 20000, F.max("l_extendedprice") / 9000
    gt = li.groupBy(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("ts")).agg(tan.alias("L_star_tangential_L2"), z.alias("L_star_z"))
    gt = gt.withColumn("L_star_L2", F.sqrt(F.pow("L_star_tangential_L2", F.lit(2.0)) + F.pow("L_star_z", F.lit(2.0))))
    for c, cap in (("L_star_tangential_L2", 11.0), ("L_star_z", 10.0), ("L_star_L2", 15.0)):
        gt = gt.withColumn(f"{c}_clipped", F.least(F.col(c), F.lit(cap)))
    return load.merge_predictions(side("A"), side("R"), gt, ["k"])


@query("merge_predictions", _PREDS + " SELECT k, ts, round(sqrt(sx*sx+sy*sy), 6)+0.0 AS tangential, round(sz, 6)+0.0 AS normal, round(sqrt(sx*sx+sy*sy+sz*sz), 6)+0.0 AS total FROM j")
def merge_predictions(spark, sf):
    return _merged(spark, sf).select("k", "ts", r6("L_pred_tangential").alias("tangential"), r6("L_pred_normal").alias("normal"), r6("L_pred_total").alias("total"))


@query("evaluate_predictions", _PREDS + """, l AS (SELECT 'normal_L2' AS head, 'raw' AS mode, z AS y, sz AS yhat, z <= 10 AS i FROM j UNION ALL SELECT 'normal_L2', 'clipped', least(z, 10), least(sz, 10), z <= 10 FROM j
 UNION ALL SELECT 'tangential_L2', 'raw', tan_, sqrt(sx*sx+sy*sy), tan_ <= sqrt(128) FROM j UNION ALL SELECT 'tangential_L2', 'clipped', least(tan_, 11), sqrt(least(sx,8)*least(sx,8)+least(sy,8)*least(sy,8)), tan_ <= sqrt(128) FROM j
 UNION ALL SELECT 'combined_L2', 'raw', sqrt(tan_*tan_+z*z), sqrt(sx*sx+sy*sy+sz*sz), sqrt(tan_*tan_+z*z) <= sqrt(228) FROM j
 UNION ALL SELECT 'combined_L2', 'clipped', least(sqrt(tan_*tan_+z*z), 15), sqrt(least(sx,8)*least(sx,8)+least(sy,8)*least(sy,8)+least(sz,10)*least(sz,10)), sqrt(tan_*tan_+z*z) <= sqrt(228) FROM j),
s AS (SELECT head, mode, 'overall' AS split, y, yhat FROM l UNION ALL SELECT head, mode, CASE WHEN i THEN 'in' ELSE 'out' END, y, yhat FROM l)
SELECT head, mode, split, count(*) AS n, round(sqrt(avg((yhat-y)*(yhat-y))), 6)+0.0 AS rmse, round(avg(yhat-y), 6)+0.0 AS bias FROM s GROUP BY ALL""")
def evaluate_predictions(spark, sf):
    out = load.evaluate_predictions(_merged(spark, sf), [])
    return out.select("head", "mode", "split", "n", r6("rmse").alias("rmse"), r6("bias").alias("bias"))


_EP = f"""WITH {SAMPLES}, {_WINDOWS}, f AS (SELECT s.event_id, s.ts, w.window_id FROM samples s JOIN w ON s.ts BETWEEN w.start_ns - {5 * MIN_NS} AND w.end_ns + {5 * MIN_NS} WHERE s.topic='view'),
mo AS (SELECT ts, ts AS mts FROM samples WHERE topic='click'), wr AS (SELECT ts, value/10 AS fx FROM samples WHERE topic='error'), tr AS (SELECT ts, recorder AS rec, value AS vv FROM samples WHERE topic='signup'),
{_nearest_sql('f', 'mo', 'h1', ['mts'], 40 * MIN_NS)}, {_nearest_sql('h1', 'wr', 'h2', ['fx'], 40 * MIN_NS)}, {_nearest_sql('h2', 'tr', 'h3', ['rec', 'vv'], 40 * MIN_NS)}
SELECT window_id, event_id, CASE WHEN window_id % 2 = 1 THEN 'close' ELSE 'open' END AS prompt, round(CASE WHEN abs(vv) > 1e-12 THEN fx ELSE 0 END, 6)+0.0 AS force_along,
 CASE WHEN row_number() OVER (PARTITION BY window_id ORDER BY ts DESC) = 1 THEN 1 ELSE 0 END AS keyframe_step FROM h3 WHERE mts IS NOT NULL AND fx IS NOT NULL AND rec IS NOT NULL"""


@query("force_episodes", _EP)
def force_episodes(spark, sf):
    wide = _windows(spark, sf).select(
        "rig", F.col("window_id").alias("window_index"), (F.col("start_ns") - F.lit(5 * MIN_NS)).alias("start_ns"), (F.col("end_ns") + F.lit(5 * MIN_NS)).alias("end_ns")
    )
    zero = F.lit(0.0)
    frames = rig(topic(spark, sf, "view")).select("rig", "event_id", "ts")
    force = rig(topic(spark, sf, "error")).select("rig", "ts", (F.col("value") / 10).alias("fx"), zero.alias("fy"), zero.alias("fz"), zero.alias("mx"), zero.alias("my"), zero.alias("mz"))
    track = rig(topic(spark, sf, "signup")).select(
        "rig", "ts", *[zero.alias(n) for n in ("tx", "ty", "tz", "qx", "qy", "qz")], F.lit(1.0).alias("qw"), F.col("value").alias("vx"), *[zero.alias(n) for n in ("vy", "vz", "ox", "oy", "oz")]
    )
    out = load.force_episodes(
        frames, wide, _motor(spark, sf).drop("event_id", "velocity"), force, track, RIG, frame_tol=40 * MIN_NS, wrench_tol=40 * MIN_NS, pose_tol=40 * MIN_NS, width_ns=20 * MIN_NS,
        per_frame={"force_along": r6("force_along")},
    )
    return out.select(F.col("window_index").alias("window_id"), "event_id", "prompt", "force_along", "keyframe_step")


@query("peak_samples", f"""WITH {SAMPLES}, {_WINDOWS}, m AS (SELECT window_id, ts, value/10 AS fx, value/20 AS fy, value/30 AS fz FROM samples JOIN w ON ts BETWEEN start_ns - {HOUR_NS} AND end_ns WHERE topic='error'),
k AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY abs(fz) DESC, ts) AS r FROM m), l AS (SELECT window_id, ts AS peak_ts, ts - 2500000000 AS ts, sqrt(fx*fx+fy*fy+fz*fz) AS res FROM k WHERE r = 1),
v AS (SELECT ts, ts AS frame_ts FROM samples WHERE topic='view'), {_nearest_sql('l', 'v', 'n', ['frame_ts'], 1 << 62)}
SELECT window_id, peak_ts, frame_ts, round(res, 6)+0.0 AS resultant FROM n""")
def peak_samples(spark, sf):
    win = _windows(spark, sf).select("rig", F.col("window_id").alias("window_index"), (F.col("start_ns") - F.lit(HOUR_NS)).alias("start_ns"), "end_ns")
    frames = rig(topic(spark, sf, "view")).select("rig", "ts")
    out = load.peak_samples(_force(spark, sf), win, frames, RIG, width_ns=HOUR_NS)
    return out.select(F.col("window_index").alias("window_id"), "peak_ts", "frame_ts", r6("resultant").alias("resultant"))


@query("motor_calibration", f"""WITH {SAMPLES}, mo AS (SELECT ts, position, velocity, effort FROM ({_M})), w AS (SELECT ts, value/30 AS fz FROM samples WHERE topic='error'),
{_nearest_sql('mo', 'w', 'h', ['fz'], 30 * MIN_NS)}, k AS (SELECT * FROM h WHERE fz IS NOT NULL), b AS (SELECT quantile_cont(fz, 0.5) AS b FROM k WHERE abs(velocity) < 0.1 AND abs(effort) < 30),
x AS (SELECT abs(1.769*effort/1000-0.2214) AS x, abs({_DG})*0.5*abs(fz-b) AS y FROM k, b) SELECT count(*) AS n, round(sum(x*y)/sum(x*x), 6)+0.0 AS slope FROM x""")
def motor_calibration(spark, sf):
    one, _ = wplan.motor_calibration(_motor(spark, sf), _force(spark, sf), RIG, tolerance=30 * MIN_NS)
    return one.select("n", r6("slope").alias("slope"))


def _tracks(spark, sf):
    rows = _vec(spark, sf).withColumn("rig", F.lit(0))
    pose = ["px", "py", "pz", "qx", "qy", "qz", "qw"]
    names = ["tx", "ty", "tz", "qx", "qy", "qz", "qw"]
    return rows.select("rig", (F.col("vec_id") * 1_000_000_000).alias("ts"), *[F.col(c).alias(n) for c, n in zip(pose, names)])


@query("drift_segments", f"""{_E}, p AS (SELECT vec_id AS i, px, py, pz FROM n), a AS (SELECT vec_id AS i, vx AS x, vy AS y, vz AS z, lead(vec_id) OVER (ORDER BY vec_id) AS j FROM n WHERE vec_id % 25 = 0),
s AS (SELECT a.i, a.j, sqrt((b.x-a.x)^2+(b.y-a.y)^2+(b.z-a.z)^2)/sqrt((q.px-p.px)^2+(q.py-p.py)^2+(q.pz-p.pz)^2) AS scale, p.px AS fx, p.py AS fy, p.pz AS fz, a.x, a.y, a.z
 FROM a JOIN a b ON b.i = a.j JOIN p ON p.i = a.i JOIN p q ON q.i = a.j), r AS (SELECT p.*, s.i AS si, scale, fx, fy, fz, x, y, z, row_number() OVER (PARTITION BY p.i ORDER BY s.i) AS k FROM p JOIN s ON p.i BETWEEN s.i AND s.j)
SELECT i*1000000000 AS ts, round(scale, 5)+0.0 AS scale, round(x + scale*(px-fx), 5)+0.0 AS tx, round(y + scale*(py-fy), 5)+0.0 AS ty, round(z + scale*(pz-fz), 5)+0.0 AS tz FROM r WHERE k = 1""")
def drift_segments(spark, sf):
    # Anchors share the trajectory's orientation here, so the re-anchoring is a scale and a shift.
    track = _tracks(spark, sf)
    anchors = _vec(spark, sf).where("vec_id % 25 = 0").select(
        F.lit(0).alias("rig"), (F.col("vec_id") * 1_000_000_000).alias("ts"), F.col("vx").alias("tx"), F.col("vy").alias("ty"), F.col("vz").alias("tz"), "qx", "qy", "qz", "qw"
    )
    out = trajectories.drift_segments(track, anchors, Series(["rig"], cell_ns=HOUR_NS))
    return out.select("ts", *[r6(c, 5).alias(c) for c in ("scale", "tx", "ty", "tz")])


@query("trajectory_evaluation")
def trajectory_evaluation(spark, sf):
    # The second trajectory is the first one shifted by a fixed offset plus small noise.
    a = _tracks(spark, sf)
    b = a.withColumn("tx", F.col("tx") + 5.0 + F.col("qx") * 1e-3).withColumn("ty", F.col("ty") - 2.0)
    out = trajectories.align_and_compare(a, b, Series(["rig"], cell_ns=HOUR_NS), 1.0)
    return out.select("n", r6("rmse", 4).alias("rmse"), *[r6(c, 3).alias(c) for c in ("tx", "ty", "tz", "scale")])


@query("wrench_compensation")
def wrench_compensation(spark, sf):
    rows = _measured(_tool_rows(spark, sf), False).select(F.lit(0).alias("rig"), (F.col("vec_id") * 10_000_000).alias("ts"), *wplan.FORCE, *wplan.TORQUE)
    poses = _tracks(spark, sf).withColumn("ts", F.call_function("div", F.col("ts"), F.lit(100).cast("bigint")))
    out = wplan.compensate_wrench(rows, poses, Series(["rig"], cell_ns=HOUR_NS), (1, 0, 0, 0, 1, 0, 0, 0, 1), mass=0.5, cog=_TRUE["cog"], rate_hz=100.0, min_free_s=0.02, erode_s=0.0)
    return out.select("ts", *[r6(f"ext_{c}_filt", 4).alias(c) for c in (*wplan.FORCE, *wplan.TORQUE)])
