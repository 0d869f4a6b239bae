"""Wrench compensation, contact-free time, motor calibration and tool sweeps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.functions import geometry as g
from sensorframe.functions import wrench as wr
from sensorframe.operators import fits, metrics, selection
from sensorframe.operators.asof import asof_join
from sensorframe.operators.filters import lowpass, savgol
from sensorframe.operators.interp import gradient, interpolate_clamped, interpolate_pose, rolling_median, sampling_rate
from sensorframe.operators.ordered import Series, number_rows, prev_next, running_sum
from sensorframe.operators.quantiles import attach, exact_medians
from sensorframe.session import stage

FORCE = ("fx", "fy", "fz")
TORQUE = ("tx", "ty", "tz")
GRAV = ("gx", "gy", "gz")


def _c(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def contact_free(
    df: DataFrame, s: Series, *, mass: float, cog: Sequence[float], use_torque: bool = True, smooth: int = 15, k: float = 1.0,
    min_free_s: float = 10.0, erode_s: float = 0.0,
) -> tuple[DataFrame, DataFrame]:
    """Rows with a ``free`` flag, and the contact-free windows per series.

    Rows need force, torque and sensor-frame gravity columns. The flag is the plain threshold; minimum length and
    erosion shape only the windows.
    """
    cols = [*FORCE, *TORQUE, *GRAV]
    weight = [F.lit(mass) * x for x in _c(GRAV)]
    lever = g.cross(g.lits(cog), weight)
    free = {n: F.col(n) - w for n, w in zip((*FORCE, *TORQUE), (*weight, *lever))}
    rows = stage(df.select(*s.keys, *s.order, *[free[n].alias(n) for n in free]))
    bias = metrics.median_bias(rows, s.keys, list(free))
    res = metrics.subtract_bias(rows, stage(bias), s.keys, list(free))
    sq = g.dot(_c(FORCE), _c(FORCE))
    if use_torque:
        sq = sq + g.dot(_c(TORQUE), _c(TORQUE)) / F.lit(0.1**2)
    score = stage(res.select(*s.keys, *s.order, F.sqrt(sq).alias("score")))
    flat = stage(rolling_median(score, s, "score", smooth, "flat") if smooth > 1 else score.withColumn("flat", F.col("score")))
    med = stage(exact_medians(flat, s.keys, {"_med": F.col("flat")}))
    dev = stage(attach(flat, med, s.keys).withColumn("_dev", F.abs(F.col("flat") - F.col("_med"))))
    mad = exact_medians(dev, s.keys, {"_mad": F.col("_dev")})
    spread = F.when(F.col("_mad") == 0, F.lit(1e-9)).otherwise(F.col("_mad"))
    mask = attach(dev, stage(mad), s.keys).withColumn("free", F.col("flat") <= F.col("_med") + F.lit(k * 1.4826) * spread)
    mask = stage(mask.select(*s.keys, *s.order, "score", "flat", "free"))
    return mask, _free_windows(mask, s, min_free_s, erode_s)


def _free_windows(mask: DataFrame, s: Series, min_free_s: float, erode_s: float) -> DataFrame:
    t = F.col(s.ts)
    rows = prev_next(mask.select(*s.keys, *s.order, "free"), s, [s.ts, "free"], "_p").drop("_b")
    rows = stage(rows)
    steps = rows.where("_p is not null").select(*s.keys, (t - F.col(f"_p.{s.ts}")).alias("dt"))
    step = stage(exact_medians(steps, s.keys, {"_dt": F.col("dt")}))
    turn = F.when(F.col("_p.free").eqNullSafe(F.col("free")), 0).otherwise(1).cast("bigint")
    runs = running_sum(rows, s, {"_run": turn, "_rn": F.lit(1).cast("bigint")}).drop("_b").where("free")
    runs = stage(attach(runs.drop("_p"), step, s.keys).withColumn("_dt", F.coalesce("_dt", F.lit(1e7))))
    group = [*s.keys, "_run"]
    margin = F.rint(F.lit(erode_s * 1e9) / F.col("_dt")).cast("bigint")
    tail = F.greatest(F.lit(1).cast("bigint"), F.rint("_dt").cast("bigint"))
    size = runs.groupBy(*group).agg(
        F.min(t).alias("_t0"), F.max(t).alias("_t1"), F.min("_rn").alias("_i"), F.max("_rn").alias("_j"), F.first("_dt").alias("_dt")
    )
    size = size.where((F.col("_t1") + tail - F.col("_t0")) / F.lit(1e9) >= min_free_s)
    if erode_s <= 0:
        return size.select(*s.keys, F.col("_t0").alias("start_ns"), (F.col("_t1") + tail).alias("end_ns"))
    size = size.where(F.col("_j") - F.col("_i") + 1 > 2 * margin)
    inner = attach(runs.drop("_dt"), size, group).where(F.col("_i").isNotNull())
    inner = inner.where((F.col("_rn") >= F.col("_i") + margin) & (F.col("_rn") <= F.col("_j") - margin))
    out = inner.groupBy(*group).agg(F.min(t).alias("start_ns"), F.max(t).alias("_e"), F.first("_dt").alias("_dt"))
    return out.select(*s.keys, "start_ns", (F.col("_e") + tail).alias("end_ns"))


def with_gravity(wrench: DataFrame, poses: DataFrame, s: Series, device_sensor: Sequence[float]) -> DataFrame:
    """Sensor-frame gravity of every wrench sample from the interpolated device pose.

    ``device_sensor`` is the fixed rotation from sensor to device, nine values in row order.
    """
    names = ("_tx", "_ty", "_tz", "_qx", "_qy", "_qz", "_qw")
    side = poses.select(*s.keys, s.ts, *[F.col(c).alias(n) for c, n in zip(("tx", "ty", "tz", "qx", "qy", "qz", "qw"), names)])
    posed = interpolate_pose(wrench, side, s, names=names)
    m = g.quat_to_matrix(_c(names[3:]))
    # Third row of world-from-sensor, which is all that gravity along world z needs.
    down = [g.dot(m[6:9], g.lits([device_sensor[3 * r + c] for r in range(3)])) for c in range(3)]
    return posed.select(*wrench.columns, *[(x * F.lit(-wr.GRAVITY)).alias(n) for x, n in zip(down, GRAV)])


def compensate_wrench(
    wrench: DataFrame, poses: DataFrame, s: Series, device_sensor: Sequence[float], *, mass: float, cog: Sequence[float],
    rate_hz: float, cutoff_hz: float = 15.0, smooth: int = 15, min_free_s: float = 5.0, erode_s: float = 1.0,
) -> DataFrame:
    """External wrench ``ext_*`` and its low-passed ``ext_*_filt``; tool weight and bias come off.

    Biases are fitted per series on its contact-free rows.
    """
    rows = stage(with_gravity(wrench, poses, s, device_sensor))
    mask, _ = contact_free(rows, s, mass=mass, cog=cog, use_torque=False, smooth=smooth, min_free_s=min_free_s, erode_s=erode_s)
    still = rows.join(mask.where("free").select(*s.keys, *s.order), [*s.keys, *s.order], "left_semi")
    params = fits.tool_params_static(still, s.keys, _c(FORCE), _c(TORQUE), _c(GRAV), mass=mass, cog=cog)
    biased = attach(rows, stage(params.select(*s.keys, *fits.F0, *fits.TAU0)), s.keys)
    f, tau = wr.compensate(
        _c(FORCE), _c(TORQUE), _c(GRAV), F.lit(mass), g.lits(cog), _c(fits.F0), _c(fits.TAU0)
    )
    names = [f"ext_{n}" for n in (*FORCE, *TORQUE)]
    ext = stage(biased.select(*wrench.columns, *[c.alias(n) for c, n in zip([*f, *tau], names)]))
    return lowpass(ext, s, names, rate_hz, cutoff_hz=cutoff_hz)


def smoothed_signals(poses: DataFrame, s: Series, windows: tuple[int, int] = (31, 31), orders: tuple[int, int] = (3, 3)) -> DataFrame:
    """First half of G14: device-frame acceleration, angular velocity and angular acceleration at the pose times, under one smoothing.

    ``poses`` has a world pose, device-frame linear velocity ``vx..`` and angular velocity ``ox..``. Velocities are smoothed
    (``windows`` and ``orders``: linear, angular) and differentiated on the true times.
    """
    m = g.quat_to_matrix(_c(("qx", "qy", "qz", "qw")))
    world = g.rotate(m, _c(("vx", "vy", "vz")))
    base = poses.select(*s.keys, s.ts, "qx", "qy", "qz", "qw", "ox", "oy", "oz", *[c.alias(n) for c, n in zip(world, ("vwx", "vwy", "vwz"))])
    sm = stage(savgol(stage(base), s, ["vwx", "vwy", "vwz"], windows[0], orders[0], suffix="_s"))
    sm = stage(savgol(sm, s, ["ox", "oy", "oz"], windows[1], orders[1], suffix="_s"))
    names = ["vwx_s", "vwy_s", "vwz_s", "ox_s", "oy_s", "oz_s"]
    grad = stage(gradient(sm, s, names))
    back = g.rotate(g.transpose(g.quat_to_matrix(_c(("qx", "qy", "qz", "qw")))), _c(("vwx_s_d", "vwy_s_d", "vwz_s_d")))
    return stage(grad.select(
        *s.keys, s.ts, *[c.alias(n) for c, n in zip(back, ("ax", "ay", "az"))],
        *[F.col(f"o{a}_s").alias(f"o{a}") for a in "xyz"], *[F.col(f"o{a}_s_d").alias(f"l{a}") for a in "xyz"],
    ))


def signals_at(times: DataFrame, signals: DataFrame, s: Series, *, device_sensor: Sequence[float], lever: Sequence[float]) -> DataFrame:
    """Second half of G14: smoothed signals interpolated at the rows of ``times`` and moved to the sensor by the fixed ``lever``."""
    at = interpolate_clamped(times, signals, s, ["ax", "ay", "az", "ox", "oy", "oz", "lx", "ly", "lz"])
    r = g.lits(lever)
    om, al = _c(("ox", "oy", "oz")), _c(("lx", "ly", "lz"))
    acc = g.vadd(_c(("ax", "ay", "az")), g.vadd(g.cross(al, r), g.cross(om, g.cross(om, r))))
    turn = g.transpose(g.lits(device_sensor))
    out = {}
    for prefix, v in (("a", acc), ("o", om), ("l", al)):
        out.update({f"{prefix}{a}": c for a, c in zip("xyz", g.rotate(turn, v))})
    return at.select(*times.columns, *[c.alias(n) for n, c in out.items()])


def dynamic_signals(
    poses: DataFrame, wrench_times: DataFrame, s: Series, *, device_sensor: Sequence[float], lever: Sequence[float],
    windows: tuple[int, int] = (31, 31), orders: tuple[int, int] = (3, 3),
) -> DataFrame:
    """Sensor-frame acceleration, angular velocity and angular acceleration at the wrench times."""
    return signals_at(wrench_times, smoothed_signals(poses, s, windows, orders), s, device_sensor=device_sensor, lever=lever)


def motor_calibration(motor: DataFrame, wrench: DataFrame, s: Series, *, tolerance: int = 5_000_000, low: float = wr.CURRENT_MIN_MA, high: float = wr.CURRENT_MAX_MA) -> tuple[DataFrame, DataFrame]:
    """Motor efficiency per series, one number and per current bin.

    ``motor`` has ``position, velocity, effort``; the wrench is taken at the nearest time, its no-contact median
    comes off, and half of its normal force is what one finger pushes.
    """
    hit = stage(asof_join(motor, wrench, s, ["fz"], tolerance=tolerance, how="inner").dropna(subset=["fz"]))
    still = (F.abs("velocity") < 0.1) & (F.abs("effort") < 30)
    bias = stage(metrics.median_bias(hit, s.keys, ["fz"], still))
    rows = metrics.subtract_bias(hit, bias, s.keys, ["fz"])
    alpha = wr.motor_angle(F.col("position"))
    rows = rows.withColumn("x", F.abs(wr.motor_torque(F.col("effort")))).withColumn(
        "y", F.abs(wr.gap_slope(alpha)) * 0.5 * F.abs("fz")
    )
    rows = stage(rows.select(*s.keys, "effort", "x", "y"))
    one = fits.through_origin(rows, s.keys, F.col("x"), F.col("y"))
    return one, fits.binned_slope(rows, s.keys, F.col("effort"), F.col("x"), F.col("y"), low=low, high=high)


@dataclass(frozen=True)
class Smoothing:
    """One smoothing candidate, window length and polynomial order of linear and of angular velocity."""

    linear_window: int = 21
    linear_order: int = 3
    angular_window: int = 21
    angular_order: int = 3


CANDIDATE = "candidate bigint, smoothing int, gyro boolean, offset_ns bigint"


def signal_bank(poses: DataFrame, s: Series, smoothings: Sequence[Smoothing]) -> DataFrame:
    """Signals of all recordings under every smoothing candidate, each computed once: ``smoothing`` numbers them from 0."""
    parts = [
        smoothed_signals(poses, s, (c.linear_window, c.angular_window), (c.linear_order, c.angular_order)).withColumn("smoothing", F.lit(i)) for i, c in enumerate(smoothings)
    ]
    return stage(reduce(DataFrame.unionByName, parts), "signals")


def sweep(
    wrench: DataFrame, bank: DataFrame, s: Series, candidates: DataFrame, *, device_sensor: Sequence[float], lever: Sequence[float], mass: float, cog: Sequence[float], **fit,
) -> DataFrame:
    """The dynamic fit of every (recording, candidate) pair, all in the same rounds.

    ``candidates`` (columns of CANDIDATE, and the series keys where they differ by recording) names a smoothing of ``bank``, whether the
    gyroscopic term is on, and what is added to a wrench time before signals are taken there. Signals are sampled once for each smoothing
    and offset; candidates that share these share the rows. Samples outside of the recording's poses take no part.
    ``wrench`` has force, torque and sensor-frame gravity. Gives the fit of each pair with ``n``, ``n_outside``, ``acc_mean, acc_max, ang_acc_mean,
    ang_acc_max`` (A16) of its signals, and the candidate's columns.
    """
    own = [k for k in s.keys if k in candidates.columns]
    candidates = stage(candidates, "candidates")
    span = bank.groupBy(*s.keys).agg(F.min(s.ts).alias("_first"), F.max(s.ts).alias("_last"))
    pairs = candidates.select(*own, "smoothing", "offset_ns").distinct()
    times = attach(wrench, span, s.keys)
    # Without keys the candidates are a list that somebody wrote.
    side = candidates if own else F.broadcast(candidates)
    times = times.join(pairs, own) if own else times.crossJoin(F.broadcast(pairs))
    times = times.withColumn(s.ts, F.col(s.ts) + F.col("offset_ns")).withColumn("_in", F.coalesce(F.col(s.ts).between(F.col("_first"), F.col("_last")), F.lit(False)))
    series = Series([*s.keys, "smoothing"], s.ts, (), s.cell_ns, s.target_rows)
    taken = stage(signals_at(times.where("_in"), bank, series, device_sensor=device_sensor, lever=lever), "sampled")
    rows = taken.join(side, [*own, "smoothing", "offset_ns"])
    keys = [*s.keys, "candidate"]
    found = fits.tool_params_dynamic(rows, keys, _c(FORCE), _c(TORQUE), _c(GRAV), _c(("ax", "ay", "az")), _c(("ox", "oy", "oz")), _c(("lx", "ly", "lz")), mass=mass, cog=cog, gyro=F.col("gyro"), **fit)
    per = [*s.keys, "smoothing", "offset_ns"]
    acc, ang = g.norm(_c(("ax", "ay", "az"))), g.norm(_c(("lx", "ly", "lz")))
    stats = taken.groupBy(*per).agg(F.avg(acc).alias("acc_mean"), F.max(acc).alias("acc_max"), F.avg(ang).alias("ang_acc_mean"), F.max(ang).alias("ang_acc_max"))
    outside = times.groupBy(*per).agg(F.count(F.when(~F.col("_in"), 1)).alias("n_outside"))
    # One row for every pair, also where no sample is inside.
    every = outside.join(stats, per, "left").join(side, [*own, "smoothing", "offset_ns"])
    return stage(every.join(found, keys, "left").withColumns({"status": F.coalesce("status", F.lit("no usable rows")), "converged": F.coalesce("converged", F.lit(False)), "n": F.coalesce("n", F.lit(0))}), "swept")


def _ranked(swept: DataFrame, smoothings: Sequence[Smoothing]) -> DataFrame:
    """Columns that the rankings look at."""
    sizes = swept.sparkSession.createDataFrame([(i, c.linear_window, c.linear_order) for i, c in enumerate(smoothings)], "smoothing int, window int, order int")
    valid = F.col("converged") & F.coalesce(F.col("inertia_is_spd"), F.lit(False))
    return stage(swept.join(F.broadcast(sizes), "smoothing").withColumns({
        "success": F.col("converged"), "valid": valid, "rms_t": F.col("rmsT"), "rms_f": F.col("rmsF"), "offset_ms": F.col("offset_ns") / 1e6,
    }))


def calibrate(
    wrench: DataFrame, poses: DataFrame, s: Series, smoothings: Sequence[Smoothing], offsets_ns: Sequence[int] = (0,), *, gyro: bool = True, compare_gyro: bool = True,
    device_sensor: Sequence[float], lever: Sequence[float], mass: float, cog: Sequence[float], **fit,
) -> tuple[DataFrame, DataFrame]:
    """Choose smoothing (O6), then gyroscopic term (O7), then time offset (O8) for every recording, each by fits of all candidates.

    Recordings go through together and may choose differently. Returns the chosen fit of each recording and all fits made, with a
    ``step`` of ``smoothing``, ``gyro`` or ``offset``. ``wrench`` has force, torque and sensor-frame gravity; ``poses`` as for ``smoothed_signals``.
    """
    spark = wrench.sparkSession
    bank = signal_bank(poses, s, smoothings)
    fixed = dict(device_sensor=device_sensor, lever=lever, mass=mass, cog=cog, **fit)
    table = spark.createDataFrame([(i, i, gyro, 0) for i in range(len(smoothings))], CANDIDATE)
    runs = [_ranked(sweep(wrench, bank, s, table, **fixed), smoothings)]
    best = stage(selection.best_smoothing(runs[0], s.keys).join(F.broadcast(table), "candidate").select(*s.keys, "smoothing"))

    flags = [False, True] if compare_gyro else [gyro]
    table = best.select(*s.keys, "smoothing", F.explode(F.array(*map(F.lit, flags))).alias("gyro")).withColumns({"candidate": F.col("gyro").cast("bigint"), "offset_ns": F.lit(0).cast("bigint")})
    runs.append(_ranked(sweep(wrench, bank, s, table, **fixed), smoothings))
    if compare_gyro:
        chosen = selection.best_gyro(runs[-1], s.keys)
        best = stage(best.join(chosen, list(s.keys)).select(*s.keys, "smoothing", (F.col("candidate") == 1).alias("gyro")))
    else:
        best = best.withColumn("gyro", F.lit(gyro))

    table = best.select("*", F.posexplode(F.array(*[F.lit(int(o)).cast("bigint") for o in offsets_ns])).alias("candidate", "offset_ns")).withColumn("candidate", F.col("candidate").cast("bigint"))
    runs.append(_ranked(sweep(wrench, bank, s, table, **fixed), smoothings))
    last = selection.best_time_offset(runs[-1], s.keys)
    made = reduce(DataFrame.unionByName, [r.withColumn("step", F.lit(n)) for r, n in zip(runs, ("smoothing", "gyro", "offset"))])
    return runs[-1].join(last, [*s.keys, "candidate"]), made
