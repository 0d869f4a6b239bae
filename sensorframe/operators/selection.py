"""Choosing rows: candidates, keyframes, matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sensorframe.operators.ordered import Series, number_rows
from sensorframe.operators.quantiles import attach, exact_medians, exact_quantiles
from sensorframe.session import stage


def _prefer(df: DataFrame, keys: Sequence[str], good: Column) -> DataFrame:
    """Rows that are good, or all rows of a group without any good one."""
    has = df.groupBy(*keys).agg(F.max(F.when(good, 1).otherwise(0)).alias("_has"))
    return attach(df, has, keys).where((F.col("_has") == 0) | F.coalesce(good, F.lit(False))).drop("_has")


def best_smoothing(candidates: DataFrame, keys: Sequence[str], cand: str = "candidate") -> DataFrame:
    """Successful, without outlying acceleration peaks, within 5 % of the best torque error; least error first.

    Columns: ``success, acc_max, ang_acc_max, rms_t, rms_f, window, order``.
    """
    pool = stage(_prefer(candidates, keys, F.col("success")))
    med = exact_medians(pool, keys, {"_ma": F.col("acc_max"), "_mg": F.col("ang_acc_max")})
    pool = attach(pool, med, keys)
    stable = (F.col("acc_max") <= 3.0 * F.col("_ma")) & (F.col("ang_acc_max") <= 3.0 * F.col("_mg"))
    pool = stage(_prefer(pool, keys, stable))
    low = pool.groupBy(*keys).agg(F.min("rms_t").alias("_low"))
    near = attach(pool, low, keys).where(F.col("rms_t") <= 1.05 * F.col("_low"))
    order = F.struct("rms_t", "rms_f", -F.col("window"), "order", cand)
    return near.groupBy(*keys).agg(F.min_by(cand, order).alias(cand))


def best_gyro(candidates: DataFrame, keys: Sequence[str], cand: str = "candidate", tolerance: float = 1e-4) -> DataFrame:
    """The fit with the gyroscopic term only when valid and clearly better in torque error.

    Columns: ``gyro, valid, rms_t, rms_f``.
    """
    def pick(c: str, flag: bool) -> Column:
        return F.max(F.when(F.col("gyro") == flag, F.col(c)))

    g = candidates.groupBy(*keys).agg(
        *[pick(c, f).alias(f"_{c}_{'y' if f else 'n'}") for f in (True, False) for c in (cand, "valid", "rms_t", "rms_f")]
    )
    vy, vn = F.col("_valid_y"), F.col("_valid_n")
    lower = F.struct("_rms_t_y", "_rms_f_y") < F.struct(F.col("_rms_t_n").alias("_rms_t_y"), F.col("_rms_f_n").alias("_rms_f_y"))
    use = (
        F.when(vn & ~vy, False).when(vy & ~vn, True).when(~vy & ~vn, lower)
        .otherwise(F.col("_rms_t_n") - F.col("_rms_t_y") > tolerance)
    )
    return g.select(*keys, F.when(use, F.col(f"_{cand}_y")).otherwise(F.col(f"_{cand}_n")).alias(cand))


def best_time_offset(candidates: DataFrame, keys: Sequence[str], cand: str = "candidate", tolerance: float = 1e-4) -> DataFrame:
    """Within ``tolerance`` of the best torque error take no offset if possible, else the least error.

    Columns: ``valid, offset_ms, rms_t, rms_f, n``.
    """
    pool = stage(_prefer(candidates, keys, F.col("valid")))
    low = pool.groupBy(*keys).agg(F.min("rms_t").alias("_low"))
    near = attach(pool, low, keys).where(F.col("rms_t") <= F.col("_low") + tolerance)
    off = F.abs("offset_ms")
    order = F.struct((off >= 1e-12).alias("a"), F.col("rms_t"), off.alias("b"), F.col("rms_f"), -F.col("n"), F.col(cand))
    return near.groupBy(*keys).agg(F.min_by(cand, order).alias(cand))


def merge_configs(configs: DataFrame, keys: Sequence[str], rank: str) -> DataFrame:
    """First configuration per key in the given order."""
    rest = [c for c in configs.columns if c not in keys]
    return configs.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_r")).select(*keys, "_r.*")


def even_keyframes(df: DataFrame, s: Series, k: int) -> DataFrame:
    """Every ``n // k``-th row of a series and its last one."""
    n = df.groupBy(*s.keys).agg(F.count("*").alias("_n"))
    rows = attach(number_rows(df, s, "_i").drop("_b"), n, s.keys)
    step = F.greatest(F.floor(F.col("_n") / k), F.lit(1))
    return rows.where((F.col("_i") % step == 0) | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")


def percentile_gate(df: DataFrame, keys: Sequence[str], gates: dict[str, float]) -> DataFrame:
    """Rows at or above the given percentile of every gated column, nulls excluded."""
    qs = exact_quantiles(df, keys, {f"_q_{c}": (F.col(c), p) for c, p in gates.items()})
    rows = attach(df, qs, keys) if keys else df.crossJoin(F.broadcast(qs))
    for c in gates:
        rows = rows.where(F.col(c) >= F.col(f"_q_{c}"))
    return rows.drop(*[f"_q_{c}" for c in gates])


def farthest_points(df: DataFrame, keys: Sequence[str], order: str, vector: str, k: int, every: int = 4) -> DataFrame:
    """``k`` rows per group, each the farthest from those before it; starts at the first by ``order``.

    Groups of at most ``k`` rows are taken whole. Where all that is left equals chosen rows, the first of them by ``order`` follow.

    A round is one aggregate that yields one row per group. Distances are carried along and written out every few
    rounds, so neither the plan nor the work per round grows with ``k``.
    """
    base = df.select(*keys, order, vector)
    size = base.groupBy(*keys).agg(F.count("*").alias("_n"))
    base = stage(attach(base, size, keys))
    # At most k rows per group, so this window is small.
    whole = base.where(F.col("_n") <= k)
    picks = whole.select(*keys, order, (F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1).alias("pick"))
    rows = base.where(F.col("_n") > k).drop("_n").withColumn("_d", F.lit(float("inf")))
    for i in range(k):
        rank = F.struct(F.col("_d"), -F.col(order)) if i else F.struct((-F.col(order)).alias("o"))
        best = rows.where("_d >= 0").groupBy(*keys).agg(F.max_by(F.struct(order, vector), rank).alias("_p"))
        best = stage(best.select(*keys, F.col(f"_p.{order}").alias("_po"), F.col(f"_p.{vector}").alias("_pv")))
        one = best.select(*keys, F.col("_po").alias(order), F.lit(i).alias("pick"))
        picks = picks.unionByName(one)
        if i + 1 == k:
            break
        near = attach(rows, best, keys, written=True)
        dist = F.sqrt(F.aggregate(
            F.zip_with(vector, "_pv", lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2.0))), F.lit(0.0), lambda x, y: x + y
        ))
        chosen = F.col(order) == F.col("_po")
        rows = near.withColumn("_d", F.when(chosen, -1.0).otherwise(F.least("_d", F.coalesce(dist, F.lit(0.0))))).drop("_po", "_pv")
        if (i + 1) % every == 0:
            rows = stage(rows)
    return picks


def match_by_cue(estimates: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Estimates matched to the first truth item whose cue has their frame range.

    ``estimates`` has ``est_order, start_frame, end_frame``; ``truth`` has ``gt_order, gt_id, cue_start, cue_end``.
    A later estimate of the same truth item replaces an earlier one.
    """
    first = truth.groupBy(*keys, "cue_start", "cue_end").agg(F.min_by("gt_id", "gt_order").alias("gt_id"))
    cond = [F.col("start_frame") == F.col("cue_start"), F.col("end_frame") == F.col("cue_end")]
    side = first.select(*[F.col(k).alias(f"_t_{k}") for k in keys], "cue_start", "cue_end", "gt_id")
    for k in keys:
        cond.append(F.col(k) == F.col(f"_t_{k}"))
    hit = estimates.join(side, cond).drop("cue_start", "cue_end", *[f"_t_{k}" for k in keys])
    rest = [c for c in hit.columns if c not in (*keys, "gt_id")]
    return hit.groupBy(*keys, "gt_id").agg(F.max_by(F.struct(*rest), "est_order").alias("_r")).select(*keys, "gt_id", "_r.*")


def quasi_static(df: DataFrame, keys: Sequence[str], speed: Column, turn: Column, acc: Column, ang_acc: Column) -> DataFrame:
    """P20: rows that move slowly, refined by acceleration; groups the refinement empties keep the slow rows."""
    rows = df.where((speed <= 0.1) & (turn <= 0.2))
    return _prefer(rows, keys, (acc <= 0.5) & (ang_acc <= 1.0))


def face_threshold(area_ratio: Column, low: float, high: float, small: float = 0.005, large: float = 0.05) -> Column:
    """Score threshold by the face's share of the image: ``high`` for small faces, ``low`` for large ones."""
    mid = F.lit(high) + (area_ratio - small) / (large - small) * (low - high)
    return F.when(area_ratio <= small, F.lit(high)).when(area_ratio >= large, F.lit(low)).otherwise(mid)
