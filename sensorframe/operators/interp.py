"""Interpolation, differences and rates along a series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sensorframe.functions.geometry import dot, slerp_weights, unit
from sensorframe.operators.asof import asof_join, bracket_join
from sensorframe.operators.ordered import Series, chunked, floor_div, prev_next, running_sum
from sensorframe.operators.quantiles import attach, exact_medians
from sensorframe.session import stage


def interpolate_strict(left: DataFrame, source: DataFrame, s: Series, cols: Sequence[str], max_gap_ns: int, source_tie: str | None = None) -> DataFrame:
    """Linear between the rows around each time; null unless both exist, hold values and are close enough."""
    rows = bracket_join(left, source, s, cols, right_tie=source_tie, prev="_p", nxt="_n")
    span = F.col("_n.ts") - F.col("_p.ts")
    a = F.when(span == 0, F.lit(0.0)).otherwise((F.col(s.ts) - F.col("_p.ts")) / span)
    return rows.select(
        *left.columns,
        *[
            F.when(span <= max_gap_ns, (F.lit(1.0) - a) * F.col(f"_p.{c}") + a * F.col(f"_n.{c}")).alias(c)
            for c in cols
        ],
    )


def interpolate_clamped(left: DataFrame, source: DataFrame, s: Series, cols: Sequence[str]) -> DataFrame:
    """Linear between the rows around each time, the end value outside the source range."""
    rows = bracket_join(left, source, s, cols, prev="_p", nxt="_n")
    span = F.col("_n.ts") - F.col("_p.ts")
    a = (F.col(s.ts) - F.col("_p.ts")) / F.when(span != 0, span)

    def value(c: str) -> Column:
        p, n = F.col(f"_p.{c}"), F.col(f"_n.{c}")
        return F.coalesce(p + a * (n - p), p, n).alias(c)

    return rows.select(*left.columns, *[value(c) for c in cols])


POSE = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")


def interpolate_pose(left: DataFrame, poses: DataFrame, s: Series, *, clamp: bool = True, names: Sequence[str] = POSE, tie: str | None = None) -> DataFrame:
    """W15 (``clamp``) and W16: pose at each time by shortest-path SLERP and linear translation.

    Of repeated pose times the row with the smallest ``tie`` stays, without that column the smallest pose. Without ``clamp`` times outside the trajectory give null, as does a series
    with a single time for any other time.
    """
    first = poses.groupBy(*s.keys, s.ts).agg(F.min(F.struct(*([tie] if tie else []), *names)).alias("_m"))
    first = first.select(*s.keys, s.ts, *[F.col(f"_m.{c}").alias(c) for c in names])
    rows = bracket_join(left, first, s, names, prev="_p", nxt="_n")
    p = F.coalesce("_p", "_n") if clamp else F.col("_p")
    n = F.coalesce("_n", "_p") if clamp else F.col("_n")
    rows = rows.withColumn("_a", p).withColumn("_z", n)
    span = F.col("_z.ts") - F.col("_a.ts")
    w = F.when(span == 0, F.lit(0.0)).otherwise((F.col(s.ts) - F.col("_a.ts")) / span)
    rows = rows.withColumn("_w", w)
    t = [((F.lit(1.0) - F.col("_w")) * F.col(f"_a.{c}") + F.col("_w") * F.col(f"_z.{c}")).alias(c) for c in names[:3]]
    keep = [*left.columns, *names[:3]]
    qn = names[3:]
    rows = rows.select(
        *left.columns, *t, "_w",
        *[x.alias(f"_a{i}") for i, x in enumerate(unit([F.col(f"_a.{c}") for c in qn]))],
        *[x.alias(f"_z{i}") for i, x in enumerate(unit([F.col(f"_z.{c}") for c in qn]))],
    )
    a, z = [F.col(f"_a{i}") for i in range(4)], [F.col(f"_z{i}") for i in range(4)]
    rows = rows.withColumn("_d", dot(a, z))
    ka, kb = slerp_weights(F.col("_d"), F.col("_w"))
    rows = rows.withColumn("_ka", ka).withColumn("_kb", kb)
    rows = rows.select(*keep, *[(F.col("_ka") * x + F.col("_kb") * y).alias(f"_q{i}") for i, (x, y) in enumerate(zip(a, z))])
    return rows.select(*keep, *[x.alias(c) for x, c in zip(unit([F.col(f"_q{i}") for i in range(4)]), qn)])


def uniform_times(extents: DataFrame, start: str, end: str, rate_hz: float, out: str = "ts") -> DataFrame:
    """Times ``start, start + 1/rate, ...`` up to ``end``, as one row each.

    The range is first cut into pieces of a million steps, so a long overlap never becomes one array.
    """
    step = int(1e9 / rate_hz)
    piece = step * 1_000_000
    parts = extents.withColumn("_s", F.explode(F.sequence(F.col(start), F.col(end), F.lit(piece).cast("bigint"))))
    stop = F.least(F.col(end), F.col("_s") + F.lit(piece - step).cast("bigint"))
    return parts.withColumn(out, F.explode(F.sequence(F.col("_s"), stop, F.lit(step).cast("bigint")))).drop("_s")


def guarded_speed(df: DataFrame, s: Series, cols: Sequence[str], max_gap_ns: int | None = 100_000_000, out: str = "speed") -> DataFrame:
    """Norm of the central difference, one-sided at the ends, null next to a gap above ``max_gap_ns``."""
    rows = prev_next(df, s, [s.ts, *cols], "_p", "_n").drop("_b")
    t, pt, nt = F.col(s.ts), F.col(f"_p.{s.ts}"), F.col(f"_n.{s.ts}")
    limit = F.lit(max_gap_ns if max_gap_ns is not None else (1 << 62)).cast("bigint")
    wide = F.greatest(F.coalesce(t - pt, F.lit(0)), F.coalesce(nt - t, F.lit(0))) > limit
    dt = (F.coalesce(nt, t) - F.coalesce(pt, t)) * F.lit(1e-9)
    sq = F.lit(0.0)
    for c in cols:
        here = F.col(c)
        step = F.coalesce(F.col(f"_n.{c}"), F.when(nt.isNull(), here)) - F.coalesce(F.col(f"_p.{c}"), F.when(pt.isNull(), here))
        sq = sq + (step / dt) * (step / dt)
    return rows.withColumn(out, F.when(~wide & (dt > 0), F.sqrt(sq))).drop("_p", "_n")


def gradient(df: DataFrame, s: Series, cols: Sequence[str], suffix: str = "_d", rows: int = 200_000) -> DataFrame:
    """Second-order derivative per second on uneven times, second-order one-sided at the ends."""
    parts = chunked(df, s, 2, 2, rows)
    w = W.partitionBy(*s.keys, "_chunk").orderBy("rn")
    sec = 1e9

    def d(to: int, frm: int) -> Column:
        def at(k):
            return F.col(s.ts) if k == 0 else (F.lead(s.ts, k).over(w) if k > 0 else F.lag(s.ts, -k).over(w))
        return (at(to) - at(frm)) / F.lit(sec)

    def v(c: str, k: int) -> Column:
        return F.col(c) if k == 0 else (F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w))

    def edge(c: str, sign: int) -> Column:
        # Derivative at one end of the parabola through three consecutive rows.
        h1 = d(1, 0) if sign > 0 else d(0, -1)
        h2 = d(2, 1) if sign > 0 else d(-1, -2)
        a = -(F.lit(2.0) * h1 + h2) / (h1 * (h1 + h2))
        b = (h1 + h2) / (h1 * h2)
        e = -h1 / (h2 * (h1 + h2))
        return F.lit(float(sign)) * (a * v(c, 0) + b * v(c, sign) + e * v(c, 2 * sign))

    hl, hr = d(0, -1), d(1, 0)
    out = parts
    news = []
    for c in cols:
        inner = (hl * hl * v(c, 1) + (hr * hr - hl * hl) * F.col(c) - hr * hr * v(c, -1)) / (hl * hr * (hl + hr))
        news.append(
            F.when(d(0, -1).isNull(), edge(c, 1)).when(d(1, 0).isNull(), edge(c, -1)).otherwise(inner).alias(c + suffix)
        )
    out = parts.select("*", *news).where(~F.col("_halo"))
    return out.select(*df.columns, *[c + suffix for c in cols])


def rolling_median(df: DataFrame, s: Series, col: str, k: int = 15, out: str = "smooth", rows: int = 200_000) -> DataFrame:
    """Centred median of an odd number of rows; the end values repeat beyond the ends."""
    k = max(1, int(k) | 1)
    h = k // 2
    parts = chunked(df, s, h, h, max(rows, k))
    w = W.partitionBy(*s.keys, "_chunk").orderBy("rn").rowsBetween(-h, h)
    arr = F.collect_list(col).over(w)
    rows_out = parts.withColumn("_arr", arr).where(~F.col("_halo"))
    head = F.greatest(F.lit(0), F.lit(h) - F.col("rn")).cast("int")
    tail = (F.lit(k) - F.size("_arr") - head).cast("int")
    full = F.concat(
        F.array_repeat(F.element_at("_arr", 1), head), F.col("_arr"), F.array_repeat(F.element_at("_arr", -1), tail)
    )
    return rows_out.withColumn(out, F.element_at(F.sort_array(full), h + 1)).select(*df.columns, out)


def forward_window_mean(df: DataFrame, s: Series, value: Column, width_ns: int) -> DataFrame:
    """Mean of ``value`` over ``[t, t + width)`` for each row, with the row count ``n`` and last time ``last_ts``.

    Running sums restart in every cell of ``width``, so a window is the rest of its own cell plus the start of the
    next one: no frame is rescanned, however many rows a window holds.
    """
    cell = floor_div(F.col(s.ts), width_ns)
    cells = [*s.keys, "_w"]
    base = df.withColumn("_w", cell).withColumn("_x", value)
    inner = replace(s, keys=cells)
    sums = running_sum(
        base, inner,
        {"_sx": F.coalesce("_x", F.lit(0.0)), "_nx": F.when(F.col("_x").isNotNull(), 1).otherwise(0).cast("bigint"),
         "_nr": F.lit(1).cast("bigint")},
    )
    sums = stage(sums.drop("_b"))
    total = sums.groupBy(*cells).agg(
        F.sum(F.coalesce("_x", F.lit(0.0))).alias("_tx"), F.count("_x").alias("_tn"), F.count("*").alias("_tr")
    )
    probe = attach(sums, total, cells).withColumn("_end", F.col(s.ts) + F.lit(width_ns - 1).cast("bigint"))
    ref = sums.select(
        *s.keys, s.ts, F.col("_w").alias("_w2"), F.col("_sx").alias("_sx2"), F.col("_nx").alias("_nx2"),
        F.col("_nr").alias("_nr2"),
    )
    hit = asof_join(
        probe, ref, replace(s, ts="_end", tie=()), ["_w2", "_sx2", "_nx2", "_nr2"], direction="backward",
        right_ts=s.ts, right_tie="_nr2", matched_ts="last_ts",
    )
    spill = F.when(F.col("_w2") == F.col("_w") + 1, F.lit(1)).otherwise(F.lit(0))
    own_x = F.col("_tx") - F.col("_sx") + F.coalesce("_x", F.lit(0.0))
    own_n = F.col("_tn") - F.col("_nx") + F.when(F.col("_x").isNotNull(), 1).otherwise(0)
    n_x = own_n + spill * F.col("_nx2")
    return hit.select(
        *df.columns,
        F.when(n_x > 0, (own_x + spill * F.col("_sx2")) / n_x).alias("mean"),
        (F.col("_tr") - F.col("_nr") + 1 + spill * F.col("_nr2")).alias("n"),
        "last_ts",
    )


def best_window(df: DataFrame, s: Series, error: Column, value: Column, width_ns: int = 1_000_000_000) -> DataFrame:
    """Per key the first window of least mean error with two rows or more, and value mean/std inside it."""
    rows = forward_window_mean(df, s, error, width_ns)
    rows = stage(rows)
    ok = rows.where((F.col("n") >= 2) & F.col("mean").isNotNull())
    best = ok.groupBy(*s.keys).agg(
        F.min_by(F.struct(F.col(s.ts).alias("start_ns"), F.col("last_ts").alias("end_ns"), F.col("mean").alias("error")),
                 F.struct(F.col("mean"), F.col(s.ts))).alias("_b")
    ).select(*s.keys, "_b.*")
    inside = attach(df, best, s.keys).where(F.col(s.ts).between(F.col("start_ns"), F.col("end_ns")))
    return inside.groupBy(*s.keys, "start_ns", "end_ns", "error").agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )


def moving_average3(df: DataFrame, s: Series, col: str, out: str = "smooth", low: float = 0.0, high: float = 80.0) -> DataFrame:
    """Clamp, then the mean of the last three values with zeros in front of the first."""
    clamp = F.greatest(F.least(F.col(col), F.lit(high)), F.lit(low))
    parts = chunked(df.withColumn("_c", clamp), s, 2, 0)
    w = W.partitionBy(*s.keys, "_chunk").orderBy("rn").rowsBetween(-2, 0)
    return parts.withColumn(out, F.sum("_c").over(w) / 3.0).where(~F.col("_halo")).select(*df.columns, out)


def display_duration(df: DataFrame, s: Series, out: str = "duration_s") -> DataFrame:
    """Time to the next row (at least 1 ns); null on the last row, 1/30 s when the key has one row."""
    rows = prev_next(df, s, [s.ts], "_p", "_n").drop("_b")
    step = F.greatest(F.col(f"_n.{s.ts}") - F.col(s.ts), F.lit(1).cast("bigint")) / F.lit(1e9)
    only = F.col("_p").isNull() & F.col("_n").isNull()
    return rows.withColumn(out, F.when(only, F.lit(1 / 30.0)).when(F.col("_n").isNotNull(), step)).drop("_p", "_n")


def sampling_rate(df: DataFrame, s: Series) -> DataFrame:
    """``rate_mean`` (1e9 / mean step, 30 when not positive) and ``rate_median`` (1e9 / median step)."""
    steps = prev_next(df.select(*s.keys, *s.order), s, [s.ts], "_p").where(F.col("_p").isNotNull())
    steps = stage(steps.select(*s.keys, (F.col(s.ts) - F.col(f"_p.{s.ts}")).alias("dt")))
    mean = steps.groupBy(*s.keys).agg(F.avg("dt").alias("_m"))
    med = exact_medians(steps, s.keys, {"_q": F.col("dt")})
    out = attach(mean, med, s.keys)
    return out.select(
        *s.keys,
        F.when(F.col("_m") > 0, F.lit(1e9) / F.col("_m")).otherwise(F.lit(30.0)).alias("rate_mean"),
        (F.lit(1e9) / F.when(F.col("_q") > 0, F.col("_q"))).alias("rate_median"),
    )
