"""Exact quantiles of groups of any size.

The built-in ``percentile`` keeps every distinct value of a group in one buffer, so it serves only when a count shows
that every group is small. Otherwise a group's values are spread over narrow value bins around an approximate
quantile; a histogram of the bins tells which bins hold the wanted ranks, and only the values of those are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sensorframe.session import stage

# Most values of one group that may sit in aggregation buffers, all requested quantiles together.
BOUNDED_ROWS = 60_000
# Bins per e-fold of distance from the approximate quantile.
_BINS = 256.0


# Bins of what no distance can be taken of, in order; all others lie between.
_LAST = 1 << 40


def _finite(x: Column) -> Column:
    return F.when(F.abs(x) <= F.lit(1.7976931348623157e308), x)


def _bin(x: Column, center: Column) -> Column:
    """Non-decreasing integer bin of ``x``: fine next to ``center``, logarithmic away from it; infinities and NaN have their own."""
    x = x.cast("double")
    d = x - center
    reach = F.floor(F.log(F.least(F.abs(d), F.lit(1.7976931348623157e308))) * _BINS).cast("bigint") + F.lit(1_000_000)
    last = F.lit(_LAST).cast("bigint")
    inner = F.when(d == 0, F.lit(0).cast("bigint")).when(d > 0, reach).otherwise(-reach)
    return F.when(F.isnan(x), last + 1).when(x == float("inf"), last).when(x == float("-inf"), -last).when(x.isNotNull(), inner)


def _keys_match(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[f"_g_{k}"])
    return cond


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[Column, float]], bounded_rows: int = BOUNDED_ROWS
) -> DataFrame:
    """One row per group with linearly interpolated quantiles, as ``percentile`` gives them.

    NaN ranks above everything, as in ``percentile``; both ways of counting give the same for any values.
    ``wanted`` maps an output name to ``(value, probability)``; null values are ignored, groups without any value
    get null. Use ``exact_medians`` for medians.
    """
    names = list(wanted)
    if not keys:
        keyed = df.withColumn("_all", F.lit(0))
        return exact_quantiles(keyed, ["_all"], wanted, bounded_rows).drop("_all")
    base = df.select(*keys, *[v.alias(f"_v{i}") for i, (v, _) in enumerate(wanted.values())])
    largest = base.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if largest * len(names) <= bounded_rows:
        return base.groupBy(*keys).agg(
            *[F.percentile(f"_v{i}", float(wanted[n][1])).alias(n) for i, n in enumerate(names)]
        )
    base = stage(base, "quantiles")
    heads = base.groupBy(*keys).agg(
        *[F.count(f"_v{i}").alias(f"_n{i}") for i in range(len(names))],
        *[
            F.coalesce(F.percentile_approx(_finite(F.col(f"_v{i}").cast("double")), float(wanted[n][1]), 1000), F.lit(0.0)).alias(f"_c{i}")
            for i, n in enumerate(names)
        ],
    )
    heads = heads.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *[c for c in heads.columns if c not in keys])
    long = base.join(heads, _keys_match(base, heads, keys), "left").select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("q"),
                        F.col(f"_v{i}").cast("double").alias("v"),
                        _bin(F.col(f"_v{i}"), F.col(f"_c{i}")).alias("bin"),
                        ((F.col(f"_n{i}") - 1) * F.lit(float(wanted[n][1]))).alias("rank"),
                    )
                    for i, n in enumerate(names)
                ]
            )
        ).alias("e"),
    ).select(*keys, "e.*").where(F.col("v").isNotNull())
    group = [*keys, "q"]
    below = W.partitionBy(*group).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    # rank is the same for every row of a group and quantile; floor and ceil of it are the wanted order statistics.
    hist = (
        long.groupBy(*group, "bin").agg(F.count("*").alias("m"), F.first("rank").alias("rank"))
        .withColumn("start", F.coalesce(F.sum("m").over(below), F.lit(0)))
        .where((F.ceil("rank") >= F.col("start")) & (F.floor("rank") < F.col("start") + F.col("m")))
        .select(*[F.col(k).alias(f"_g_{k}") for k in group], F.col("bin").alias("_bin"), "start")
    )
    hits = long.join(hist, _keys_match(long, hist, group) & (long["bin"] == hist["_bin"]), "inner").select(
        *group, "bin", "v", "rank", "start"
    )
    # Equal values are merged before the sort, so a value that fills the group costs one row.
    counted = hits.groupBy(*group, "bin", "v").agg(
        F.count("*").alias("m"), F.first("rank").alias("rank"), F.first("start").alias("start")
    )
    upto = W.partitionBy(*group, "bin").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    ranked = counted.withColumn("hi", F.col("start") + F.sum("m").over(upto)).withColumn("lo", F.col("hi") - F.col("m"))
    fl, ce = F.floor("rank"), F.ceil("rank")
    picked = ranked.groupBy(*group).agg(
        F.max(F.when((fl >= F.col("lo")) & (fl < F.col("hi")), F.col("v"))).alias("a"),
        F.max(F.when((ce >= F.col("lo")) & (ce < F.col("hi")), F.col("v"))).alias("b"),
        F.first("rank").alias("rank"),
    )
    frac = F.col("rank") - F.floor("rank")
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(
        F.col("a") * (F.lit(1.0) - frac) + F.col("b") * frac
    )
    wide = picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("q") == i, value)).alias(n) for i, n in enumerate(names)]
    )
    wide = wide.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *names)
    groups = base.select(*keys).distinct()
    return groups.join(wide, _keys_match(groups, wide, keys), "left").select(*keys, *names)


def exact_medians(df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    return exact_quantiles(df, keys, {n: (v, 0.5) for n, v in values.items()})


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], written: bool = False) -> DataFrame:
    """``df`` with the per-group columns of ``stats``.

    The statistics are written first: with a known size Spark broadcasts them when that is small, and ``df`` is not moved. ``written`` says that they come from such a table already.
    """
    if keys and not written:
        stats = stage(stats, "attached")
    side = stats.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *[c for c in stats.columns if c not in keys])
    if not keys:
        # One row of totals: its size is fixed.
        return df.crossJoin(F.broadcast(side))
    return df.join(side, _keys_match(df, side, keys), "left").drop(*[f"_g_{k}" for k in keys])
