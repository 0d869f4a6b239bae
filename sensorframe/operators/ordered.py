"""Ordered scans over long keyed series without one task per key.

A plain ``Window.partitionBy(recording)`` sends a whole recording to one task. Everything here instead splits a
series into buckets of bounded row count, works inside each bucket, and passes what crosses a bucket border through
a summary table that has one row per bucket. Buckets are fixed time cells; cells with more rows than
``target_rows`` are cut into narrower ones, so neither a hot key nor a hot cell stays whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sensorframe.session import stage

HOUR_NS = 3_600_000_000_000
DAY_NS = 24 * HOUR_NS
# Most full cells of one level that are broadcast.
HOT_CELLS = 100_000


@dataclass(frozen=True)
class Series:
    """How rows of a table form time series: key columns, ns time column, tie-breakers at equal time.

    Keys and time are never null. ``cell_ns`` should hold a comfortable number of rows at the usual rate; fuller cells
    are cut by themselves.
    """

    keys: Sequence[str]
    ts: str = "ts"
    tie: Sequence[str] = field(default_factory=tuple)
    cell_ns: int = HOUR_NS
    target_rows: int = 1_000_000

    @property
    def order(self) -> list[str]:
        return [self.ts, *self.tie]

    @property
    def part(self) -> list[str]:
        return [*self.keys, "_b"]

    def ordering(self) -> Column:
        cols = self.order
        return F.col(cols[0]) if len(cols) == 1 else F.struct(*cols)

    def inner(self, descending: bool = False):
        order = [F.col(c).desc() if descending else F.col(c).asc() for c in self.order]
        return W.partitionBy(*self.part).orderBy(*order)

    def outer(self):
        return W.partitionBy(*self.keys).orderBy("_b")


def floor_div(col: Column, width: int | Column) -> Column:
    """Integer division rounded down, also below zero (SQL ``div`` truncates)."""
    width = F.lit(width).cast("bigint") if isinstance(width, int) else width
    return F.call_function("div", col - F.pmod(col, width), width)


def bucketed(df: DataFrame, s: Series) -> DataFrame:
    """Add ``_b``, the start time of the row's bucket: at most ``target_rows`` rows of one key share a bucket.

    Buckets start as cells of ``cell_ns`` (rounded up to a power of two). Map-side combined counts find the cells
    that are too full, and those are cut into 64 narrower ones until none is; only rows at one and the same time
    stay together. The counts run at once, so evenly filled series, the usual case, need no join. Up to ``HOT_CELLS``
    full cells per level are broadcast, more are joined by key.
    """
    bits = (s.cell_ns - 1).bit_length()
    ts = F.col(s.ts).cast("bigint")

    def start(b: int) -> Column:
        # Shifting keeps the sign, so this rounds down below zero too.
        return F.shiftleft(F.shiftright(ts, b), b)

    names = [f"_k{i}" for i in range(len(s.keys))]
    rows = df.withColumn("_b", start(bits))
    level = rows
    while bits > 0:
        full = level.groupBy(*s.keys, "_b").agg(F.count("*").alias("_n")).where(F.col("_n") > s.target_rows)
        full = full.select(*[F.col(k).alias(n) for k, n in zip(s.keys, names)], F.col("_b").alias("_fb"))
        found = full.limit(HOT_CELLS + 1).collect()
        if not found:
            break
        if len(found) <= HOT_CELLS:
            full = F.broadcast(df.sparkSession.createDataFrame(found, full.schema))
        bits = max(bits - 6, 0)
        cond = F.col("_b") == F.col("_fb")
        for k, n in zip(s.keys, names):
            cond = cond & (F.col(k) == F.col(n))
        joined = rows.join(full, cond, "left").withColumn("_b", F.when(F.col("_fb").isNotNull(), start(bits)).otherwise(F.col("_b")))
        level = joined.where(F.col("_fb").isNotNull()).select(*s.keys, "_b")
        rows = joined.drop("_fb", *names)
    return rows


def ensure_buckets(df: DataFrame, s: Series) -> DataFrame:
    return df if "_b" in df.columns else bucketed(df, s)


def join_summary(rows: DataFrame, summary: DataFrame, s: Series) -> DataFrame:
    """Attach the per-bucket summary.

    Plain equality on the partition columns of the windows before it, so the rows keep their place and only the
    summary moves.
    """
    renamed = summary.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(s.part)],
        *[c for c in summary.columns if c not in s.part],
    )
    cond = F.lit(True)
    for i, k in enumerate(s.part):
        cond = cond & (rows[k] == renamed[f"_k{i}"])
    return rows.join(renamed, cond, "left").drop(*[f"_k{i}" for i in range(len(s.part))])


def running_sum(df: DataFrame, s: Series, sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums in series order, one output column per entry of ``sums``."""
    df = ensure_buckets(df, s)
    names = list(sums)
    work = df.select("*", *[sums[n].alias(f"_v_{n}") for n in names])
    frame = s.inner().rowsBetween(W.unboundedPreceding, 0)
    local = work.select("*", *[F.sum(f"_v_{n}").over(frame).alias(f"_l_{n}") for n in names])
    before = s.outer().rowsBetween(W.unboundedPreceding, -1)
    summary = (
        work.groupBy(*s.part)
        .agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
        .select(*s.part, *[F.sum(f"_s_{n}").over(before).alias(f"_p_{n}") for n in names])
    )
    joined = join_summary(local, summary, s)
    zero = F.lit(0)
    return joined.select(
        *df.columns,
        *[
            F.when(
                F.col(f"_l_{n}").isNotNull() | F.col(f"_p_{n}").isNotNull(),
                F.coalesce(F.col(f"_l_{n}"), zero) + F.coalesce(F.col(f"_p_{n}"), zero),
            ).alias(n)
            for n in names
        ],
    )


def number_rows(df: DataFrame, s: Series, out: str = "rn") -> DataFrame:
    """Zero-based position of each row in its series."""
    return running_sum(df, s, {out: F.lit(1).cast("bigint")}).withColumn(out, F.col(out) - 1)


def prev_next(df: DataFrame, s: Series, cols: Sequence[str], prev: str | None = "prev", nxt: str | None = None) -> DataFrame:
    """Add struct columns holding ``cols`` of the previous and/or next row of the series (null at its ends)."""
    df = ensure_buckets(df, s)
    row = F.struct(*cols)
    by = s.ordering()
    aggs, picks, news = [], [], []
    if prev:
        news.append(F.lag(row).over(s.inner()).alias("_in_prev"))
        aggs.append(F.max_by(row, by).alias("_last"))
        picks.append(F.lag("_last").over(s.outer()).alias("_x_prev"))
    if nxt:
        news.append(F.lead(row).over(s.inner()).alias("_in_next"))
        aggs.append(F.min_by(row, by).alias("_first"))
        picks.append(F.lead("_first").over(s.outer()).alias("_x_next"))
    summary = df.groupBy(*s.part).agg(*aggs).select(*s.part, *picks)
    out = join_summary(df.select("*", *news), summary, s)
    cols_out = list(df.columns)
    result = []
    if prev:
        result.append(F.coalesce("_in_prev", "_x_prev").alias(prev))
    if nxt:
        result.append(F.coalesce("_in_next", "_x_next").alias(nxt))
    return out.select(*cols_out, *result)


def carry(df: DataFrame, s: Series, value: Column, last: str | None = None, following: str | None = None) -> DataFrame:
    """Fill: ``last`` = latest non-null ``value`` at or before the row, ``following`` = earliest at or after it.

    At equal time the tie-breakers decide what is "before"; the descending pass reverses every tie-breaker.
    """
    df = ensure_buckets(df, s)
    work = df.withColumn("_v", value)
    by = F.when(F.col("_v").isNotNull(), s.ordering())
    aggs, picks, news = [], [], []
    if last:
        frame = s.inner().rowsBetween(W.unboundedPreceding, 0)
        news.append(F.last("_v", ignorenulls=True).over(frame).alias("_in_last"))
        aggs.append(F.max_by("_v", by).alias("_hi"))
        before = s.outer().rowsBetween(W.unboundedPreceding, -1)
        picks.append(F.last("_hi", ignorenulls=True).over(before).alias("_x_last"))
    if following:
        frame = s.inner(descending=True).rowsBetween(W.unboundedPreceding, 0)
        news.append(F.last("_v", ignorenulls=True).over(frame).alias("_in_next"))
        aggs.append(F.min_by("_v", by).alias("_lo"))
        # Descending order turns "every later bucket" into a frame that grows, which stays linear.
        after = W.partitionBy(*s.keys).orderBy(F.col("_b").desc()).rowsBetween(W.unboundedPreceding, -1)
        picks.append(F.last("_lo", ignorenulls=True).over(after).alias("_x_next"))
    summary = work.groupBy(*s.part).agg(*aggs).select(*s.part, *picks)
    out = join_summary(work.select("*", *news), summary, s)
    result = []
    if last:
        result.append(F.coalesce("_in_last", "_x_last").alias(last))
    if following:
        result.append(F.coalesce("_in_next", "_x_next").alias(following))
    return out.select(*df.columns, *result)


def chunked(df: DataFrame, s: Series, before: int, after: int, rows: int = 200_000) -> DataFrame:
    """Cut each series into chunks of ``rows`` consecutive rows with copied borders.

    Adds ``rn`` (global position), ``_chunk`` and ``_halo``. A chunk also holds ``before`` rows in front of it and
    ``after`` rows behind it, marked ``_halo``, so any row frame within these bounds can be read inside one chunk.
    """
    if max(before, after) > rows:
        raise ValueError("chunk must be at least as long as its borders")
    out = number_rows(df, s).drop("_b")
    own = F.call_function("div", F.col("rn"), F.lit(rows).cast("bigint"))
    pos = F.col("rn") % rows
    one = F.lit(1).cast("bigint")
    homes = F.array(
        own,
        F.when((pos >= rows - before) & F.lit(before > 0), own + one),
        F.when((pos < after) & (own > 0) & F.lit(after > 0), own - one),
    )
    return (
        out.withColumn("_own", own)
        .withColumn("_chunk", F.explode(F.array_compact(homes)))
        .withColumn("_halo", F.col("_chunk") != F.col("_own"))
        .drop("_own")
    )


def rolling(df: DataFrame, s: Series, before: int, after: int, exprs, rows: int = 200_000) -> DataFrame:
    """Row-frame columns: ``exprs(window)`` gets a chunk window ordered by ``rn`` and returns aliased columns."""
    parts = chunked(df, s, before, after, rows)
    window = W.partitionBy(*s.keys, "_chunk").orderBy("rn")
    return parts.select("*", *exprs(window)).where(~F.col("_halo")).drop("_chunk", "_halo")


def place_in_group(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """``out``: position of each row in its group, from 0, by any sortable columns; a group of any size is spread over tasks.

    Rows are sorted by range and numbered inside each range; the sizes of the ranges before and the first position of the group
    do the rest. Rows that are equal in all of ``group`` and ``order`` come in any order.
    """
    ids = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_m", F.monotonically_increasing_id())
    rows = stage(ids.withColumn("_part", F.shiftright("_m", 33)).withColumn("_at", F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m"), "places")
    # One row per range.
    sizes = rows.groupBy("_part").agg(F.max("_at").alias("_last"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    begin = stage(sizes.select("_part", F.coalesce(F.sum(F.col("_last") + 1).over(before), F.lit(0)).alias("_begin")), "ranges")
    placed = rows.join(begin, "_part").withColumn("_pos", F.col("_begin") + F.col("_at")).drop("_part", "_at", "_begin")
    first = stage(placed.groupBy(*group).agg(F.min("_pos").alias("_first")), "firsts")
    same = reduce(lambda a, k: a & placed[k].eqNullSafe(first[k]), group, F.lit(True))
    return placed.join(first, same).select(*[placed[c] for c in df.columns], (F.col("_pos") - F.col("_first")).alias(out))
