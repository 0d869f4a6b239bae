"""Row and column selections of the recordings."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.functions.wrench import closed_position
from sensorframe.operators.ordered import Series, number_rows
from sensorframe.operators.quantiles import attach


def time_range(df: DataFrame, start: int, end: int, ts: str = "ts") -> DataFrame:
    """Rows of a closed time range."""
    return df.where(F.col(ts).between(start, end))


def non_negative(df: DataFrame, ts: str = "ts") -> DataFrame:
    """P5."""
    return df.where(F.col(ts) >= 0)


def every_nth(df: DataFrame, s: Series, n: int) -> DataFrame:
    """First, (n+1)-th, ... row of each series."""
    return number_rows(df, s, "_rn").where(F.col("_rn") % n == 0).drop("_rn", "_b")


def confident(df: DataFrame, col: str = "right_tracking_confidence", limit: float = 0.99) -> DataFrame:
    """P8."""
    return df.where(F.col(col) > limit)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and null are different in Spark; tables hold null only."""
    kinds = dict(df.dtypes)
    return df.select(*[F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in df.columns])


def fill_or_drop(df: DataFrame, fill: dict[str, float] | None = None, required: Sequence[str] | None = None) -> DataFrame:
    """Default values, then rows that hold every required column."""
    out = nan_to_null(df)
    out = out.na.fill(fill) if fill else out
    return out.dropna(subset=list(required)) if required else out


def loaded_motor(df: DataFrame) -> DataFrame:
    """P10: gripper nearly closed, not opening, under load."""
    return df.where((F.col("position") > closed_position()) & (F.col("velocity") >= 0) & (F.abs("effort") > 50))


def any_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with at least one of the columns."""
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in cols]))


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Without the columns whose whole name matches."""
    return df.drop(*[c for c in df.columns if re.fullmatch(pattern, c)])


def rename_select(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The named columns under their new names."""
    return df.select(*[F.col(f"`{a}`").alias(b) for a, b in names.items()])


def within_extent(df: DataFrame, poses: DataFrame, keys: Sequence[str], ts: str = "ts", out: str = "valid") -> DataFrame:
    """Flag of rows inside the time range of their recording's poses."""
    ends = poses.groupBy(*keys).agg(F.min(ts).alias("_t0"), F.max(ts).alias("_t1"))
    rows = attach(df, ends, keys)
    return rows.withColumn(out, F.coalesce(F.col(ts).between(F.col("_t0"), F.col("_t1")), F.lit(False))).drop("_t0", "_t1")


def cut_topics(tables: dict[str, DataFrame], interval: tuple[int, int], ts: str = "ts") -> dict[str, DataFrame]:
    """The same closed interval of several topics."""
    return {name: time_range(df, *interval, ts) for name, df in tables.items()}


def row_at(df: DataFrame, when: int, ts: str = "ts", must: bool = False) -> DataFrame:
    """The row at exactly one time; with ``must`` an absent time is an error at once."""
    out = df.where(F.col(ts) == when).limit(1)
    if must and out.isEmpty():
        raise LookupError(f"no row at {ts} = {when}")
    return out


def suffix_number(name: Column) -> Column:
    """O2: number at the end of a name, for sorting ``window_10`` behind ``window_2``."""
    return F.regexp_extract(name, r"(\d+)$", 1).try_cast("bigint")


def with_extensions(df: DataFrame, extensions: Sequence[str] = ("jpg", "jpeg", "png", "npy"), name: str = "name") -> DataFrame:
    """Files of any of the extensions."""
    return df.where(F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*extensions))


def only_in_first(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """U4: distinct key rows of ``a`` that ``b`` lacks."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_anti")


def in_both(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct key rows of both tables."""
    return a.select(*keys).intersect(b.select(*keys))
