"""Clock offsets from matched detections."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.operators.ordered import Series, number_rows
from sensorframe.operators.quantiles import attach, exact_medians
from sensorframe.session import stage


def _truncate(base: Column, shifted: Column) -> Column:
    """``base + shifted`` cut toward zero, without passing the sum through a double."""
    low = F.floor(shifted).cast("bigint")
    v = base + low
    return F.when((v < 0) & (shifted > low), v + 1).otherwise(v)


def integer_medians(df: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """Median of a BIGINT column cut toward zero.

    Values are taken relative to the group minimum: near 1.7e18 a double is only good to 256 ns.
    """
    base = df.groupBy(*keys).agg(F.min(value).alias("_base"))
    rel = attach(df.withColumn("_val", value).select(*keys, "_val"), base, keys)
    med = exact_medians(rel, keys, {"_m": F.col("_val") - F.col("_base")})
    return attach(base, med, keys).select(*keys, _truncate(F.col("_base"), F.col("_m")).alias(out))


def collapse_detections(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A3: one row per decoded time, its device time the median of the sightings."""
    return integer_medians(df, [*keys, "qr_ts"], F.col("device_ts"), "device_ts")


def robust_offset(pairs: DataFrame, keys: Sequence[str], multiplier: float = 3.5) -> DataFrame:
    """A4: median offset ``qr_ts - device_ts``, refined to the offsets within ``multiplier`` deviations of it.

    With fewer than three pairs or no spread the plain median stands.
    """
    off = stage(pairs.select(*keys, (F.col("qr_ts") - F.col("device_ts")).alias("_off")))
    med = integer_medians(off, keys, F.col("_off"), "_med")
    count = off.groupBy(*keys).agg(F.count("*").alias("n_pairs"))
    head = stage(attach(count, med, keys))
    dev = stage(attach(off, head, keys).withColumn("_dev", F.abs(F.col("_off") - F.col("_med"))))
    mad = stage(integer_medians(dev, keys, F.col("_dev"), "_mad"))
    inliers = stage(attach(dev, mad, keys).where(F.col("_dev") <= F.lit(multiplier) * F.col("_mad")).select(*keys, "_off"))
    fine = integer_medians(inliers, keys, F.col("_off"), "_fine")
    out = attach(attach(head, mad, keys), fine, keys)
    plain = (F.col("n_pairs") < 3) | (F.col("_mad") == 0)
    return out.select(
        *keys, "n_pairs", F.when(plain, F.col("_med")).otherwise(F.coalesce("_fine", "_med")).alias("offset_ns")
    )


def first_detection(df: DataFrame, keys: Sequence[str], ts: str = "device_ts") -> DataFrame:
    """O3: earliest valid detection of each key as ``device_ts, qr_ts``."""
    ok = df.where(F.col("qr_ts").isNotNull())
    return ok.groupBy(*keys).agg(F.min(ts).alias(ts), F.min_by("qr_ts", ts).alias("qr_ts"))


def limit_unique(df: DataFrame, s: Series, k: int) -> DataFrame:
    """Detections in time order until ``k`` different decoded times have been seen."""
    seen = df.groupBy(*s.keys, "qr_ts").agg(F.min(s.ts).alias("_seen"))
    rank = number_rows(stage(seen), replace(s, ts="_seen", tie=("qr_ts",)), "_rank")
    cut = rank.where(F.col("_rank") == k - 1).select(*s.keys, F.col("_seen").alias("_cut"))
    return attach(df, cut, s.keys).where(F.col("_cut").isNull() | (F.col(s.ts) <= F.col("_cut"))).drop("_cut")


def offset_cascade(robust: DataFrame, stored: DataFrame, keys: Sequence[str], min_pairs: int = 2) -> DataFrame:
    """Robust offset, single pair, stored first pair, or ``manual`` when nothing was seen.

    ``stored`` has one row per sensor with nullable ``first_device_ts`` and ``first_qr_ts``. One pair is its own
    median, so both detection branches read the same column.
    """
    out = attach(stored, robust, keys)
    n = F.coalesce("n_pairs", F.lit(0))
    first = F.col("first_qr_ts") - F.col("first_device_ts")
    return out.select(
        *keys,
        F.when((n >= min_pairs) | (n == 1), F.col("offset_ns")).otherwise(first).alias("offset_ns"),
        F.when(n >= min_pairs, "robust").when(n == 1, "single").when(first.isNotNull(), "stored").otherwise("manual").alias("method"),
    )


def event_pair_delta(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A5: median of ``ts_1 - ts_2`` per sensor pair, cut toward zero."""
    return integer_medians(pairs, keys, F.col("ts_1") - F.col("ts_2"), "pair_delta")


def chain_delta(deltas: DataFrame, pair_deltas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delta of ``sensor_2`` through ``sensor_1``; ``deltas`` has ``(keys, sensor, delta)``."""
    known = deltas.select(*keys, F.col("sensor").alias("sensor_1"), F.col("delta").alias("_d1"))
    out = pair_deltas.join(known, [*keys, "sensor_1"])
    return out.select(*keys, F.col("sensor_2").alias("sensor"), (F.col("_d1") + F.col("pair_delta")).alias("delta"))


def apply_delta(df: DataFrame, deltas: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Shift every row by its sensor's delta; sensors without one stay as they are."""
    side = deltas.select(*keys, F.col("delta").alias("_delta"))
    return attach(df, side, keys).withColumn(ts, F.col(ts) + F.coalesce("_delta", F.lit(0))).drop("_delta")
