"""Clock alignment, cropping and interaction splitting (L1-L4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.functions.timecols import is_action_code
from sensorframe.operators import intervals
from sensorframe.operators.offsets import (
    apply_delta, chain_delta, collapse_detections, event_pair_delta, first_detection, offset_cascade, robust_offset,
)
from sensorframe.operators.ordered import Series, number_rows
from sensorframe.operators.quantiles import attach
from sensorframe.session import stage


def _against_reference(offsets: DataFrame, outer: Sequence[str], reference: str) -> DataFrame:
    """Offset of each sensor minus the offset of the reference sensor of its recording."""
    ref = offsets.where(F.col("sensor") == reference).select(*outer, F.col("offset_ns").alias("_ref"))
    return attach(offsets, ref, outer).withColumn("delta", F.col("offset_ns") - F.col("_ref")).drop("_ref")


def _finish(offsets: DataFrame, event_pairs: DataFrame | None, outer: Sequence[str], reference: str) -> DataFrame:
    known = stage(_against_reference(offsets, outer, reference))
    out = known.select(*outer, "sensor", "method", "delta")
    if event_pairs is None:
        return out
    chained = chain_delta(known.where(F.col("delta").isNotNull()), event_pair_delta(event_pairs, [*outer, "sensor_1", "sensor_2"]), outer)
    chained = chained.select(*outer, "sensor", F.col("delta").alias("_chained"))
    return attach(out, chained, [*outer, "sensor"]).select(
        *outer, "sensor", "method", F.coalesce("delta", "_chained").alias("delta")
    )


def align_first_pair(detections: DataFrame, sensors: DataFrame, outer: Sequence[str], reference: str, event_pairs: DataFrame | None = None) -> DataFrame:
    """L1: delta of every sensor from its first valid detection, by event pairs where none was decoded."""
    keys = [*outer, "sensor"]
    first = first_detection(detections, keys)
    off = attach(sensors.select(*keys), first, keys).select(
        *keys, (F.col("qr_ts") - F.col("device_ts")).alias("offset_ns"),
        F.when(F.col("qr_ts").isNotNull(), "first").otherwise("manual").alias("method"),
    )
    return _finish(off, event_pairs, outer, reference)


def align_high_precision(
    detections: DataFrame, sensors: DataFrame, outer: Sequence[str], reference: str,
    event_pairs: DataFrame | None = None, min_pairs: int = 2, multiplier: float = 3.5,
) -> DataFrame:
    """L2: delta of every sensor from all its detections, with the fallbacks of ``offset_cascade``.

    ``sensors`` may carry ``first_device_ts`` and ``first_qr_ts`` of an earlier run.
    """
    keys = [*outer, "sensor"]
    for c in ("first_device_ts", "first_qr_ts"):
        if c not in sensors.columns:
            sensors = sensors.withColumn(c, F.lit(None).cast("bigint"))
    pairs = stage(collapse_detections(detections.where(F.col("qr_ts").isNotNull()), keys))
    off = offset_cascade(robust_offset(pairs, keys, multiplier), sensors, keys, min_pairs)
    return _finish(off, event_pairs, outer, reference)


def apply_and_crop(samples: DataFrame, deltas: DataFrame, outer: Sequence[str], ts: str = "ts") -> DataFrame:
    """L3: shift every stream by its sensor's delta and keep the closed time range all sensors share."""
    shifted = apply_delta(samples, deltas, [*outer, "sensor"], ts)
    _, common = intervals.shared_window(shifted.where(F.col(ts) >= 0), outer, "sensor", ts)
    common = common.where("valid").drop("valid")
    return attach(shifted, common, outer).where(F.col(ts).between(F.col("start_ns"), F.col("end_ns"))).drop("start_ns", "end_ns")


def split_interactions(
    detections: DataFrame, frames_extent: DataFrame, outer: Sequence[str], s: Series, *, eps_ns: int = 500_000_000,
    min_s: float = 3.0,
) -> DataFrame:
    """L4: interaction windows per recording from the first source with enough action-code blocks.

    ``detections`` has ``payload`` and the series keys ``[*outer, "sensor"]``; ``frames_extent`` the frame range per
    source as ``first_ns`` and ``last_ns``.
    """
    hits = detections.where(is_action_code(F.col("payload")))
    blocks = stage(intervals.detection_blocks(hits, s, eps_ns))
    counts = blocks.groupBy(*s.keys).agg(F.count("*").alias("n_blocks"))
    chosen = intervals.source_precedence(counts, outer, "sensor", "n_blocks", 3)
    blocks = blocks.join(chosen, [*outer, "sensor"], "left_semi")
    return intervals.interaction_windows(blocks, frames_extent, s, min_s=min_s)


def renumber_confirmed(windows: DataFrame, confirmed: DataFrame, s: Series) -> DataFrame:
    """F32: keep the confirmed windows and number them again from zero, with label and index of the confirmation.

    ``confirmed`` has the keys, ``name``, ``single_word_description`` and ``index``.
    """
    kept = windows.join(confirmed, [*s.keys, "name"])
    out = number_rows(stage(kept), Series(s.keys, ts="start_ns", tie=("end_ns",), cell_ns=s.cell_ns), "_i").drop("_b")
    return out.withColumn("name", F.concat(F.lit("window_"), F.col("_i"))).drop("_i")
