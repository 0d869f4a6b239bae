"""Dataset statistics, articulation cues and keyframes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.operators import intervals, metrics, selection
from sensorframe.operators.asof import asof_join
from sensorframe.operators.ordered import Series, number_rows
from sensorframe.sources import catalog
from sensorframe.session import stage


def dataset_statistics(files: DataFrame, csv_times: DataFrame | None = None) -> DataFrame:
    """Durations per location, by viewpoint and by module, from frame names and (optional) table times.

    ``files`` comes from ``catalog.with_levels``; ``csv_times`` has ``location, path, ts`` of the extracted tables.
    """
    shots = catalog.frames(files).select("location", F.col("dir").alias("path"), "ts", F.lit("frames").alias("kind"))
    if csv_times is not None:
        shots = shots.unionByName(csv_times.where(F.col("ts") >= 0).select("location", "path", "ts", F.lit("csv").alias("kind")))
    per = metrics.stream_durations(shots, ["location", "path", "kind"])
    return metrics.duration_rollup(catalog.classified_streams(per), ["location"])


def frame_index(times: DataFrame, frames: DataFrame, s: Series, stride: int = 1, out: str = "frame") -> DataFrame:
    """Position of the nearest frame, divided by the stride."""
    numbered = stage(number_rows(frames.select(*s.keys, s.ts), s, "_f").drop("_b"))
    return asof_join(times, numbered, s, ["_f"]).withColumn(out, F.floor(F.col("_f") / stride)).drop("_f")


def cue_frames(windows: DataFrame, frames: DataFrame, s: Series, stride: int = 1) -> DataFrame:
    """Windows ``start_ns, end_ns`` with the frame numbers of their ends."""
    from dataclasses import replace

    frames = frames.withColumnRenamed(s.ts, "_ft")
    numbered = stage(number_rows(frames.select(*s.keys, "_ft"), replace(s, ts="_ft", tie=()), "_f").drop("_b"))
    rows = windows
    for end, out in (("start_ns", "cue_start"), ("end_ns", "cue_end")):
        at = replace(s, ts=end, tie=())
        rows = stage(asof_join(rows, numbered, at, ["_f"], right_ts="_ft").withColumn(out, F.floor(F.col("_f") / stride)).drop("_f"))
    return rows


def articulation_matches(estimates: DataFrame, truth_windows: DataFrame, frames: DataFrame, s: Series, stride: int = 1) -> DataFrame:
    """Estimates matched to the truth items whose windows span the same frames.

    ``truth_windows`` has ``gt_order, gt_id, start_ns, end_ns``.
    """
    cues = cue_frames(truth_windows, frames, s, stride)
    return selection.match_by_cue(estimates, cues, s.keys)


def frames_in_windows(frames: DataFrame, windows: DataFrame, s: Series) -> DataFrame:
    """Frames inside any interaction window."""
    return intervals.in_any_window(frames, windows, s)


def keyframes(stats: DataFrame, keys: Sequence[str], order: str, vector: str, k: int) -> DataFrame:
    """Frames that pass the percentile gates, then the ``k`` most different of them.

    ``stats`` has ``keypoints, mean_depth, blur`` and a descriptor per frame.
    """
    gated = stage(selection.percentile_gate(stats, keys, {"keypoints": 0.10, "mean_depth": 0.50, "blur": 0.10}))
    return selection.farthest_points(gated, keys, order, vector, k)
