"""Writers (S17-S23)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.functions.text import human_size


def write_stream_table(df: DataFrame, path: str, keys: Sequence[str], overwrite: bool = False, fmt: str = "parquet") -> None:
    """Table partitioned by ``keys``.

    An existing table stays unless ``overwrite``; then only the partitions in ``df`` are replaced. Rows are hashed
    over the keys and a spread column first, so a large recording is written by several tasks.
    """
    writer = df.write.partitionBy(*keys).option("maxRecordsPerFile", 5_000_000)
    if overwrite:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite" if overwrite else "ignore").format(fmt).save(path)


def write_partitioned(df: DataFrame, path: str, side: str = "side", seq: str = "seq", overwrite: bool = False) -> None:
    """Tactile sequences by side and sequence."""
    write_stream_table(df, path, [side, seq], overwrite)


def episode_rows(df: DataFrame) -> DataFrame:
    """Columns of an exported episode row."""
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def write_json_report(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Metric tables as JSON lines."""
    df.write.mode("overwrite" if overwrite else "ignore").json(path)


def hand_eye_rows(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Pose rows with the time in seconds."""
    return df.select((F.col(ts) / F.lit(1e9)).alias("t"), "tx", "ty", "tz", "qx", "qy", "qz", "qw")


def write_hand_eye(df: DataFrame, path: str, ts: str = "ts", overwrite: bool = False) -> None:
    """Headerless CSV in time order; range partitioning keeps the order across files."""
    rows = hand_eye_rows(df, ts)
    rows.orderBy("t").write.mode("overwrite" if overwrite else "ignore").csv(path, header=False)


def manifest_rows(artifacts: DataFrame) -> DataFrame:
    """Manifest columns with the readable size."""
    return artifacts.select(
        "relative_path", "artifact_type", "size_bytes", human_size(F.col("size_bytes")).alias("size_human"), "source_relative_path", "note"
    )


def write_manifest(artifacts: DataFrame, path: str) -> None:
    """Manifest in path order; the commit protocol makes the replacement whole or not at all.

    The files are written in order by parallel tasks; a reader that lists them by name sees the sorted manifest.
    """
    manifest_rows(artifacts).orderBy("relative_path").write.mode("overwrite").csv(path, header=True)
