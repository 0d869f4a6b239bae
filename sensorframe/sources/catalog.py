"""Recording catalog from file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.functions.text import glob_match, interaction_index, is_recording_name, sensor_module, viewpoint

# Which recorder folders belong to which kind of interaction.
RECORDER_TYPES = (
    ("gripper", "aria_gripper"), ("gripper", "aria_human"), ("hand", "aria_human"), ("spot", "aria_spot"), ("umi", "aria_human"),
    ("wrist", "aria_human"), ("wrist", "aria_wrist"), ("gripper", "iphone_*"), ("hand", "iphone_*"), ("spot", "iphone_*"),
    ("umi", "iphone_*"), ("wrist", "iphone_*"), ("spot", "spot"), ("umi", "umi_gripper"), ("gripper", "gripper"),
    ("hand", "gripper"), ("wrist", "gripper"),
)
# Folder names of image and sensor streams.
IMAGE_DIRS = ("camera_rgb", "image_raw_color")
SENSOR_DIRS = ("digit", "joint_states", "wrench", "imu", "depth_registered", "telemetry", "camera_depth")
_STAMPED = r"(?i)^\d+\.(png|jpe?g|npy)$"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Path, size and time of every file under ``root``; contents are never read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return df.select("path", F.col("length").alias("size"), "modificationTime")


def with_levels(files: DataFrame, root: str) -> DataFrame:
    """Path relative to ``root`` with its levels location / interaction / recorder and the file name."""
    base = root.rstrip("/") + "/"
    rel = F.regexp_replace(F.substring_index(F.col("path"), base, -1), r"^/+", "")
    rows = files.withColumn("rel", rel).withColumn("_p", F.split("rel", "/"))
    return rows.select(
        *files.columns, "rel", F.get("_p", F.lit(0)).alias("location"), F.get("_p", F.lit(1)).alias("interaction"),
        F.get("_p", F.lit(2)).alias("recorder"), F.get("_p", F.lit(3)).alias("entry"), F.element_at("_p", -1).alias("name"),
        F.regexp_replace("rel", r"/[^/]*$", "").alias("dir"), F.size("_p").alias("depth"),
    )


def known_recorder(interaction: Column, recorder: Column) -> Column:
    """The pair matches one of the recorder types, a fixed list small enough to be a condition."""
    out = F.lit(False)
    for inter, pattern in RECORDER_TYPES:
        out = out | ((interaction == inter) & glob_match(recorder, pattern))
    return out


def catalog(files: DataFrame) -> DataFrame:
    """One row per recorder folder and interaction index; ``files`` comes from ``with_levels``.

    The index is read off entries directly in the recorder folder that carry a recording name.
    """
    rows = files.where((F.col("depth") >= 4) & known_recorder(F.col("interaction"), F.col("recorder")))
    rows = rows.where(is_recording_name(F.col("entry"))).withColumn("interaction_index", interaction_index(F.col("entry")))
    path = F.concat_ws("/", "location", "interaction", "recorder")
    return rows.where(F.col("interaction_index").isNotNull()).select(
        "location", "interaction", "recorder", "interaction_index", path.alias("path")
    ).distinct()


def recorders(files: DataFrame) -> DataFrame:
    """Distinct recorder folders."""
    rows = files.where((F.col("depth") >= 4) & known_recorder(F.col("interaction"), F.col("recorder")))
    return rows.select("location", "interaction", "recorder").distinct()


def query_catalog(cat: DataFrame, location: str | None = None, interaction: str | None = None, recorder: str | None = None, index: str | None = None) -> DataFrame:
    """Rows of the catalog; recorder and index without a wildcard match as prefixes."""
    if location:
        cat = cat.where(F.col("location") == location)
    if interaction:
        cat = cat.where(F.col("interaction") == interaction)
    if recorder:
        cat = cat.where(glob_match(F.col("recorder"), recorder, open_end=True))
    if index is not None:
        cat = cat.where(glob_match(F.col("interaction_index"), index, open_end=True))
    return cat


def container_files(files: DataFrame, selected: DataFrame) -> DataFrame:
    """S3: raw device containers under the selected recorder folders, each once."""
    good = F.col("name").endswith(".vrs") & ~F.col("name").startswith("._")
    return files.where(good).join(selected.select("location", "interaction", "recorder").distinct(), ["location", "interaction", "recorder"], "left_semi").select("path").distinct()


def extracted_streams(files: DataFrame, image_streams: bool = False, sensor_streams: bool = False) -> DataFrame:
    """Stream folders: ``csv`` where a folder holds a ``data.csv``, ``frames`` where it holds timestamped files.

    With a flag only folders of that kind's names count; with both flags folders of either kind do.
    """
    last = F.element_at(F.split("dir", "/"), -1)
    names = (IMAGE_DIRS if image_streams else ()) + (SENSOR_DIRS if sensor_streams else ())
    rows = files.withColumn("_n", F.lower("name"))
    if names:
        rows = rows.where(last.isin(*names))
    if sensor_streams:
        deep = F.col("path").contains("camera_depth") & (F.col("path").contains("aria") | F.col("path").contains("umi"))
        rows = rows.where(~deep)
    per = rows.groupBy("dir").agg(
        F.bool_or(F.col("_n") == "data.csv").alias("_csv"), F.bool_or(F.col("_n").rlike(_STAMPED)).alias("_frames")
    )
    kinds = F.filter(F.array(
        F.when(F.col("_csv") & F.lit(sensor_streams or not image_streams), "csv"), F.when(F.col("_frames"), "frames")
    ), lambda k: k.isNotNull())
    out = per.select(F.col("dir"), F.explode(kinds).alias("kind"))
    return out.withColumn("path", F.when(F.col("kind") == "csv", F.concat("dir", F.lit("/data.csv"))).otherwise(F.col("dir")))


def classified_streams(streams: DataFrame) -> DataFrame:
    """Viewpoint, module and sensor of every stream."""
    v = viewpoint(F.col("path"))
    return streams.select("*", v["viewpoint"].alias("viewpoint"), v["module"].alias("module"), sensor_module(F.col("path"), F.col("kind") == "csv").alias("sensor"))


def window_files(files: DataFrame, location: str | None = None, interaction: str | None = None, index: str | None = None) -> DataFrame:
    """Interaction-window files; an index pattern may match the whole index or one of its parts."""
    idx = F.regexp_extract("name", r"^interaction_splitting_info_(.+)\.json$", 1)
    rows = files.where((F.col("depth") == 3) & (idx != "")).select("location", "interaction", idx.alias("interaction_index"), "path")
    if location:
        rows = rows.where(F.col("location") == location)
    if interaction:
        rows = rows.where(F.col("interaction") == interaction)
    if index is not None:
        part = F.exists(F.split("interaction_index", "-"), lambda p: glob_match(p, index, open_end=True))
        rows = rows.where(glob_match(F.col("interaction_index"), index, open_end=True) | part)
    return rows


def frames(files: DataFrame) -> DataFrame:
    """Frame files with their time from the file name; other names are left out."""
    rows = files.where(F.col("name").rlike(_STAMPED))
    return rows.select("*", F.regexp_extract("name", r"^(\d+)\.", 1).try_cast("bigint").alias("ts")).where(F.col("ts").isNotNull())
