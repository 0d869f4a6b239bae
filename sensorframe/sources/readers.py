"""Readers for extracted tables (S6-S16, P6, X1, X2); every one carries the file path for keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe.functions.text import float_list, message, strip
from sensorframe.functions.timecols import to_ns

PATH = "_metadata.file_path"
_D = T.DoubleType()


def _fields(*names: str, kind: T.DataType = _D) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


def _schema(*fields: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("timestamp", T.LongType()), *fields])


# Column layouts of the extracted topics, by recorder kind and stream.
SCHEMAS: dict[tuple[str, str], T.StructType] = {
    ("gripper", "wrench"): _schema(*_fields("wrench.force.x", "wrench.force.y", "wrench.force.z", "wrench.torque.x", "wrench.torque.y", "wrench.torque.z")),
    ("gripper", "joint_states"): _schema(*_fields("position.0", "velocity.0", "effort.0")),
    ("gripper", "temperature"): _schema(*_fields("temperature", "variance")),
    ("gripper", "imu"): _schema(*_fields("angular_velocity.x", "angular_velocity.y", "angular_velocity.z", "linear_acceleration.x", "linear_acceleration.y", "linear_acceleration.z")),
    ("gripper", "force_trigger"): _schema(*_fields("data")),
    ("iphone", "poses"): _schema(*_fields("qx", "qy", "qz", "qw", "tx", "ty", "tz")),
    ("umi", "imu"): _schema(*_fields("angular_vel_x", "angular_vel_y", "angular_vel_z", "linear_accel_x", "linear_accel_y", "linear_accel_z")),
}


def recorder_kind(name: str) -> str | None:
    """Reader family of a recorder: exact for ``gripper``, by substring for the others."""
    if name == "gripper":
        return "gripper"
    return next((k for k in ("iphone", "aria", "umi") if k in name), None)


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None, by_name: bool = True) -> DataFrame:
    """Stream tables with a header, ``.gz`` included; dots in names become ``_`` and NaN becomes null.

    With ``by_name`` the header decides the order of columns and ``schema`` their types.
    """
    raw = spark.read.option("header", True).option("enforceSchema", False)
    df = raw.csv(path) if by_name or schema is None else raw.schema(schema).csv(path)
    cols = []
    kinds = {f.name: f.dataType for f in schema.fields} if schema else {}
    for c in df.columns:
        if schema and c not in kinds:
            continue
        kind = kinds.get(c, T.StringType())
        col = F.col(f"`{c}`")
        if not isinstance(kind, T.StringType):
            col = col.try_cast(kind)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            col = F.when(~F.isnan(col), col)
        cols.append(col.alias(c.replace(".", "_")))
    return df.select(*cols, F.col(PATH).alias("path"))


def time_column(df: DataFrame, exact: bool = False) -> str | None:
    """The column named ``timestamp`` (``exact``), or the first whose name contains it."""
    if exact:
        return "timestamp" if "timestamp" in df.columns else None
    return next((c for c in df.columns if "timestamp" in c), None)


def read_odometry(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``ts tx ty tz qx qy qz qw`` separated by blanks; lines of another form are left out."""
    p = F.split(strip("value"), r"\s+")
    rows = spark.read.text(path).select(p.alias("p"), F.col(PATH).alias("path")).where(F.size("p") == 8)
    names = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")
    ts = F.coalesce(F.col("p")[0].try_cast("bigint"), F.col("p")[0].try_cast("double").cast("bigint"))
    out = rows.select(ts.alias("ts"), *[F.col("p")[i + 1].try_cast("double").alias(n) for i, n in enumerate(names)], "path")
    return out.where(F.col("ts").isNotNull())


WINDOW = T.StructType([
    T.StructField("start_ns", T.LongType()), T.StructField("end_ns", T.LongType()), T.StructField("duration_s", _D),
    T.StructField("single_word_description", T.StringType()), T.StructField("index", T.IntegerType()),
])


def read_json_map(spark: SparkSession, path: str, value: T.DataType, key: str = "name") -> DataFrame:
    """JSON files that map names to records, one row per entry; unreadable files are left out."""
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", T.MapType(T.StringType(), value)).alias("m"), F.col(PATH).alias("path"))
    rows = docs.where(F.col("m").isNotNull()).select(F.explode("m").alias(key, "_v"), "path")
    return rows.select(key, "_v.*", "path") if isinstance(value, T.StructType) else rows.withColumnRenamed("_v", "value")


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """Interaction windows."""
    return read_json_map(spark, path, WINDOW)


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON files of one record each."""
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("_r"), F.col(PATH).alias("path"))
    return docs.where(F.col("_r").isNotNull()).select("_r.*", "path")


def read_cues(spark: SparkSession, path: str) -> DataFrame:
    """Cue tables with any of the usual delimiters; numbers that are none become null.

    The delimiter is the candidate that occurs most in a file's first line, so files may differ.
    """
    doc = spark.read.text(path, wholetext=True).select(F.split(strip("value"), r"\r?\n").alias("lines"), F.col(PATH).alias("path"))
    head = F.element_at("lines", 1)
    counts = F.array(*[F.struct(F.length(F.regexp_replace(head, f"[^{d}]", "")).alias("n"), F.lit(d).alias("d")) for d in ("|", ";", "\t", ",")])
    doc = doc.withColumn("d", F.array_max(counts)["d"])
    cells = doc.select("path", "d", F.transform(F.split(head, F.concat(F.lit("["), "d", F.lit("]"))), lambda h: F.lower(strip(h))).alias("h"), F.explode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line"))
    cells = cells.select("path", "h", F.split("line", F.concat(F.lit("["), "d", F.lit("]"))).alias("c"))

    def value(*names: str) -> Column:
        got = [strip(F.get("c", F.array_position("h", n).cast("int") - 1)) for n in names]
        return F.coalesce(*[F.when(x != "", x) for x in got])

    rows = cells.select(
        value("axis_name", "axis").alias("axis"), value("cue_start").try_cast("int").alias("cue_start"),
        value("cue_end").try_cast("int").alias("cue_end"), F.coalesce(value("verification"), F.lit("")).alias("verification"), "path",
    )
    return rows.where(F.col("axis").isNotNull())


def read_event_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Files whose first line names two sensors and whose other lines pair their times."""
    doc = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\r?\n"), lambda x: strip(x) != "").alias("l"), F.col(PATH).alias("path"))
    head = F.element_at("l", 1)
    rows = doc.select(
        F.regexp_extract(head, r"['\"]([^'\"]+)['\"]\s*,\s*['\"]([^'\"]+)['\"]", 1).alias("sensor_1"),
        F.regexp_extract(head, r"['\"]([^'\"]+)['\"]\s*,\s*['\"]([^'\"]+)['\"]", 2).alias("sensor_2"),
        F.explode(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0)))).alias("line"), "path",
    )
    pair = [F.regexp_extract("line", r"(-?\d+)\s*,\s*(-?\d+)", i).try_cast("bigint").alias(f"ts_{i}") for i in (1, 2)]
    return rows.select("sensor_1", "sensor_2", *pair, "path")


PHONE = T.StructType([
    T.StructField("frameTimestamps", T.ArrayType(_D)), T.StructField("poses", T.ArrayType(T.ArrayType(_D))), T.StructField("K", T.ArrayType(_D)),
    *_fields("w", "h", "dw", "dh", "fps"),
])


def read_phone(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Poses and calibration of phone recordings; matrices are stored column by column."""
    meta = read_records(spark, path, PHONE)
    rows = meta.select("path", F.explode(F.arrays_zip("frameTimestamps", "poses")).alias("z"))
    names = ("qx", "qy", "qz", "qw", "tx", "ty", "tz")
    poses = rows.select(to_ns(F.col("z.frameTimestamps"), "s").alias("ts"), *[F.get("z.poses", F.lit(i)).alias(n) for i, n in enumerate(names)], "path")
    k = [F.get("K", F.lit(i)) for i in (0, 4, 6, 7)]
    calib = meta.select(*[c.alias(n) for c, n in zip(k, ("fx", "fy", "cx", "cy"))], *[F.col(c).cast("int").alias(c) for c in ("w", "h", "dw", "dh")], "fps", "path")
    return poses, calib


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Camera blocks of calibration files as rows ``camera, intrinsics, w, h, T, timeshift_s``.

    Reads the plain block form with bracketed lists that calibration tools write.
    """
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^(\w+):[ \t]*\r?\n((?:[ \t-].*\r?\n?)+)"), 0)).alias("b"), F.col(PATH).alias("path"))
    body = F.col("b")
    rows = F.regexp_extract(body, r"T_cam_imu:\s*\r?\n((?:\s*-\s*\[[^\]]*\]\s*)+)", 1)
    size = float_list(F.regexp_extract(body, r"resolution:\s*(\[[^\]]*\])", 1))
    return doc.select(
        F.regexp_extract(body, r"^(\w+):", 1).alias("camera"), float_list(F.regexp_extract(body, r"intrinsics:\s*(\[[^\]]*\])", 1)).alias("intrinsics"),
        F.get(size, F.lit(0)).cast("int").alias("w"), F.get(size, F.lit(1)).cast("int").alias("h"),
        float_list(strip(F.regexp_replace(rows, r"[\[\]\-](?=\s|\[|$)|\[|\]", " "))).alias("T"),
        F.regexp_extract(body, r"timeshift_cam_imu:\s*(\S+)", 1).try_cast("double").alias("timeshift_s"), "path",
    )


def read_panorama_poses(spark: SparkSession, path: str) -> DataFrame:
    """Position and orientation of the ``Ldr`` and ``Hdr`` sections of panorama text files."""
    doc = spark.read.text(path, wholetext=True).select("value", F.col(PATH).alias("path"))
    out = None
    for name, mark, other in (("LDR", "Ldr Image", "Hdr Image"), ("HDR", "Hdr Image", "Ldr Image")):
        part = F.regexp_extract("value", rf"(?s)(?:^|\n)\s*{mark}(.*?)(?:\n\s*{other}|$)", 1)
        rows = doc.where(part != "").select(
            F.lit(name).alias("section"), float_list(F.regexp_extract(part, r"position\s*=\s*(\[[^\]]*\])", 1)).alias("position"),
            float_list(F.regexp_extract(part, r"orientation\s*=\s*(\[[^\]]*\])", 1)).alias("orientation"), "path",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def read_force_samples(spark: SparkSession, root: str) -> DataFrame:
    """Label and force of ``scene/sample`` folders that hold both files."""
    doc = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).text(root, wholetext=True)
    p = F.split(F.col(PATH), "/")
    rows = doc.select(F.element_at(p, -3).alias("scene"), F.element_at(p, -2).alias("sample"), F.element_at(p, -1).alias("f"), strip("value").alias("v"))
    out = rows.groupBy("scene", "sample").agg(
        F.max(F.when(F.col("f") == "label.txt", F.col("v"))).alias("label"), F.max(F.when(F.col("f") == "force.txt", F.col("v"))).try_cast("double").alias("force")
    )
    return out.dropna(subset=["label", "force"])


# Column builders per message type, for tables that hold printed messages.
MESSAGE_COLUMNS: dict[str, dict[str, Callable[[Column], Column]]] = {
    "geometry_msgs/WrenchStamped": {"header.stamp": lambda c: message(c, "Time"), "wrench.force": lambda c: message(c, "Vector3"), "wrench.torque": lambda c: message(c, "Vector3")},
    "sensor_msgs/JointState": {"header.stamp": lambda c: message(c, "Time"), "position": float_list, "velocity": float_list, "effort": float_list},
    "sensor_msgs/Temperature": {"header.stamp": lambda c: message(c, "Time"), "temperature": lambda c: c.try_cast("double"), "variance": lambda c: c.try_cast("double")},
    "sensor_msgs/Imu": {
        "header.stamp": lambda c: message(c, "Time"), "angular_velocity_covariance": float_list, "linear_acceleration_covariance": float_list, "orientation_covariance": float_list,
        **{f"{v}.{a}": (lambda c: c.try_cast("double")) for v in ("angular_velocity", "linear_acceleration", "orientation") for a in "xyzw" if v == "orientation" or a != "w"},
    },
    "std_msgs/Float32": {"data": lambda c: c.try_cast("float")},
    "tf2_msgs/TFMessage": {"transforms": lambda c: message(c, "TransformStamped")},
    "geometry_msgs/PoseWithCovarianceStamped": {"header.stamp": lambda c: message(c, "Time"), "pose.pose": lambda c: message(c, "Pose"), "pose.covariance": float_list},
}


def parse_messages(df: DataFrame, kind: str) -> DataFrame:
    """Text columns of one message type parsed; a numbered column such as ``transforms.0`` counts as its list."""
    builders = MESSAGE_COLUMNS[kind]
    cols = []
    for c in df.columns:
        build = builders.get(c) or builders.get(c.rsplit(".", 1)[0] if c.rsplit(".", 1)[-1].isdigit() else "")
        col = F.col(f"`{c}`")
        cols.append((build(col) if build else col).alias(c.replace(".", "_")))
    return df.select(*cols)
