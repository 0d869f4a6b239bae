"""Names, paths, message texts and configuration columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Prefix every recording file name has (place, number with optional letters, index list).
RECORDING_NAME = r"^[A-Za-z]+_[0-9]+[A-Za-z]*_\d+(-\d+)*_"
# What counts as small metadata and what is never packaged.
METADATA_SUFFIXES = (".json", ".csv", ".txt", ".md", ".yaml", ".yml")
METADATA_NAMES = ("metadata",)
METADATA_MAX_BYTES = 16 * 1024 * 1024
SKIPPED_NAMES = (".DS_Store", "Thumbs.db", "__MACOSX", ".Spotlight-V100", ".TemporaryItems", ".Trashes")


def strip(col: Column | str) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"^\s+|\s+$", "")


def stem(name: Column) -> Column:
    """File name without its last suffix; a leading dot does not start a suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1))


def interaction_index(name: Column) -> Column:
    """third token of a name when it is a list of numbers such as ``1-3``, else null."""
    token = F.get(F.split(stem(name), "_"), F.lit(2))
    return F.when(token.rlike(r"^\d+(-\d+)*$"), token)


def index_contains(index: Column, part: str) -> Column:
    """the list ``1-3-5`` holds ``part``."""
    return F.array_contains(F.split(index, "-"), part)


def is_recording_name(name: Column) -> Column:
    """P3."""
    return stem(name).rlike(RECORDING_NAME)


def glob_match(col: Column, pattern: str, open_end: bool = False) -> Column:
    """Shell pattern with ``*`` and ``?``; ``open_end`` adds a trailing ``*`` to a pattern without any."""
    import re

    if open_end and not set(pattern) & set("*?"):
        pattern += "*"
    rx = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return col.rlike(f"^{rx}$")


def _parts(path: Column) -> Column:
    return F.filter(F.split(F.lower(path), "/"), lambda p: p != "")


def viewpoint(path: Column) -> Column:
    """``(viewpoint, module)`` of a stream by the folders on its path, the first rule that fits."""
    parts = _parts(path)

    def has(name: str) -> Column:
        return F.array_contains(parts, name)

    def out(view: str, module: str) -> Column:
        return F.struct(F.lit(view).alias("viewpoint"), F.lit(module).alias("module"))

    rules = [
        (has("aria_human"), out("ego", "aria_human")),
        (has("aria_wrist"), out("wrist", "aria_wrist")),
        (has("aria_gripper"), out("gripper", "aria_gripper")),
        (has("umi_gripper"), out("gripper", "umi_gripper")),
        (F.lower(path).rlike(r"(^|/)gripper/+gripper(/|$)"), out("gripper", "gripper/gripper")),
        (F.exists(parts, lambda p: p.startswith("iphone")), out("third_person", "iphone")),
        ((has("zedm") | has("zed_node")) & has("gripper"), out("gripper", "zed_under_gripper")),
    ]
    expr = F.when(*rules[0])
    for cond, value in rules[1:]:
        expr = expr.when(cond, value)
    return expr.otherwise(out("unknown", ""))


def sensor_module(path: Column, is_file: Column) -> Column:
    """sensor name by the folders on the path, else the last folder."""
    parts = _parts(path)

    def has(name: str) -> Column:
        return F.array_contains(parts, name)

    last = F.try_element_at(parts, F.when(is_file, F.lit(-2)).otherwise(F.lit(-1)))
    return (
        F.when(has("wrench"), "wrench").when(has("imu"), "imu").when(has("joint_states"), "joint_states")
        .when(has("telemetry"), "telemetry").when(has("digit"), "haptics")
        .when(has("camera_depth") | has("depth_registered"), "depth").when(has("zedm") & has("depth"), "depth")
        .otherwise(F.coalesce(last, F.lit("unknown")))
    )


def is_hidden(name: Column) -> Column:
    """P24."""
    return name.startswith(".") | name.isin(*SKIPPED_NAMES)


def is_metadata(name: Column, size: Column) -> Column:
    """Small file of a metadata kind."""
    return (size <= METADATA_MAX_BYTES) & (suffix(name).isin(*METADATA_SUFFIXES) | F.lower(name).isin(*METADATA_NAMES))


def archive_stem(name: Column, strip_note: bool) -> Column:
    """file-name-safe stem; ``strip_note`` takes off a trailing remark in parentheses."""
    text = strip(name)
    if strip_note:
        short = strip(F.regexp_replace(text, r"\s+\([^)]*\)\s*$", ""))
        text = F.when(short == "", text).otherwise(short)
    text = F.regexp_replace(text, r"[()]", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"_+", "_")
    text = F.regexp_replace(text, r"^[._]+|[._]+$", "")
    return F.when(text == "", "archive").otherwise(text)


def human_size(size: Column) -> Column:
    """bytes with a binary unit and one decimal."""
    out = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), start=1):
        text = F.concat(F.format_string("%.1f", size / float(1024**i)), F.lit(f" {unit}"))
        out = out.when(size < 1024 ** (i + 1), text) if unit != "TiB" else out.otherwise(text)
    return out


def human_duration(seconds: Column) -> Column:
    """whole hours, minutes and seconds, rounding half to even."""
    total = F.greatest(F.rint(seconds).cast("bigint"), F.lit(0).cast("bigint"))
    h, m, s = F.floor(total / 3600), F.floor(total / 60) % 60, total % 60
    secs = F.concat(s.cast("string"), F.lit("s"))
    mins = F.concat(m.cast("string"), F.lit("m "), secs)
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), mins)).when(m > 0, mins).otherwise(secs)


def config_key(*cols: Column) -> Column:
    """short hash of a configuration, fields in name order."""
    return F.substring(F.sha1(F.to_json(F.struct(*cols))), 1, 16)


def first_present(text: Column, names: Sequence[str]) -> Column:
    """value of the first of several alias keys present in a JSON text."""
    return F.coalesce(*[F.get_json_object(text, f"$.{n}") for n in names])


def coerced(text: Column) -> Column:
    """number or zero."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def float_list(text: Column) -> Column:
    """numbers of ``[1. 2.]`` or ``[1, 2]``; null when any item is no number."""
    body = F.trim(F.regexp_replace(F.regexp_replace(text, r"^[\[\] ]+|[\[\] ]+$", ""), ",", " "))
    items = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\s+"))
    values = F.transform(items, lambda x: x.try_cast("double"))
    return F.when(~F.exists(values, lambda v: v.isNull()), values)


_NUM = r"-?\d+\.?\d*(?:[eE][-+]?\d*)?"
# Message types as printed by the recorder, with their fields in order.
MESSAGES = {
    "Time": ("builtin_interfaces", (("sec", "int"), ("nanosec", "int"))),
    "Vector3": ("geometry_msgs", (("x", "num"), ("y", "num"), ("z", "num"))),
    "Quaternion": ("geometry_msgs", (("x", "num"), ("y", "num"), ("z", "num"), ("w", "num"))),
    "Point": ("geometry_msgs", (("x", "num"), ("y", "num"), ("z", "num"))),
    "Header": ("std_msgs", (("seq", "int"), ("stamp", "Time"), ("frame_id", "text"))),
    "Transform": ("geometry_msgs", (("translation", "Vector3"), ("rotation", "Quaternion"))),
    "TransformStamped": ("geometry_msgs", (("header", "Header"), ("child_frame_id", "text"), ("transform", "Transform"))),
    "Pose": ("geometry_msgs", (("position", "Point"), ("orientation", "Quaternion"))),
}


def message(text: Column, name: str) -> Column:
    """printed message as a struct, null when it does not have the form of ``name``.

    The form reaches to the end of the text, so a message inside another one is taken whole.
    """
    package, fields = MESSAGES[name]
    inner = []
    for field, kind in fields:
        if kind in MESSAGES:
            value = rf"({MESSAGES[kind][0]}__msg__{kind}\(.+?\))"
        else:
            value = {"int": r"(\d+)", "num": f"({_NUM})", "text": "'([^']*)'"}[kind]
        inner.append(f"{field}={value}")
    rx = rf"^{package}__msg__{name}\(" + ", ".join(inner) + r", __msgtype__='[^']+'\)\s*$"
    out = []
    for i, (field, kind) in enumerate(fields, start=1):
        got = F.regexp_extract(text, rx, i)
        if kind in MESSAGES:
            got = message(got, kind)
        elif kind != "text":
            got = got.try_cast("bigint" if kind == "int" else "double")
        out.append(got.alias(field))
    return F.when(text.rlike(rx), F.struct(*out))


def flatten(df: DataFrame, sep: str = "_", lengths: dict[str, int] | None = None) -> DataFrame:
    """nested struct fields as columns named by their path; arrays of known ``lengths`` item by item."""
    lengths = lengths or {}

    def walk(col: Column, dtype: T.DataType, path: str):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                yield from walk(col[f.name], f.dataType, f"{path}{sep}{f.name}")
        elif isinstance(dtype, T.ArrayType) and path in lengths:
            for i in range(lengths[path]):
                yield from walk(F.get(col, F.lit(i)), dtype.elementType, f"{path}{sep}{i}")
        else:
            yield col.alias(path)

    return df.select(*[c for f in df.schema.fields for c in walk(F.col(f"`{f.name}`"), f.dataType, f.name.replace(".", sep))])
