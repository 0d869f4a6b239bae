"""Release plan and manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.functions.text import archive_stem, is_hidden, is_metadata
from sensorframe.operators.ordered import place_in_group
from sensorframe.operators.quantiles import attach
from sensorframe.session import stage

# Modules a location is expected to have.
EXPECTED_MODULES = ("gripper", "hand", "wrist", "umi", "leica")


# A number that a stem may get behind its text: 2 or more, without leading zeros; counting comes to none of 19 digits.
_NUMBERED = r"(?s)^(.+)_([2-9]|[1-9][0-9]{1,17})$"


def _count_below(rows: DataFrame, marks: DataFrame, group: Sequence[str], at: str, mark: str, rank: str, out: str) -> DataFrame:
    """``out``: how many ``marks`` of the row's group lie below ``at``; ``rank`` is the row's place by ``at`` in its group, where no two are equal."""
    both = rows.withColumn("_x", F.col(at)).withColumn("_side", F.lit(0)).unionByName(
        marks.select(*group, F.col(mark).alias("_x"), F.lit(1).alias("_side")), allowMissingColumns=True
    )
    placed = place_in_group(both, group, ["_x", "_side"], "_p").where("_side = 0")
    return placed.select(*rows.columns, (F.col("_p") - F.col(rank)).alias(out))


def _decide(slots: DataFrame, group: Sequence[str]) -> DataFrame:
    """``_skip`` of the slots of a group in order of ``_i``: true where at most ``_d`` slots before it are skipped.

    Counts from below and from above close in on it; the first open slot of a group is settled each round, as a rule all are.
    """
    slots = stage(slots.withColumn("_skip", F.when(F.col("_d") < 0, False).when(F.col("_r") <= F.col("_d"), True)))
    while not slots.where("_skip IS NULL").isEmpty():
        low = _count_below(slots, slots.where("_skip"), group, "_i", "_i", "_r", "_low")
        both = _count_below(low, slots.where("coalesce(_skip, true)"), group, "_i", "_i", "_r", "_high")
        now = F.when(F.col("_high") <= F.col("_d"), True).when(F.col("_low") > F.col("_d"), False)
        slots = stage(both.withColumn("_skip", F.coalesce("_skip", now)).drop("_low", "_high"))
    return slots


def _name_by_sets(rows: DataFrame, parent: Sequence[str]) -> DataFrame:
    """``output_stem`` of families that want each other's numbers, as if names took theirs one after the other.

    Folders that want one stem take it and its numbers from 2 on. Number i of stem w is contested by one other set only, those that want the
    text ``w_i`` itself, and by its first folder alone: that one has it unless the set of w came to i before. So sets are settled from
    shorter to longer texts: a number is skipped when the folders of w before that first folder are too few to reach it; the folders left
    take the numbers left by rank. All of it is counting by place, so a family of any size is spread over tasks.
    """
    key = ["_home", "_want"]
    items = rows.withColumn("_home", F.to_json(F.struct(*parent)))
    items = place_in_group(items, ["_home", "_root"], ["_fold", "name"], "_t")
    items = stage(place_in_group(items, key, ["_t"], "_k"))
    sets = stage(items.groupBy(*key).agg(F.min("_t").alias("_f")))
    child = sets.select(
        "_home", F.regexp_extract("_want", _NUMBERED, 1).alias("_up"), F.regexp_extract("_want", _NUMBERED, 2).try_cast("bigint").alias("_i"), F.col("_want").alias("_child"), "_f"
    )
    links = child.where("_up <> ''").withColumnRenamed("_up", "_want").join(sets.select(*key), key, "left_semi")
    links = place_in_group(links, key, ["_f"], "_q")
    links = _count_below(links, items, key, "_f", "_t", "_q", "_n").drop("_q", "_f")
    links = stage(place_in_group(links, key, ["_i"], "_r"))
    tops = sets.join(links.select("_home", F.col("_child").alias("_want")), key, "left_anti")
    level = tops.select(*key, F.lit(True).alias("_own"))
    own, slots = level, None
    # One round for each number in the longest chain of numbers behind a text.
    while True:
        here = links.join(level, key).withColumn("_d", F.col("_i") - 2 + F.col("_own").cast("int") - F.col("_n"))
        here = _decide(here, key)
        if here.isEmpty():
            break
        slots = here if slots is None else slots.unionByName(here)
        level = here.select("_home", F.col("_child").alias("_want"), F.col("_skip").alias("_own"))
        own = own.unionByName(level)
    items = items.join(own, key).withColumn("_j", F.col("_k") - F.col("_own").cast("int"))
    rest = items.where("_j >= 0").withColumn("_c", F.lit(0).cast("bigint"))
    if slots is not None:
        # Of the numbers that are left, so many lie before each skipped one.
        skipped = place_in_group(slots.where("_skip").select(*key, "_i"), key, ["_i"], "_m").withColumn("_x0", F.col("_i") - 3 - F.col("_m"))
        rest = _count_below(rest.drop("_c"), skipped, key, "_j", "_x0", "_j", "_c")
    numbered = rest.withColumn("output_stem", F.concat("_want", F.lit("_"), (F.col("_j") + F.col("_c") + 2).cast("string")))
    return items.where("_j < 0").withColumn("output_stem", F.col("_want")).select(*rows.columns, "output_stem").unionByName(numbered.select(*rows.columns, "output_stem"))


def resolve_stems(dirs: DataFrame, parent: Sequence[str]) -> DataFrame:
    """unique archive stem of every folder inside its parent, with a note when it differs from the name.

    Only stems that share their text before trailing numbers can ever meet: families in which they may are settled by ``_name_by_sets``, in all
    others the folders of one wanted stem are numbered by position. Folders without a name are left out.
    """
    rows = dirs.withColumn("_clean", archive_stem(F.col("name"), True)).withColumn("_raw", archive_stem(F.col("name"), False))
    count = rows.groupBy(*parent, "_clean").agg(F.count("*").alias("_nc"))
    rows = attach(rows, count, [*parent, "_clean"])
    rows = rows.withColumn("_want", F.when(F.col("_nc") == 1, F.col("_clean")).otherwise(F.col("_raw")))
    rows = rows.withColumn("_root", F.regexp_replace("_want", r"(_\d+)+$", "")).withColumn("_fold", F.lower("name"))
    # Families where a numbered form of one wanted stem is wanted itself.
    wants = stage(rows.select(*parent, "_want", "_root").distinct(), "wants")
    base = wants.select(*[F.col(k).alias(f"_h_{k}") for k in parent], F.col("_want").alias("_base"))
    same = F.regexp_extract("_want", _NUMBERED, 1) == F.col("_base")
    for k in parent:
        same = same & F.col(k).eqNullSafe(F.col(f"_h_{k}"))
    kinds = wants.join(base, same, "left_semi").select(*parent, "_root").distinct().withColumn("_mixed", F.lit(True))
    rows = stage(attach(rows, kinds, [*parent, "_root"]).na.fill(False, ["_mixed"]).where(F.col("_want").isNotNull()))
    plain = place_in_group(rows.where(~F.col("_mixed")), [*parent, "_want"], ["_fold", "name"], "_i")
    plain = plain.withColumn("output_stem", F.when(F.col("_i") == 0, F.col("_want")).otherwise(F.concat("_want", F.lit("_"), (F.col("_i") + 1).cast("string")))).drop("_i")
    out = plain.select(*rows.columns, "output_stem")
    mixed = rows.where("_mixed")
    if not mixed.isEmpty():
        out = out.unionByName(_name_by_sets(mixed, parent))
    note = F.when(
        F.col("_nc") > 1, F.concat(F.lit("kept a disambiguated stem for '"), "name", F.lit("' because multiple folders collapse to '"), "_clean", F.lit("'"))
    ).when(F.col("output_stem") != F.col("name"), F.concat(F.lit("normalized from '"), "name", F.lit("'"))).otherwise("")
    return out.select(*dirs.columns, "output_stem", note.alias("note"))


def module_difference(observed: DataFrame, keys: Sequence[str], expected: Sequence[str] = EXPECTED_MODULES) -> DataFrame:
    """Modules a location lacks and modules nobody expected."""
    seen = observed.select(*keys, "module").distinct()
    want = seen.select(*keys).distinct().withColumn("module", F.explode(F.array(*[F.lit(m) for m in expected])))
    missing = want.join(seen, [*keys, "module"], "left_anti").withColumn("status", F.lit("missing"))
    extra = seen.join(want, [*keys, "module"], "left_anti").withColumn("status", F.lit("extra"))
    return missing.unionByName(extra)


def entries(files: DataFrame) -> DataFrame:
    """Visible entries of a listing ``(location, path, size, is_dir, is_symlink)``, path relative to the location.

    An entry is out when it or a folder above it is hidden, skipped or a link. Only four levels matter to the plan.
    """
    parts = F.split("path", "/")
    rows = files.where(F.size(parts) <= 4).withColumn("_p", parts)
    rows = rows.where(~F.exists("_p", is_hidden))
    up = F.transform(F.sequence(F.lit(1), F.size("_p")), lambda i: F.array_join(F.slice("_p", 1, i), "/"))
    links = files.where("is_symlink").select("location", F.col("path").alias("_link")).distinct()
    bad = rows.select("location", "path", F.explode(up).alias("_link")).join(links, ["location", "_link"]).select("location", "path").distinct()
    rows = rows.join(bad, ["location", "path"], "left_anti")
    parent = F.array_join(F.slice("_p", 1, F.size("_p") - 1), "/")
    return rows.select(
        "location", "path", F.when(F.size("_p") == 1, "").otherwise(parent).alias("parent"), F.element_at("_p", -1).alias("name"),
        F.get("_p", F.lit(0)).alias("module"), F.size("_p").alias("depth"), "size", "is_dir",
        (~F.col("is_dir") & is_metadata(F.element_at("_p", -1), F.col("size"))).alias("is_meta"),
    )


def plan(files: DataFrame, archive_suffix: str = ".zip") -> DataFrame:
    """One action per packaged file or folder: ``location, source, destination, action_type, note``.

    A stream folder directly in a module becomes one archive unless it has folders itself; then its files are copied
    or archived one by one and its folders become archives, opened one level more where they hold folders and the
    parent carries no metadata.
    """
    rows = stage(entries(files))
    inside = rows.groupBy("location", F.col("parent").alias("path")).agg(
        F.count_if("is_dir").alias("_dirs"), F.count_if("is_meta").alias("_metas")
    )
    dirs = attach(rows.where("is_dir and depth >= 2"), inside, ["location", "path"]).na.fill(0, ["_dirs", "_metas"])
    named = stage(resolve_stems(dirs, ["location", "parent"]))
    digit = (F.col("module") == "leica") & F.col("name").rlike(r"^\d+$")
    child = named.where("depth = 2").withColumn("_mode", F.when(F.col("_dirs") == 0, "whole").when((F.col("_metas") > 0) | digit, "flat").otherwise("deep"))
    child = child.withColumn("_dest", F.concat_ws("/", "module", "output_stem"))
    kids = attach(named.where("depth = 3"), child.select("location", F.col("path").alias("parent"), F.col("_mode").alias("_pm"), F.col("_dest").alias("_pd")), ["location", "parent"])
    kids = kids.where(F.col("_pm").isin("flat", "deep")).withColumn("_dest", F.concat_ws("/", "_pd", "output_stem"))
    kids = kids.withColumn("_mode", F.when((F.col("_pm") == "deep") & (F.col("_dirs") > 0), "open").otherwise("whole"))
    grand = attach(named.where("depth = 4"), kids.where("_mode = 'open'").select("location", F.col("path").alias("parent"), F.col("_dest").alias("_pd")), ["location", "parent"])
    grand = grand.where(F.col("_pd").isNotNull()).withColumn("_dest", F.concat_ws("/", "_pd", "output_stem"))

    def archive(df: DataFrame, kind: str) -> DataFrame:
        return df.select("location", F.col("path").alias("source"), F.concat("_dest", F.lit(archive_suffix)).alias("destination"), F.lit(kind).alias("action_type"), "note")

    files_only = rows.where("not is_dir")
    copies = files_only.where("is_meta and depth <= 2").select(
        "location", F.col("path").alias("source"), F.col("path").alias("destination"),
        F.when(F.col("depth") == 1, "root_metadata_copy").otherwise("module_metadata_copy").alias("action_type"), F.lit("").alias("note"),
    )
    opened = child.where("_mode <> 'whole'").select("location", F.col("path").alias("parent"), "_dest").unionByName(
        kids.where("_mode = 'open'").select("location", F.col("path").alias("parent"), "_dest")
    )
    nested = attach(files_only.where("depth >= 3"), opened, ["location", "parent"]).where(F.col("_dest").isNotNull())
    target = F.concat_ws("/", "_dest", "name")
    nested = nested.select(
        "location", F.col("path").alias("source"), F.when(F.col("is_meta"), target).otherwise(F.concat(target, F.lit(archive_suffix))).alias("destination"),
        F.when(F.col("is_meta"), "nested_metadata_copy").otherwise("nested_direct_file_archive").alias("action_type"),
        F.when(F.col("is_meta"), "").otherwise("archived direct non-metadata file").alias("note"),
    )
    out = copies.unionByName(archive(child.where("_mode = 'whole'"), "module_stream_archive")).unionByName(nested)
    return out.unionByName(archive(kids.where("_mode = 'whole'"), "nested_stream_archive")).unionByName(archive(grand, "nested_stream_archive"))


def artifacts(actions: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows of a plan, sizes taken from the sources: a folder counts the files below it.

    Every file is matched to the folders above it by equality, so the sum needs no range join.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    sizes = files.where("not is_dir").select("location", "size", F.explode(above).alias("source")).groupBy("location", "source").agg(F.sum("size").alias("size_bytes"))
    out = attach(actions, sizes, ["location", "source"])
    kind = F.when(F.col("action_type").endswith("_copy"), "metadata_file").otherwise("zip_archive")
    return out.select(
        "location", F.col("destination").alias("relative_path"), kind.alias("artifact_type"), F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
        F.col("source").alias("source_relative_path"), "note",
    )


def artifact_summary(items: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count and bytes per type."""
    return items.groupBy(*keys, "artifact_type").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))
