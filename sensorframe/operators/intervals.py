"""Gaps, sequences, blocks and windows over event times."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sensorframe.operators.asof import asof_join, bracket_join
from sensorframe.operators.ordered import (
    Series, bucketed, carry, chunked, floor_div, join_summary, number_rows, prev_next, running_sum,
)
from sensorframe.operators.quantiles import attach
from sensorframe.session import stage

# Windows of one extent that are carried together.
LISTED_WINDOWS = 256
# Windows of one cell that a group of pairs has; ids of a few such groups still fit one dictionary of a file.
GROUPED_WINDOWS = 65_536


def gap_sequences(df: DataFrame, s: Series, gap_ns: int, out: str = "seq") -> DataFrame:
    """Zero-based sequence id; a new sequence starts where the step exceeds ``gap_ns``.

    One pass: breaks are counted inside a bucket, and its first and last time tell whether its border is a break.
    """
    rows = bucketed(df, s)
    t = F.col(s.ts)
    flagged = rows.withColumn("_brk", F.when(t - F.lag(t).over(s.inner()) > gap_ns, 1).otherwise(0).cast("bigint"))
    local = flagged.withColumn("_in", F.sum("_brk").over(s.inner().rowsBetween(W.unboundedPreceding, 0)))
    per = flagged.groupBy(*s.part).agg(F.min(t).alias("_t0"), F.max(t).alias("_t1"), F.sum("_brk").alias("_nb"))
    border = F.when(F.col("_t0") - F.lag("_t1").over(s.outer()) > gap_ns, 1).otherwise(0).cast("bigint")
    per = per.withColumn("_edge", border)
    before = F.coalesce(F.sum("_nb").over(s.outer().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    upto = F.sum("_edge").over(s.outer().rowsBetween(W.unboundedPreceding, 0))
    summary = per.select(*s.part, (before + upto).alias("_off"))
    return join_summary(local, summary, s).select(*df.columns, (F.col("_in") + F.col("_off")).alias(out))


def min_length(df: DataFrame, group: Sequence[str], n: int) -> DataFrame:
    """Rows of groups with at least ``n`` rows. Counts are combined before the shuffle."""
    keep = df.groupBy(*group).agg(F.count("*").alias("_len")).where(F.col("_len") >= n)
    return attach(df, keep, group).where(F.col("_len").isNotNull()).drop("_len")


def sequence_index(df: DataFrame, s: Series, seq: str = "seq") -> DataFrame:
    """``global_idx`` over the kept rows, ``local_idx`` within a sequence, ``in_contact`` 0 on the first row."""
    out = stage(number_rows(df, s, "global_idx").drop("_b"))
    start = out.groupBy(*s.keys, seq).agg(F.min("global_idx").alias("_g0"))
    out = attach(out, start, [*s.keys, seq]).withColumn("local_idx", F.col("global_idx") - F.col("_g0"))
    return out.drop("_g0").withColumn("in_contact", F.when(F.col("local_idx") == 0, 0).otherwise(1))


def stride_pairs(
    df: DataFrame, s: Series, stride: int, *, seq: str = "seq", stamp: str = "later", hop: int = 1,
    rows: int = 200_000,
) -> DataFrame:
    """Pairs ``(t, t + stride)`` inside a sequence with a label time and a dense sample index per key."""
    inside = replace(s, keys=[*s.keys, seq])
    parts = chunked(df.select(*inside.keys, *s.order), inside, 0, stride, rows)
    w = W.partitionBy(*inside.keys, "_chunk").orderBy("rn")
    pairs = (
        parts.withColumn("later", F.lead(s.ts, stride).over(w))
        .where(~F.col("_halo") & F.col("later").isNotNull() & (F.col("rn") % hop == 0))
        .select(*inside.keys, *s.order, F.col("rn").alias("local_idx"), "later")
    )
    early, late = F.col(s.ts), F.col("later")
    label = {"earlier": early, "later": late, "midpoint": floor_div(early + late, 2)}[stamp]
    return number_rows(stage(pairs.withColumn("label_ts", label)), s, "sample_idx").drop("_b")


def detection_blocks(df: DataFrame, s: Series, eps_ns: int, min_samples: int = 2) -> DataFrame:
    """Density clusters of hit times as ``start_ns, end_ns, duration_s, n``; isolated hits are noise.

    For ``min_samples`` up to 2 a cluster is a run of hits at most ``eps_ns`` apart. Above that only hits with
    enough neighbours within ``eps_ns`` (themselves included) link up, and other hits join a linking hit in reach,
    the earlier one first.
    """
    if min_samples <= 2:
        seq = gap_sequences(df.select(*s.keys, *s.order), s, eps_ns, "_c")
    else:
        pos = stage(number_rows(df.select(*s.keys, *s.order), s, "_i").drop("_b"))
        probe = replace(s, tie=())
        ref = pos.select(*s.keys, s.ts, F.col("_i").alias("_j"))
        lo = asof_join(
            pos.withColumn("_edge", F.col(s.ts) - eps_ns), ref, replace(probe, ts="_edge"), ["_j"],
            direction="forward", right_ts=s.ts, right_tie="_j",
        ).withColumnRenamed("_j", "_from")
        hi = asof_join(
            stage(lo).withColumn("_edge", F.col(s.ts) + eps_ns), ref, replace(probe, ts="_edge"), ["_j"],
            direction="backward", right_ts=s.ts, right_tie="_j",
        )
        core = stage(
            hi.withColumn("_core", F.col("_j") - F.col("_from") + 1 >= min_samples).drop("_edge", "_from", "_j")
        )
        linked = stage(gap_sequences(core.where("_core").drop("_core", "_i"), s, eps_ns, "_c"))
        rest = core.where("not _core").drop("_core", "_i")
        near = bracket_join(rest, linked, probe, ["_c"], right_tie="_c")
        reach = F.when(F.col(s.ts) - F.col("prev.ts") <= eps_ns, F.col("prev._c")).when(
            F.col("next.ts") - F.col(s.ts) <= eps_ns, F.col("next._c")
        )
        border = near.withColumn("_c", reach).where(F.col("_c").isNotNull()).drop("prev", "next")
        seq = linked.unionByName(border.select(*linked.columns))
    return (
        seq.groupBy(*s.keys, "_c")
        .agg(F.min(s.ts).alias("start_ns"), F.max(s.ts).alias("end_ns"), F.count("*").alias("n"))
        .where(F.col("n") >= min_samples)
        .withColumn("duration_s", (F.col("end_ns") - F.col("start_ns")) / F.lit(1e9))
        .drop("_c")
    )


def block_gaps(blocks: DataFrame, s: Series) -> DataFrame:
    """Time between consecutive blocks."""
    out = prev_next(blocks, replace(s, ts="start_ns", tie=()), ["start_ns"], prev=None, nxt="_nx")
    return (
        out.where(F.col("_nx.start_ns") > F.col("end_ns"))
        .select(*s.keys, F.col("end_ns").alias("start_ns"), F.col("_nx.start_ns").alias("end_ns"))
        .withColumn("duration_s", (F.col("end_ns") - F.col("start_ns")) / F.lit(1e9))
    )


def interaction_windows(
    blocks: DataFrame, frames_extent: DataFrame, s: Series, *, min_blocks: int = 3, min_s: float = 3.0
) -> DataFrame:
    """Gaps plus the head and tail of the frame range, kept when at least ``min_s`` long.

    ``frames_extent`` has the keys with ``first_ns`` and ``last_ns``. A window keeps the number of its gap, so
    numbers have holes where short gaps were dropped.
    """
    blocks = stage(blocks)
    ends = (
        blocks.groupBy(*s.keys)
        .agg(F.count("*").alias("_nb"), F.min("start_ns").alias("_b0"), F.max("end_ns").alias("_b1"))
        .where(F.col("_nb") >= min_blocks)
        .join(frames_extent, list(s.keys))
    )
    head = ends.select(*s.keys, F.lit(0).alias("_part"), F.col("first_ns").alias("start_ns"), F.col("_b0").alias("end_ns"))
    tail = ends.select(*s.keys, F.lit(2).alias("_part"), F.col("_b1").alias("start_ns"), F.col("last_ns").alias("end_ns"))
    mid = (
        block_gaps(blocks, s)
        .join(ends.select(*s.keys), list(s.keys), "left_semi")
        .select(*s.keys, F.lit(1).alias("_part"), "start_ns", "end_ns")
    )
    every = number_rows(stage(head.unionByName(mid).unionByName(tail)), replace(s, ts="start_ns", tie=("_part",)), "_i")
    return (
        every.withColumn("duration_s", (F.col("end_ns") - F.col("start_ns")) / F.lit(1e9))
        .where(F.col("duration_s") >= min_s)
        .select(*s.keys, F.concat(F.lit("window_"), F.col("_i")).alias("name"), "start_ns", "end_ns", "duration_s")
    )


def source_precedence(candidates: DataFrame, group: Sequence[str], source: str, n_blocks: str, min_blocks: int = 3) -> DataFrame:
    """Per group the first usable source: phones in reverse name order, then the others in name order.

    ``candidates`` has one row per source with its block count.
    """
    phone = F.lower(F.col(source)).startswith("iphone")
    usable = candidates.where(F.col(n_blocks) >= min_blocks)
    best_phone = F.max(F.when(phone, F.col(source)))
    best_other = F.min(F.when(~phone, F.col(source)))
    return usable.groupBy(*group).agg(F.coalesce(best_phone, best_other).alias(source))


def disjoint_windows(windows: DataFrame, s: Series, start: str = "start_ns", end: str = "end_ns") -> DataFrame:
    """Union of overlapping closed windows per key as disjoint ones."""
    base = windows.groupBy(*s.keys, start).agg(F.max(end).alias(end))
    ser = replace(s, ts=start, tie=())
    # Running maximum of the ends: a +1/-1 sweep keeps it a sum, which passes bucket borders exactly.
    ups = base.select(*s.keys, F.col(start).alias("t"), F.lit(1).cast("bigint").alias("d"))
    downs = base.select(*s.keys, (F.col(end) + 1).alias("t"), F.lit(-1).cast("bigint").alias("d"))
    steps = ups.unionByName(downs).groupBy(*s.keys, "t").agg(F.sum("d").alias("d"))
    depth = running_sum(stage(steps), replace(ser, ts="t"), {"depth": F.col("d")})
    was = F.col("depth") - F.col("d")
    edges = stage(depth.where((was == 0) != (F.col("depth") == 0)).drop("_b"))
    opened = carry(
        edges, replace(ser, ts="t"), F.when(F.col("depth") > 0, F.col("t")), last=start
    )
    return opened.where(F.col("depth") == 0).select(*s.keys, start, (F.col("t") - 1).alias(end))


def in_any_window(df: DataFrame, windows: DataFrame, s: Series, start: str = "start_ns", end: str = "end_ns") -> DataFrame:
    """J9 (any): rows inside at least one closed window, each once, by one backward as-of join."""
    merged = stage(disjoint_windows(windows, s, start, end)).withColumnRenamed(end, "_we")
    hit = asof_join(df, merged, s, ["_we"], direction="backward", right_ts=start)
    return hit.where(F.col(s.ts) <= F.col("_we")).drop("_we")


def window_members(
    df: DataFrame, windows: DataFrame, s: Series, cols: Sequence[str], *, start: str = "start_ns",
    end: str = "end_ns", width_ns: int | None = None,
) -> DataFrame:
    """J9 (each): every (row, window) pair with the row inside the closed window.

    Windows of one extent are listed together, ``LISTED_WINDOWS`` to a list, and a list meets the rows on (key, time
    cell), once per cell it touches. So the join stays an equi join whatever the number of windows, pairs are only
    made behind it and never moved, and the rows of a list come one after the other, which files them small. Choose
    ``width_ns`` near the typical window length.
    """
    span = [*s.keys, start, end]
    size = stage(windows.groupBy(*span).agg(F.count("*").alias("_n")), "extents")
    piece = F.pmod(F.xxhash64(*cols), F.ceil(F.col("_n") / LISTED_WINDOWS)).alias("_piece")
    lists = attach(windows, size, span, written=True).groupBy(*span, piece).agg(F.collect_list(F.struct(*cols)).alias("_list"))
    width = width_ns or s.cell_ns
    cells = _cells(lists, s, ["_piece", "_list"], start, end, width)
    at = [*[f"_w_{k}" for k in s.keys], "_wc"]
    held = _cells(size, s, ["_n"], start, end, width).groupBy(*at).agg(F.sum("_n").alias("_held"))
    full = stage(held.select("*", F.struct(*at).alias("_spot"), F.ceil(F.col("_held") / GROUPED_WINDOWS).cast("int").alias("_groups")), "full")
    tasks = max(1, -(-2 * (full.agg(F.sum("_held")).first()[0] or 0) // GROUPED_WINDOWS))
    cells = cells.join(full, at).withColumn("_wg", F.pmod(F.xxhash64("_ws", "_we", "_piece"), F.col("_groups")).cast("int"))
    rows = df.withColumn("_rc", floor_div(F.col(s.ts), width))
    met = _same_cell(s)
    rows = rows.join(full, met).withColumn("_rg", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)))
    # One column of one type holds all that pairs must share, so that the join takes the tasks as they are dealt here.
    cells = cells.select(F.struct("_spot", F.coalesce("_wg", F.lit(0)).alias("group")).alias("_wm"), "_ws", "_we", "_list")
    rows = rows.select(*df.columns, F.struct("_spot", F.coalesce("_rg", F.lit(0)).alias("group")).alias("_rm"))
    # Merged, not broadcast: windows stay in the outer loop.
    cells, rows = cells.repartition(tasks, "_wm").hint("merge"), rows.repartition(tasks, "_rm")
    pairs = cells.join(rows, (F.col("_rm") == F.col("_wm")) & F.col(s.ts).between(F.col("_ws"), F.col("_we")))
    return pairs.select(*df.columns, F.explode("_list").alias("_m")).select(*df.columns, *[F.col(f"_m.{c}").alias(c) for c in cols])


def _cells(windows: DataFrame, s: Series, cols: Sequence[str], start: str, end: str, width: int) -> DataFrame:
    """``cols`` of a window once per time cell ``_wc`` it touches."""
    return windows.select(
        *[F.col(k).alias(f"_w_{k}") for k in s.keys], F.col(start).alias("_ws"), F.col(end).alias("_we"), *cols,
        F.explode(F.sequence(floor_div(F.col(start), width), floor_div(F.col(end), width))).alias("_wc"),
    )


def _same_cell(s: Series) -> Column:
    cond = F.col("_rc") == F.col("_wc")
    for k in s.keys:
        cond = cond & (F.col(k) == F.col(f"_w_{k}"))
    return cond


def _meet(df: DataFrame, windows: DataFrame, s: Series, cols: Sequence[str], start: str, end: str, width: int) -> DataFrame:
    """Rows beside ``cols`` of every window they lie in, joined on (key, time cell); windows come in the outer loop."""
    cells = _cells(windows, s, cols, start, end, width)
    rows = df.withColumn("_rc", floor_div(F.col(s.ts), width))
    cond = _same_cell(s) & F.col(s.ts).between(F.col("_ws"), F.col("_we"))
    return cells.join(rows, cond).select(*df.columns, *cols)


def anchor_segments(df: DataFrame, anchors: DataFrame, s: Series, width_ns: int | None = None) -> DataFrame:
    """Rows between consecutive anchor times, both ends included, tagged ``segment_start``/``segment_end``.

    A segment stays only when its first row is at the start anchor. Each row lies in one segment, or in two when it
    sits on an inner anchor, so two backward as-of joins find them all.
    """
    ser = replace(s, tie=())
    nxt = prev_next(anchors.select(*s.keys, s.ts).distinct(), ser, [s.ts], prev="_pa", nxt="_na").drop("_b")
    nxt = nxt.select(
        *s.keys, F.col(s.ts).alias("_a"), F.col(f"_na.{s.ts}").alias("_to"), F.col(f"_pa.{s.ts}").alias("_from")
    )
    hit = stage(asof_join(df, stage(nxt), ser, ["_to", "_from"], direction="backward", right_ts="_a", matched_ts="_at"))
    opened = hit.where(F.col("_to").isNotNull()).select(
        *df.columns, F.col("_at").alias("segment_start"), F.col("_to").alias("segment_end")
    )
    closed = hit.where((F.col("_at") == F.col(s.ts)) & F.col("_from").isNotNull()).select(
        *df.columns, F.col("_from").alias("segment_start"), F.col("_at").alias("segment_end")
    )
    rows = opened.unionByName(closed)
    seg = [*s.keys, "segment_start"]
    good = rows.groupBy(*seg).agg(F.min(s.ts).alias("_t0")).where(F.col("_t0") == F.col("segment_start"))
    return attach(rows, good, seg).where(F.col("_t0").isNotNull()).drop("_t0")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """One row per key combination, the first (or last) by ``order``; combines before the shuffle."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return df.groupBy(*keys).agg(pick(F.struct(*rest), by).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def peak_in_window(df: DataFrame, group: Sequence[str], ts: str, score: Column, cols: Sequence[str]) -> DataFrame:
    """Per group the row with the largest ``score``, the earliest on ties."""
    row = F.struct(F.col(ts).alias("peak_ts"), *cols)
    best = F.max_by(row, F.struct(score, -F.col(ts)))
    return df.where(score.isNotNull()).groupBy(*group).agg(best.alias("_p")).select(*group, "_p.*")


def window_peaks(
    df: DataFrame, windows: DataFrame, s: Series, score: Column, cols: Sequence[str], *, start: str = "start_ns",
    end: str = "end_ns", width_ns: int | None = None,
) -> DataFrame:
    """W20 for closed windows: the peak of every extent ``(keys, start, end)`` that some window has.

    Rows meet each extent once, however many windows share it; ``attach`` brings the peaks to the windows.
    """
    span = [*s.keys, start, end]
    spans = stage(windows.select(*span).distinct(), "spans")
    ends = [F.col(c).alias(f"_s_{c}") for c in (start, end)]
    inside = _meet(df.where(score.isNotNull()), spans.select(*span, *ends), s, [f"_s_{c}" for c in (start, end)], start, end, width_ns or s.cell_ns)
    peak = peak_in_window(inside, [*s.keys, f"_s_{start}", f"_s_{end}"], s.ts, score, cols)
    return peak.withColumnsRenamed({f"_s_{c}": c for c in (start, end)})


def shared_window(df: DataFrame, outer: Sequence[str], module: str, ts: str) -> tuple[DataFrame, DataFrame]:
    """A1 and A2: extent of every module and the common window ``(start_ns, end_ns, valid)`` of a recording."""
    extent = df.groupBy(*outer, module).agg(F.min(ts).alias("min_ns"), F.max(ts).alias("max_ns"))
    common = extent.groupBy(*outer).agg(F.max("min_ns").alias("start_ns"), F.min("max_ns").alias("end_ns"))
    return extent, common.withColumn("valid", F.col("start_ns") < F.col("end_ns"))
