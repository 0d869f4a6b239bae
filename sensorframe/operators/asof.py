"""As-of joins (J1-J8, J12): tag both sides, union, carry the right side over the left rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sensorframe.operators.ordered import Series, bucketed, join_summary


def bracket_many(left: DataFrame, streams: dict[str, tuple], s: Series, *, prev: bool = True, nxt: bool = True) -> DataFrame:
    """Every left row with the rows around it in each stream, in one pass over the union of all tables.

    ``streams`` maps a name to ``(table, cols, time column, tie column or None)``. Adds ``{name}_prev`` and
    ``{name}_next``, structs of ``(ts, *cols)``. A row at exactly the left time is both. Among rows at one time,
    ``prev`` is the last and ``next`` the first by the tie column.
    """
    keys = [f"_key{i}" for i in range(len(s.keys))]
    rows = left.select(
        *[F.col(k).alias(n) for k, n in zip(s.keys, keys)],
        F.col(s.ts).alias("_t"),
        F.lit(1).alias("_side"),
        F.lit(None).cast("bigint").alias("_tie"),
        F.struct(*left.columns).alias("_l"),
    )
    for name, (right, cols, rts, tie) in streams.items():
        side = right.where(F.col(rts).isNotNull()).select(
            *[F.col(k).alias(n) for k, n in zip(s.keys, keys)],
            F.col(rts).alias("_t"),
            F.lit(0).alias("_side"),
            (F.col(tie).cast("bigint") if tie else F.lit(None).cast("bigint")).alias("_tie"),
            F.struct(F.col(rts).alias("ts"), *cols).alias(f"_r_{name}"),
        )
        rows = rows.unionByName(side, allowMissingColumns=True)
    keyed = replace(s, keys=keys, ts="_t", tie=("_side", "_tie"))
    rows = bucketed(rows, keyed)
    part = [F.col(c) for c in keyed.part]
    # Rows of the streams sort before left rows at one time in both directions.
    up = W.partitionBy(*part).orderBy("_t", "_side", "_tie").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*part).orderBy(F.desc("_t"), "_side", F.desc("_tie")).rowsBetween(W.unboundedPreceding, 0)
    later = W.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    earlier = keyed.outer().rowsBetween(W.unboundedPreceding, -1)
    news, aggs, picks, found = [], [], [], []
    for name in streams:
        v = F.col(f"_r_{name}")
        by = F.when(v.isNotNull(), F.struct("_t", "_tie"))
        if prev:
            news.append(F.last(v, ignorenulls=True).over(up).alias(f"_ip_{name}"))
            aggs.append(F.max_by(v, by).alias(f"_hi_{name}"))
            picks.append(F.last(f"_hi_{name}", ignorenulls=True).over(earlier).alias(f"_xp_{name}"))
            found.append(F.coalesce(f"_ip_{name}", f"_xp_{name}").alias(f"{name}_prev"))
        if nxt:
            news.append(F.last(v, ignorenulls=True).over(down).alias(f"_in_{name}"))
            aggs.append(F.min_by(v, by).alias(f"_lo_{name}"))
            picks.append(F.last(f"_lo_{name}", ignorenulls=True).over(later).alias(f"_xn_{name}"))
            found.append(F.coalesce(f"_in_{name}", f"_xn_{name}").alias(f"{name}_next"))
    summary = rows.groupBy(*keyed.part).agg(*aggs).select(*keyed.part, *picks)
    local = rows.select(*keyed.part, "_l", *news).where(F.col("_l").isNotNull())
    return join_summary(local, summary, keyed).select("_l.*", *found)


def bracket_join(
    left: DataFrame, right: DataFrame, s: Series, cols: Sequence[str], *, right_ts: str | None = None,
    right_tie: str | None = None, prev: str | None = "prev", nxt: str | None = "next",
) -> DataFrame:
    """Every left row with the right rows around it as structs ``prev`` and ``next`` of ``(ts, *cols)``."""
    out = bracket_many(left, {"_r": (right, cols, right_ts or s.ts, right_tie)}, s, prev=bool(prev), nxt=bool(nxt))
    found = [F.col("_r_prev").alias(prev)] if prev else []
    found += [F.col("_r_next").alias(nxt)] if nxt else []
    return out.select(*left.columns, *found)


def _nearer(t: Column, prev: Column, nxt: Column, tolerance: int | None) -> Column:
    """The closer of two matches, the earlier on equal gaps, null beyond the inclusive tolerance."""
    back, ahead = t - prev["ts"], nxt["ts"] - t
    hit = F.when(ahead.isNull() | (back <= ahead), prev).otherwise(nxt)
    return hit if tolerance is None else F.when(F.least(back, ahead) <= tolerance, hit)


def asof_many(left: DataFrame, steps: Sequence[tuple], s: Series) -> DataFrame:
    """Nearest joins of ``left`` with several tables in one pass.

    ``steps`` lists ``(table, cols, tolerance, required)`` or adds a fifth item naming a column for the matched
    time; ``required`` drops left rows whose match is missing or holds nulls.
    """
    streams = {f"s{i}": (step[0], step[1], s.ts, None) for i, step in enumerate(steps)}
    rows = bracket_many(left, streams, s)
    hits, out, need = [], [], []
    for i, (_, cols, tolerance, required, *name) in enumerate(steps):
        hits.append(_nearer(F.col(s.ts), F.col(f"s{i}_prev"), F.col(f"s{i}_next"), tolerance).alias(f"_h{i}"))
        out += [F.col(f"_h{i}.{c}").alias(c) for c in cols]
        out += [F.col(f"_h{i}.ts").alias(n) for n in name]
        need += list(cols) + list(name) if required else []
    rows = rows.select(*left.columns, *hits).select(*left.columns, *out)
    return rows.dropna(subset=need) if need else rows


def asof_join(
    left: DataFrame,
    right: DataFrame,
    s: Series,
    cols: Sequence[str],
    *,
    direction: str = "nearest",
    tolerance: int | None = None,
    right_ts: str | None = None,
    right_tie: str | None = None,
    matched_ts: str | None = None,
    how: str = "left",
) -> DataFrame:
    """``left`` with ``cols`` of the matching right row.

    The tolerance is inclusive; equal gaps pick the earlier row. ``matched_ts`` names a column for the matched time,
    ``how="inner"`` drops left rows without a match (J6).
    """
    want_prev = direction in ("nearest", "backward")
    want_next = direction in ("nearest", "forward")
    if not (want_prev or want_next):
        raise ValueError(f"unknown direction {direction!r}")
    rows = bracket_join(
        left, right, s, cols, right_ts=right_ts, right_tie=right_tie,
        prev="_p" if want_prev else None, nxt="_n" if want_next else None,
    )
    t = F.col(s.ts)
    if direction == "nearest":
        hit = _nearer(t, F.col("_p"), F.col("_n"), tolerance)
    else:
        hit = F.col("_p") if want_prev else F.col("_n")
        if tolerance is not None:
            hit = F.when(F.abs(t - hit["ts"]) <= tolerance, hit)
    rows = rows.withColumn("_hit", hit)
    if how == "inner":
        rows = rows.where(F.col("_hit").isNotNull())
    extra = [F.col("_hit.ts").alias(matched_ts)] if matched_ts else []
    return rows.select(*left.columns, *[F.col(f"_hit.{c}").alias(c) for c in cols], *extra)


def sync_all(left: DataFrame, streams: dict[str, DataFrame], s: Series, tolerance: int) -> DataFrame:
    """Matched time of every stream per anchor plus ``synced``, true when no stream is missing."""
    out = asof_many(left, [(table, [], tolerance, False, f"{name}_ts") for name, table in streams.items()], s)
    ok: Column = F.lit(True)
    for name in streams:
        ok = ok & F.col(f"{name}_ts").isNotNull()
    return out.withColumn("synced", ok)
