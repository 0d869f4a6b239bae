"""Nearest points within a radius (C3) for clouds of any density: leaves of bounded size that meet by their boxes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from sensorframe.operators.quantiles import attach
from sensorframe.session import stage

XYZ = ("x", "y", "z")
CELL = [f"_c{c}" for c in XYZ]
LEAF = ["_level", *CELL, "_part"]
LOW, HIGH = [f"_lo_{c}" for c in XYZ], [f"_hi_{c}" for c in XYZ]

# Distinct points of a leaf, and candidates that are compared at once.
LEAF_POINTS = 1000
CHUNK = 2048

# Cells are told apart while their numbers stay below 2**EXACT.
EXACT = 50


def _cell(c: Column, side: float, level: Column) -> Column:
    """Number of the cell of a coordinate; cells of one level lie whole in those of the level before."""
    far = F.lit(2.0**60)
    return F.floor(F.greatest(-far, F.least(far, c / side * F.pow(F.lit(2.0), level))))


def _room(cols: Sequence[Column], side: float) -> Column:
    """Finest level whose cell numbers are exact."""
    most = F.greatest(F.lit(1.0), *[F.abs(c) / side for c in cols])
    return F.greatest(F.lit(0), F.lit(EXACT) - F.ceil(F.log2(most))).cast("int")


def leaves(points: DataFrame, keys: Sequence[str], side: float, most: int) -> DataFrame:
    """``points`` with the leaf (``LEAF``) they lie in: cells are halved on each axis until they hold at most ``most``.

    Cells that no halving can part any more are dealt into parts of about that size.
    """
    cell = [*keys, *CELL]
    rest, found, level = points.withColumn("_room", _room([F.col(c) for c in XYZ], side)), [], 0
    while True:
        rows = rest.select(*points.columns, "_room", *[_cell(F.col(c), side, F.lit(level)).alias(n) for c, n in zip(XYZ, CELL)])
        size = rows.groupBy(*cell).agg(F.count("*").alias("_n"), F.min("_room").alias("_least"))
        sized = stage(attach(rows, size, cell))
        done = (F.col("_n") <= most) | (F.col("_least") <= level)
        part = F.pmod(F.xxhash64(*XYZ), F.ceil(F.col("_n") / most)).cast("int")
        found.append(sized.where(done).select(*points.columns, F.lit(level).alias("_level"), *CELL, part.alias("_part")))
        rest, level = sized.where(~done), level + 1
        if rest.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _squares(parts: Sequence[Column]) -> Column:
    return sum((p * p for p in parts[1:]), parts[0] * parts[0])


def _gap(low: str, high: str, other_low: str, other_high: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(other_low) - F.col(high), F.col(low) - F.col(other_high))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"_k_{k}"])
    for a, b in pairs:
        cond = cond & (left[a] == right[b])
    return cond


def _meetings(units: DataFrame, table: DataFrame, keys: Sequence[str], side: float, count: int) -> DataFrame:
    """``(_q, box, _reach, _leaf)``: the leaves that can hold one of the ``count`` nearest points of a unit.

    A unit looks for leaves in the few cells its reach touches, on the level where cells are as wide as that; leaves
    are found there under every wider cell, wider leaves from the cells around the touched ones.
    """
    lo, hi = [F.col(c) - F.col("_reach") for c in LOW], [F.col(c) + F.col("_reach") for c in HIGH]
    wide = F.greatest(F.lit(2.0**-EXACT), *[(b - a) / side for a, b in zip(lo, hi)])
    level = F.greatest(F.lit(0), F.least(_room([*lo, *hi], side), F.floor(F.log2(F.lit(2.0) / wide)))).cast("int")
    touch = units.withColumn("_at", level)
    for c, a, b in zip(CELL, lo, hi):
        first, last = _cell(a, side, F.col("_at")), _cell(b, side, F.col("_at"))
        touch = touch.withColumn(c, F.explode(F.array_distinct(F.array(first, F.least(first + 1, last), F.greatest(last - 1, first), last))))
    touch = touch.select("_q", *keys, "_at", *CELL)
    up = [F.expr(f"shiftright({c}, _at - _j)").alias(c) for c in CELL]
    above = touch.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_at")))).select("_q", *keys, "_j", *up).distinct()
    named = table.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_level", *[F.col(c).alias(f"_t{c}") for c in CELL], "_leaf")
    cells = [(c, f"_t{c}") for c in CELL]
    whole = above.hint("merge").join(named, _same(above, named, keys, [("_j", "_level"), *cells])).select("_q", "_leaf")
    # Both sides are exploded, so their size is not known beforehand and neither is to be broadcast.
    down = [F.expr(f"shiftright(_t{c}, _level - _j)").alias(f"_t{c}") for c in CELL]
    under = named.where("_level > 0").withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_level") - 1)))
    under = under.select(*[f"_k_{k}" for k in keys], "_j", *down, "_leaf")
    finer = touch.hint("merge").join(under, _same(touch, under, keys, [("_at", "_j"), *cells])).select("_q", "_leaf")
    met = stage(whole.unionByName(finer), "met")

    box = [F.col(c).alias(f"_b{c}") for c in [*LOW, *HIGH]]
    rows = met.join(units.select("_q", *LOW, *HIGH, "_reach"), "_q").join(table.select("_leaf", "_w", *box), "_leaf")
    near = _squares([_gap(a, b, f"_b{a}", f"_b{b}") for a, b in zip(LOW, HIGH)])
    far = _squares([F.greatest(F.col(f"_b{b}") - F.col(a), F.col(b) - F.col(f"_b{a}")) for a, b in zip(LOW, HIGH)])
    rows = rows.withColumn("_near", near).withColumn("_far", far).where(F.col("_near") <= F.col("_reach") * F.col("_reach"))
    # Whole leaves that together hold enough points bound the distance too.
    enough = F.sum("_w").over(W.partitionBy("_q").orderBy("_far")) >= count
    bound = F.min(F.when(F.col("_enough"), F.col("_far"))).over(W.partitionBy("_q"))
    reach = F.least(F.col("_reach"), F.sqrt(F.col("_bound")) * (1 + 1e-6))
    rows = rows.withColumn("_enough", enough).withColumn("_bound", bound).withColumn("_reach", reach)
    return rows.where(F.col("_near") <= F.col("_reach") * F.col("_reach")).select("_q", *LOW, *HIGH, "_reach", "_leaf")


def _searcher(chunk: int) -> tuple[Callable[[np.ndarray, np.ndarray], np.ndarray], type]:
    """Squared distances and the state of a unit's search; made here so that workers need no module of the library."""

    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a[:, None, 0] - b[None, :, 0]) ** 2 + (a[:, None, 1] - b[None, :, 1]) ** 2 + (a[:, None, 2] - b[None, :, 2]) ** 2

    class Nearest:
        """Best candidates of the points of one unit; candidates come in any number of pieces."""

        def __init__(self, q: int, radius: float, count: int):
            self.q, self.limit, self.count = q, radius**2, count
            self.ids, self.own, self.waiting, self.held = [], [], [], 0
            self.at = self.worst = None
            self.row, self.d2, self.pts, self.w = np.empty(0, int), np.empty(0), np.empty((0, 3)), np.empty(0, int)

        def add(self, mine: np.ndarray, ids: np.ndarray, pts: np.ndarray, w: np.ndarray) -> None:
            if mine.any():
                self.ids.append(ids[mine])
                self.own.append(pts[mine])
            if not mine.all():
                self.waiting.append((pts[~mine], w[~mine]))
                self.held += int((~mine).sum())
            if self.held >= chunk:
                self.fold()

        def fold(self) -> None:
            if self.at is None:
                self.at = np.concatenate(self.own)
                self.worst = np.full(len(self.at), self.limit)
            pts, w = (np.concatenate(x) for x in zip(*self.waiting))
            self.waiting, self.held = [], 0
            for i in range(0, len(pts), chunk):
                self._chunk(pts[i:i + chunk], w[i:i + chunk])

        def _chunk(self, pts: np.ndarray, w: np.ndarray) -> None:
            d2 = distances(self.at, pts)
            bound = self.worst
            if len(pts) > self.count:
                bound = np.minimum(bound, np.partition(d2, self.count - 1, axis=1)[:, self.count - 1])
            row, col = np.nonzero(d2 <= bound[:, None])
            row, d2 = np.concatenate([self.row, row]), np.concatenate([self.d2, d2[row, col]])
            pts, w = np.concatenate([self.pts, pts[col]]), np.concatenate([self.w, w[col]])
            order = np.lexsort((pts[:, 2], pts[:, 1], pts[:, 0], d2, row))
            row, d2, pts, w = row[order], d2[order], pts[order], w[order]
            total = np.cumsum(w) - w
            before = total - total[np.searchsorted(row, row)]
            keep = before < self.count
            self.row, self.d2, self.pts, self.w = row[keep], d2[keep], pts[keep], np.minimum(w, self.count - before)[keep]
            full = (before + w >= self.count) & keep
            self.worst = self.worst.copy()
            self.worst[row[full]] = d2[full]

        def fits(self, fit: Callable[[np.ndarray], tuple]) -> Iterator[tuple]:
            if self.held:
                self.fold()
            cuts = np.searchsorted(self.row, np.arange(len(self.at) + 1))
            for i, a, b in zip(np.concatenate(self.ids), cuts[:-1], cuts[1:]):
                yield int(i), *fit(np.repeat(self.pts[a:b], self.w[a:b], axis=0))

    return distances, Nearest


def nearest_fit(
    spots: DataFrame, keys: Sequence[str], radius: float, count: int, fit: Callable[[np.ndarray], tuple], out: Sequence[str],
    leaf_points: int = LEAF_POINTS,
) -> DataFrame:
    """``fit`` of the nearest ``count`` points within ``radius`` of every spot, as doubles ``out`` beside keys and spot.

    ``spots`` are distinct finite ``x, y, z`` per key, with the number of points there in ``_m``; a spot's own points
    come first, ties go by x, y, z. Spots are cut into leaves of bounded size. The own leaf bounds the distance of the
    nearest points, so a leaf meets the few leaves around it, whatever the density; points of leaves with too few
    points look around each by itself. Tasks read candidates as a stream and keep only the best.
    """
    most, side = max(leaf_points, count), 4.0 * radius
    distances, Nearest = _searcher(CHUNK)
    span = [*keys, *LEAF]
    held = F.least(F.col("_m"), F.lit(count)).cast("int").alias("_m")
    placed = leaves(spots.select(*keys, *XYZ, held), keys, side, most)
    box = [*[F.min(c).alias(n) for c, n in zip(XYZ, LOW)], *[F.max(c).alias(n) for c, n in zip(XYZ, HIGH)]]
    table = stage(placed.groupBy(*span).agg(F.sum("_m").alias("_w"), *box).withColumn("_leaf", F.monotonically_increasing_id()), "leaves")
    pts = attach(placed, table.select(*span, "_w", "_leaf"), span, written=True).withColumn("_i", F.monotonically_increasing_id())
    alone = F.col("_w") < count
    pts = stage(pts.select(*keys, *XYZ, "_m", "_level", "_leaf", "_i", "_w"), "points").withColumn("_q", F.when(alone, -1 - F.col("_i")).otherwise(F.col("_leaf")))

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        p, m = pdf[list(XYZ)].to_numpy(), pdf["_m"].to_numpy()
        d2 = distances(p, p)
        if len(p) >= count:
            far = np.partition(d2, count - 1, axis=1)[:, count - 1]
        else:
            order = np.argsort(d2, axis=1)
            first = (np.cumsum(m[order], axis=1) >= count).argmax(axis=1)
            far = np.take_along_axis(d2, np.take_along_axis(order, first[:, None], 1), 1)
        return pd.DataFrame({"_leaf": pdf["_leaf"].iloc[:1], "_far": [math.sqrt(min(far.max(), radius**2))]})

    far = pts.where(~alone).select("_leaf", *XYZ, "_m").groupBy("_leaf").applyInPandas(own, "_leaf long, _far double")
    slack = 1 + 1e-6
    big = table.join(far, "_leaf").select(F.col("_leaf").alias("_q"), *keys, *LOW, *HIGH, (F.col("_far") * slack).alias("_reach"))
    # The cell that a leaf was cut from holds more than enough points.
    parent = F.when(F.col("_level") > 0, F.lit(math.sqrt(3.0) * side * 2) / F.pow(F.lit(2.0), "_level")).otherwise(radius)
    small = pts.where(alone).select(
        "_q", *keys, *[F.col(c).alias(n) for c, n in zip(XYZ, LOW)], *[F.col(c).alias(n) for c, n in zip(XYZ, HIGH)],
        (F.least(F.lit(radius), parent) * slack).alias("_reach"),
    )
    pairs = stage(_meetings(stage(big.unionByName(small), "units"), table, keys, side, count), "pairs")
    off = _squares([_gap(a, b, c, c) for a, b, c in zip(LOW, HIGH, XYZ)])
    near = pairs.join(pts.select("_leaf", *XYZ, "_m"), "_leaf").where(off <= F.col("_reach") * F.col("_reach"))
    mine = pts.select("_q", F.lit(0).alias("_kind"), "_i", *XYZ, "_m")
    stream = mine.unionByName(near.select("_q", F.lit(1).alias("_kind"), F.lit(-1).cast("long").alias("_i"), *XYZ, "_m"))
    stream = stream.repartition("_q").sortWithinPartitions("_q", "_kind")
    names = ["_i", *out]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for pdf in batches:
            q, mine, ids, w = (pdf[c].to_numpy() for c in ("_q", "_kind", "_i", "_m"))
            pts, done = pdf[list(XYZ)].to_numpy(), []
            cuts = np.flatnonzero(np.diff(q)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(q)]):
                if b > a and (now is None or now.q != q[a]):
                    if now is not None:
                        done.extend(now.fits(fit))
                    now = Nearest(q[a], radius, count)
                if b > a:
                    now.add(mine[a:b] == 0, ids[a:b], pts[a:b], w[a:b])
            yield pd.DataFrame(done, columns=names)
        if now is not None:
            yield pd.DataFrame(list(now.fits(fit)), columns=names)

    fitted = stream.mapInPandas(search, T.StructType([T.StructField("_i", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in out]]))
    return pts.select(*keys, *XYZ, "_i").join(fitted, "_i").drop("_i")
