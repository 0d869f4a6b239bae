"""Operator 6: exact top-k by inner product, with the bounds of sorted lists.

Vectors are packed into blocks; every block of queries meets every block of vectors in a row of its own. Within a block each
component has a list of its values in order, kept as places. For a query all products of a block are taken at once, and the lists are
masks over them: at each depth, the products within it, with the best and worst that the rest can give, bound a vector's score.
Vectors that cannot reach the k-th best lower bound any more are out; when few are left, or the lists end, their scores are resolved.
Nothing is read step by step; ending early saves no products.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Values of a block of vectors, and queries in a block.
BLOCK_VALUES = 1 << 16
BLOCK_QUERIES = 128
# Groups that vectors are dealt into, each of which meets each block of queries.
DEALT = 64
# How far into the lists bounds are taken, and how few vectors left are resolved at once.
DEPTHS = (0.5, 0.9, 1.0)
FEW = 64
# Bytes of a component in a block; components beyond 8 bytes are written as decimal numbers (0).
_SIZES = {4: "<i4", 8: "<i8"}
_BLOCK = "dim int, size int, rows int, ids binary, vectors binary"


def _pack(x: np.ndarray, values: np.ndarray, scale: int) -> tuple[int, bytes]:
    """A vector of finite values, scaled to the whole numbers ``x``, in the smallest size that holds it."""
    largest = np.abs(x).max()
    for size, kind in _SIZES.items():
        if largest < 1 << (8 * size - 1):
            return size, x.astype(kind).tobytes()
    whole = (int(y) if np.isfinite(y) else floor(Fraction(v) * scale) for y, v in zip(x.tolist(), values.tolist()))
    return 0, b"".join(b"%d " % w for w in whole)


def _unpack(size: int, rows: int, dim: int, data: bytes) -> np.ndarray:
    """The vectors of a block as longs, or as Python numbers where longs don't hold them."""
    if size:
        return np.frombuffer(data, _SIZES[size]).reshape(rows, dim).astype(np.int64)
    return np.array([int(w) for w in data.split()], object).reshape(rows, dim)


def _blocks(vectors: DataFrame, scale: int, rows_of) -> DataFrame:
    """Vectors as blocks of integers; those that are null, empty or hold null or non-finite components are left out."""
    schema = pa.schema([("dim", pa.int32()), ("size", pa.int32()), ("rows", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list] = {}

        def out(dim, size, rows):
            ids = np.array([r[0] for r in rows], "<i8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([size], pa.int32()), pa.array([len(rows)], pa.int32()), pa.array([ids]), pa.array([b"".join(r[1] for r in rows)])], schema=schema)

        for batch in batches:
            for vec_id, values in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                if vec_id is None or not values.is_valid or not len(values.values) or values.values.null_count:
                    continue
                values = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(values).all():
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(scale * values)
                size, packed = _pack(x, values, scale)
                rows = waiting.setdefault((len(x), size), [])
                rows.append((vec_id, packed))
                if len(rows) >= rows_of(len(x)):
                    yield out(len(x), size, waiting.pop((len(x), size)))
        for (dim, size), rows in waiting.items():
            yield out(dim, size, rows)

    return vectors.select("vec_id", "embedding").mapInArrow(run, _BLOCK)


def _floats(x: np.ndarray) -> np.ndarray:
    """The nearest floating numbers; infinite where there is none."""
    if x.dtype != object:
        return x.astype(np.float64)
    return np.array([float(v) if abs(v) < 1 << 1023 else np.inf if v > 0 else -np.inf for v in x.ravel()], np.float64).reshape(x.shape)


def _sortable(x: int) -> str:
    """A number beyond longs as text; texts of one sign sort as their numbers."""
    digits = str(abs(x))
    text = f"{len(digits):06d}{digits}"
    return f"+{text}" if x > 0 else "-" + text.translate(str.maketrans("0123456789", "9876543210"))


class SortedLists:
    """The lists of one block: of each component, the vectors from the smallest value to the largest."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        # Python's own abs() and max(): that of the smallest long is no long.
        self.largest = max(abs(int(vectors.max(initial=0))), abs(int(vectors.min(initial=0))))
        self.floats = _floats(vectors)
        if vectors.dtype == object:
            return
        order = np.argsort(vectors, axis=0, kind="stable")
        self.place = np.empty(order.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=np.int32)[:, None], axis=0)
        self.values = np.take_along_axis(vectors, order, axis=0)

    def wide(self, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``best`` among some rows, for products that longs don't hold: bounds in floating numbers, then Python numbers."""
        if len(rows) > k:
            q, v = _floats(query), self.floats[rows]
            with np.errstate(all="ignore"):
                about = v @ q
                error = (len(q) + 8) * 2.0**-51 * (np.abs(v) @ np.abs(q))
                least = np.partition(about - error, len(rows) - k)[len(rows) - k]
                # NaN, from numbers that no floating number holds, keeps the row.
                rows = rows[~(about + error < least)]
        weights = query.tolist()
        scores = [sum(a * b for a, b in zip(x, weights)) for x in self.vectors[rows].tolist()]
        first = sorted(range(len(rows)), key=lambda i: (-scores[i], self.ids[rows[i]]))[:k]
        return self.ids[rows[first]] if first else self.ids[:0], np.array([scores[i] for i in first], object)

    def best(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best for a query, ties to the smaller id; its own id is left out."""
        n = len(self.ids)
        rows = np.flatnonzero(self.ids != own)
        most = len(query) * self.largest * max(abs(int(query.max(initial=0))), abs(int(query.min(initial=0))))
        if most >= 1 << 63 or query.dtype == object or self.vectors.dtype == object:
            return self.wide(rows, query, k)
        # Floating numbers are faster, and exact while all sums stay below 2^53.
        exact = most < 1 << 53
        kind = np.float64 if exact else np.int64
        q = query.astype(kind)
        # Each list counts from its better end: the largest value for a positive weight, the smallest for a negative one.
        up = query > 0
        place = np.where(up, n - 1 - self.place, self.place)[rows]
        part = ((self.floats if exact else self.vectors) * q)[rows]
        worst = np.where(up, self.values[0], self.values[-1]) * q
        for depth in DEPTHS:
            high = int(n * depth)
            if len(rows) <= max(2 * k, FEW) or not high:
                continue
            read = place < high
            unread = (~read).astype(kind)
            sums = np.where(read, part, 0).sum(axis=1)
            now = np.where(up, self.values[n - high], self.values[high - 1]) * q
            least, most = sums + unread @ worst, sums + unread @ now
            stays = most >= np.partition(least, len(least) - k)[len(least) - k]
            rows, place, part = rows[stays], place[stays], part[stays]
        score = self.vectors[rows] @ query
        first = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][first], score[first]


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k vectors of the largest integer inner product with each query.

    Components count as floor(scale * x). Vectors that are null, empty, or hold null or non-finite components take no
    part, nor do rows without vec_id; a query meets vectors of its own length only. A query never meets rows of its own vec_id.
    Ranks are exact for components of any size; a score that no long holds is null. Repeated rows of ``vectors`` are candidates each; repeated equal rows of ``queries`` are asked once.
    Ties go to the smaller vec_id.
    """
    q = _blocks(queries.select("vec_id", "embedding").distinct(), scale, lambda dim: BLOCK_QUERIES)
    q = q.select("dim", F.col("size").alias("q_size"), F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("part"))
    v = _blocks(vectors, scale, lambda dim: max(1, BLOCK_VALUES // dim))
    v = v.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(DEALT)).cast("int"))
    schema = pa.schema([("query_id", pa.int64()), ("query", pa.binary()), ("vec_id", pa.int64()), ("score", pa.int64()), ("wide", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = lists = None
            for r in range(batch.num_rows):
                dim, size, rows, ids, vecs, q_size, q_rows, q_ids, q_vecs = (batch.column(c)[r].as_py() for c in ("dim", "size", "rows", "ids", "vectors", "q_size", "q_rows", "q_ids", "q_vectors"))
                if (ids, size, vecs) != last:
                    last = (ids, size, vecs)
                    lists = SortedLists(np.frombuffer(ids, "<i8"), _unpack(size, rows, dim, vecs))
                own = np.frombuffer(q_ids, "<i8")
                asked = _unpack(q_size, q_rows, dim, q_vecs)
                found = [lists.best(own[i], asked[i], k) for i in range(q_rows)]
                many = [len(f[0]) for f in found]
                key = [asked[i].astype(_SIZES[q_size]).tobytes() if q_size else repr(asked[i].tolist()).encode() for i in range(q_rows)]
                scores = [x for f in found for x in f[1].tolist()]
                long = [-(1 << 63) <= x < 1 << 63 for x in scores]
                score = [x if fits else None for x, fits in zip(scores, long)]
                wide = [None if fits else _sortable(x) for x, fits in zip(scores, long)]
                arrays = [np.repeat(own, many), [x for x, n in zip(key, many) for _ in range(n)], np.concatenate([f[0] for f in found]), score, wide]
                yield pa.RecordBatch.from_arrays([pa.array(a, t.type) for a, t in zip(arrays, schema)], schema=schema)

    found = v.join(q, ["dim", "part"]).mapInArrow(run, "query_id bigint, query binary, vec_id bigint, score bigint, wide string")
    # Scores above all longs, longs, those below.
    kind = F.when(F.col("wide").isNull(), 0).when(F.col("wide").startswith("+"), 1).otherwise(-1)
    w = Window.partitionBy("query_id", "query").orderBy(kind.desc(), F.desc("score"), F.desc("wide"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
