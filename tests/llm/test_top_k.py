"""Exact top-k against brute force."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from sensorframe.llm import top_k


def brute(rows, queries, k, scale):
    def scaled(v):
        if not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(Fraction(x) * scale) for x in v]

    good = [(i, e) for i, v in rows if i is not None and (e := scaled(v)) is not None]
    out = []
    for q, e in {(i, tuple(e)) for i, v in queries if i is not None and (e := scaled(v)) is not None}:
        scores = sorted(((-sum(a * b for a, b in zip(e, f)), i) for i, f in good if i != q and len(f) == len(e)))[:k]
        out += [(q, r + 1, i, -s if -2**63 <= -s < 2**63 else None) for r, (s, i) in enumerate(scores)]
    return sorted(out, key=lambda r: r[:2])


@pytest.mark.parametrize("kind", ["spread", "ties"])
def test_against_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK_VALUES", 40 * 6)
    pick = random.Random(3)
    value = (lambda: float(np.float32(pick.gauss(0, 0.4)))) if kind == "spread" else (lambda: pick.choice([-1.0, 0.0, 0.5]))
    rows = [(i, [value() for _ in range(6)]) for i in range(350)]
    rows += [(1, rows[1][1]), (500, None), (600, []), (700, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (800, [math.nan] * 6), (900, [math.inf] + [0.0] * 5), (None, [1.0] * 6)]
    rows += [(1000, [0.0] * 6), (1100, [1.0, 2.0, 3.0]), (1101, [1.0, 2.0, -3.0]), (1200, [1e30] * 6), (-100, [-0.3] * 6), (1300, [2.0])]
    df = spark.createDataFrame([(i, v, 5, 6) for i, v in rows], "vec_id bigint, embedding array<float>, rank int, dim int").repartition(3)
    queries = [(i, v) for i, v in rows if i is not None and i % 100 == 0]
    got = top_k.top_k(df.where("vec_id % 100 = 0"), df, 10, 1024).collect()
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    queries32 = [(i, v) for i, v in rows32 if i is not None and i % 100 == 0]
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == brute(rows32, queries32, 10, 1024)
    assert queries


def test_few_rows_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in top_k.top_k(df.where("vec_id = 0"), df).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert top_k.top_k(df.limit(0), df).count() == 0
    assert top_k.top_k(df, df.limit(0)).count() == 0


def test_reading_stops_early():
    rng = np.random.default_rng(1)
    base = rng.integers(-300, 300, 16)
    vectors = np.concatenate([rng.integers(-20, 20, (500, 16)), base + rng.integers(-5, 5, (12, 16))]).astype(np.int64)
    ids = np.arange(512)
    got, score = top_k.SortedLists(ids, vectors).best(-1, base.astype(np.int64), 10)
    want = np.lexsort((ids, -(vectors @ base)))[:10]
    assert (got == want).all() and (score == (vectors @ base)[want]).all()


def whole_scores(rows, queries, k, scale=1024):
    """Brute force over all finite vectors, whatever their size; scores that no long holds are null."""
    def scaled(v):
        return None if not v or any(x is None or not math.isfinite(x) for x in v) else [math.floor(Fraction(x) * scale) for x in v]

    good = [(i, e) for i, v in rows if (e := scaled(v)) is not None]
    out = []
    for q, e in {(i, tuple(e)) for i, v in queries if (e := scaled(v)) is not None}:
        scores = sorted((-sum(a * b for a, b in zip(e, f)), i) for i, f in good if i != q and len(f) == len(e))[:k]
        out += [(q, r + 1, i, -s if -2**63 <= -s < 2**63 else None) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_components_of_any_size(spark, kind, monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK_VALUES", 40 * 5)
    pick = random.Random(5)
    sizes = [0.4, 1e3, 16384.0, 3e5, 2.0**21, 1e8, 2.0**53, 1e18, 1e30] + ([1e200, 1.7e308] if kind == "double" else [])
    cast = (lambda x: float(np.float32(x))) if kind == "float" else float
    rows = [(i, [cast(pick.uniform(-1, 1) * pick.choice(sizes[:i % len(sizes) + 1])) for _ in range(5)]) for i in range(300)]
    rows += [(1000 + i, [cast(x)] * 5) for i, x in enumerate([2.0**14, -(2.0**14), 2.0**21, -(2.0**53), 1e30, -1e30, 1e30])]
    rows += [(2000, [math.inf] * 5), (2001, [math.nan] * 5)]
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").repartition(3)
    got = sorted((tuple(r) for r in top_k.top_k(df.where("vec_id % 10 = 0 or vec_id >= 1000"), df, 10).collect()), key=lambda r: r[:2])
    assert got == whole_scores(rows, [r for r in rows if r[0] % 10 == 0 or r[0] >= 1000], 10)
