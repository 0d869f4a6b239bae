"""Nearest points of dense clouds: same as brute force, with candidates that don't grow with the density."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorframe.operators import nearest, pointcloud

AXES = list("xyz")


def brute(pts, radius, count):
    out = []
    for p in pts:
        d2 = ((pts - p) ** 2).sum(axis=1)
        order = np.lexsort((pts[:, 2], pts[:, 1], pts[:, 0], d2))[:count]
        near = pts[order[d2[order] <= radius**2]]
        out.append([len(near), near.sum(), near[-1] @ [1.0, 10.0, 100.0]])
    return np.array(out)


def search(spark, pts, radius, count, leaf):
    df = spark.createDataFrame(pd.DataFrame(pts, columns=AXES).assign(s=0))

    def told(p):
        return float(len(p)), float(p.sum()), float(p[-1] @ np.array([1.0, 10.0, 100.0]))

    spots = df.groupBy("s", *AXES).agg(F.count("*").alias("_m"))
    return nearest.nearest_fit(spots, ["s"], radius, count, told, ["n", "total", "last"], leaf_points=leaf)


@pytest.mark.parametrize("leaf", [16, 1000])
def test_against_brute_force(spark, leaf):
    rng = np.random.default_rng(3)
    clump = 0.3 + 1e-3 * rng.normal(size=(400, 3))
    plane = np.column_stack([rng.random((300, 2)), np.full(300, -0.2)])
    lattice = np.stack(np.meshgrid(*[np.arange(6) / 16.0] * 3), -1).reshape(-1, 3) - 3.0
    wide = rng.normal(size=(300, 3)) * 5
    copies = np.repeat(rng.random((3, 3)), [1, 8, 200], axis=0)
    far = np.array([[1e15, 0.0, 0.0], [1e15, 0.01, 0.0], [-1e300, 1.0, 1.0], [-1e300, 1.05, 1.0]])
    pts = np.concatenate([clump, plane, lattice, wide, copies, far])
    got = search(spark, pts, 0.1, 12, leaf).toPandas()
    assert len(got) == len(np.unique(pts, axis=0))
    want = pd.DataFrame(np.column_stack([pts, brute(pts, 0.1, 12)]), columns=[*AXES, "n", "total", "last"]).drop_duplicates(AXES)
    both = got.merge(want, on=AXES)
    assert len(both) == len(got)
    assert (both.n_x == both.n_y).all() and (both.last_x == both.last_y).all()
    np.testing.assert_allclose(both.total_x, both.total_y, rtol=1e-12)


def test_candidates_do_not_grow_with_density(spark, monkeypatch):
    # All points within the radius of each other: compared each with each before.
    rng = np.random.default_rng(4)
    seen = []
    meet = nearest._meetings

    def counted(*args):
        out = meet(*args)
        seen.append(out.count() / args[1].count())
        return out

    monkeypatch.setattr(nearest, "_meetings", counted)
    for n in (1000, 6000):
        assert search(spark, rng.random((n, 3)) * 0.05, 0.1, 8, 64).count() == n
    # Leaves grow eightfold, those that a leaf meets by the smaller share of leaves at the rim only.
    assert seen[1] < 2.5 * seen[0]


def test_normals_of_copies_and_odd_points(spark):
    rng = np.random.default_rng(5)
    pts = np.column_stack([rng.random((300, 2)) * 0.2, np.full(300, 0.5)])
    pts = np.concatenate([pts, np.repeat(pts[:1], 3000, axis=0)])
    odd = [(float(a), 0.0, 0.0, 0, 3300 + i) for i, a in enumerate(("nan", "inf", "-inf"))]
    df = spark.createDataFrame(pd.DataFrame(pts, columns=AXES).assign(s=0, id=range(len(pts)))).union(spark.createDataFrame(odd, [*AXES, "s", "id"]))
    got = pointcloud.normals(df, ["s"], "id", 0.1).toPandas()
    assert sorted(got.id) == list(range(3303))
    plane = got[(got.id > 0) & (got.id < 300)]
    assert (plane.nz.abs() > 0.999).sum() > 250 and (got[got.id >= 3300].nz == 1.0).all()
