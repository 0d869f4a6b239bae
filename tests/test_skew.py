"""One key with most rows, all inside one cell: buckets must split it and results must not change."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sensorframe.operators import ordered
from sensorframe.operators.asof import asof_join
from sensorframe.operators.intervals import gap_sequences
from sensorframe.operators.ordered import Series, bucketed


def hot_frame():
    rng = np.random.default_rng(11)
    hot = pd.DataFrame({"k": 0, "ts": rng.permutation(40_000)[:2000] + 5_000_000})
    cold = pd.DataFrame({"k": rng.integers(1, 5, 1000), "ts": rng.permutation(10_000_000)[:1000]})
    pdf = pd.concat([hot, cold], ignore_index=True)
    pdf["id"] = range(len(pdf))
    return pdf


HOT = Series(["k"], cell_ns=1_000_000, target_rows=100)


def check(spark, pdf):
    df = spark.createDataFrame(pdf)
    sizes = bucketed(df, HOT).groupBy("k", "_b").count().agg(F.max("count")).first()[0]
    assert sizes <= 100
    want = pdf.sort_values(["k", "ts"]).copy()
    want["seq"] = (want.groupby("k").ts.diff() > 500).groupby(want.k).cumsum()
    got = gap_sequences(df, HOT, 500).toPandas().set_index("id").seq.sort_index()
    assert (got == want.set_index("id").seq.sort_index()).all()
    left = pdf[pdf.id % 2 == 0].sort_values("ts")
    right = pdf[pdf.id % 2 == 1].rename(columns={"id": "rid"}).sort_values("ts")
    exp = pd.merge_asof(left, right, on="ts", by="k", direction="nearest").set_index("id").rid.sort_index()
    res = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), HOT, ["rid"]).toPandas().set_index("id").rid.sort_index()
    pd.testing.assert_series_equal(exp.astype(float), res.astype(float))


def test_hot_cell_broadcast(spark):
    check(spark, hot_frame())


def test_hot_cells_beyond_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(ordered, "HOT_CELLS", 0)
    check(spark, hot_frame())


def test_names_of_one_prefix_are_numbered_in_many_tasks(spark):
    from sensorframe.operators.ordered import place_in_group

    names = spark.range(20000).selectExpr("id % 2 as g", "concat('recording_000000', lpad(cast(id * 7919 % 20000 as string), 6, '0')) as name")
    got = place_in_group(names, ["g"], ["name"], "i")
    rows = sorted((r.g, r.name, r.i) for r in got.collect())
    at = {}
    for g, _, i in rows:
        assert i == at.get(g, 0)
        at[g] = i + 1
    assert at == {0: 10000, 1: 10000}
