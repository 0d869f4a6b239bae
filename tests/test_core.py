import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorframe.operators.asof import asof_join
from sensorframe.operators.ordered import Series, number_rows, prev_next, rolling, running_sum
from sensorframe.operators.quantiles import exact_quantiles


def series_frame(n=900, seed=3):
    rng = np.random.default_rng(seed)
    # One key holds most rows; times repeat never, buckets are small so that every border case occurs.
    key = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 6, n))
    ts = rng.permutation(n * 5)[:n].astype("int64") - 700
    return pd.DataFrame({"k": key, "ts": ts, "v": rng.normal(size=n).round(3)})


TINY = Series(["k"], cell_ns=97, target_rows=7)


def test_order_primitives(spark):
    pdf = series_frame()
    df = spark.createDataFrame(pdf)
    want = pdf.sort_values(["k", "ts"]).reset_index(drop=True)
    g = want.groupby("k")
    want["rn"] = g.cumcount()
    want["cs"] = g["v"].cumsum()
    want["pv"] = g["v"].shift(1)
    want["nv"] = g["v"].shift(-1)
    out = number_rows(df, TINY)
    out = running_sum(out, TINY, {"cs": F.col("v")})
    out = prev_next(out, TINY, ["v"], "p", "n")
    got = out.select("k", "ts", "rn", "cs", F.col("p.v").alias("pv"), F.col("n.v").alias("nv")).toPandas()
    got = got.sort_values(["k", "ts"]).reset_index(drop=True)
    for c in ("rn", "cs", "pv", "nv"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=1e-9)


def test_rolling_rows(spark):
    pdf = series_frame(400)
    df = spark.createDataFrame(pdf)
    out = rolling(df, TINY, 3, 2, lambda w: [F.sum("v").over(w.rowsBetween(-3, 2)).alias("s")], rows=5)
    got = out.toPandas().sort_values(["k", "ts"]).reset_index(drop=True)
    want = pdf.sort_values(["k", "ts"]).reset_index(drop=True)
    exp = []
    for _, g in want.groupby("k"):
        v = g.v.to_numpy()
        exp += [v[max(0, i - 3): i + 3].sum() for i in range(len(v))]
    assert len(got) == len(want)
    np.testing.assert_allclose(got.s, exp, atol=1e-9)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_asof_matches_pandas(spark, direction):
    rng = np.random.default_rng(5)
    left = pd.DataFrame({"k": rng.integers(0, 4, 500), "ts": rng.integers(0, 3000, 500), "lid": range(500)})
    right = pd.DataFrame({"k": rng.integers(0, 4, 300), "ts": rng.integers(0, 3000, 300), "rid": range(300)})
    left, right = left.sort_values(["ts", "lid"]), right.sort_values(["ts", "rid"])
    want = pd.merge_asof(left, right, on="ts", by="k", direction=direction, tolerance=6)
    s = Series(["k"], cell_ns=50, target_rows=5)
    got = asof_join(
        spark.createDataFrame(left), spark.createDataFrame(right), s, ["rid"],
        direction=direction, tolerance=6, right_tie="rid",
    ).toPandas()
    a = want.set_index("lid").rid.sort_index()
    b = got.set_index("lid").rid.sort_index()
    pd.testing.assert_series_equal(a.astype(float), b.astype(float))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.5, 0, rng.integers(1, 5, n))})
    pdf["v"] = rng.lognormal(0, 3, n) * np.where(rng.random(n) < 0.5, -1, 1)
    pdf["w"] = 1.7e18 + rng.integers(0, 10_000_000, n) * 256.0
    pdf.loc[pdf.k == 3, "v"] = 2.5
    for bounded in (0, 10_000):
        check_quantiles(spark, pdf, bounded)


def check_quantiles(spark, pdf, bounded):
    out = exact_quantiles(
        spark.createDataFrame(pdf), ["k"],
        {"med": (F.col("v"), 0.5), "p95": (F.col("v"), 0.95), "w": (F.col("w") - F.lit(1.7e18), 0.5)},
        bounded_rows=bounded,
    ).toPandas().set_index("k").sort_index()
    g = pdf.groupby("k")
    np.testing.assert_allclose(out.med, g.v.median(), rtol=1e-12)
    np.testing.assert_allclose(out.p95, g.v.quantile(0.95), rtol=1e-12)
    np.testing.assert_allclose(out.w, (pdf.w - 1.7e18).groupby(pdf.k).median(), rtol=1e-12)
