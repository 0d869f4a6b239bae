"""The dynamic tool fit: known tools, indefinite data, noise and outliers; the candidate sweep."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sensorframe.operators import fits
from sensorframe.operators.ordered import Series
from sensorframe.plans import wrench as wplan

VECTORS = ("f", "t", "g", "a", "o", "l")


def columns():
    return [[F.col(f"{p}{a}") for a in "xyz"] for p in VECTORS]


def times_inertia(i, v):
    xx, yy, zz, xy, xz, yz = i
    return v @ np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]])


def model(v, mass, cog, f0, t0, inertia, gyro):
    a_c = v["a"] + np.cross(v["l"], cog) + np.cross(v["o"], np.cross(v["o"], cog))
    force = mass * (v["g"] + a_c)
    torque = np.cross(cog, force) + times_inertia(inertia, v["l"])
    if gyro:
        torque = torque + np.cross(v["o"], times_inertia(inertia, v["o"]))
    return force + f0, torque + t0


def cost(v, theta, mass, gyro):
    f, t = model(v, mass, theta[6:9], theta[:3], theta[3:6], theta[9:], gyro)
    r = np.hstack([v["f"] - f, v["t"] - t])
    return (np.sqrt(1 + r * r) - 1).sum()


def made(rng, n, inertia, noise, gyro, mass=0.49, cog=(0.02, 0.01, 0.06), f0=(1.0, -2.0, 0.5), t0=(0.1, 0.05, -0.2)):
    v = {p: rng.normal(size=(n, 3)) * (9 if p == "g" else 3) for p in "gaol"}
    f, t = model(v, mass, np.array(cog), np.array(f0), np.array(t0), inertia, gyro)
    v["f"], v["t"] = f + noise * rng.standard_t(2, (n, 3)), t + noise * rng.standard_t(2, (n, 3))
    return v


def frame(spark, groups):
    parts = []
    for rec, v in groups.items():
        pdf = pd.DataFrame(np.hstack([v[p] for p in VECTORS]), columns=[f"{p}{a}" for p in VECTORS for a in "xyz"])
        parts.append(pdf.assign(rec=rec))
    return spark.createDataFrame(pd.concat(parts)).repartition(5)


def theta_of(r):
    return np.array([r[c] for c in (*fits.F0, *fits.TAU0, *fits.COG, *fits.INERTIA)])


def test_minimum_among_definite_inertias(spark):
    """Noise with outliers, and data of an inertia that no body has: nothing near by is better, and every inertia is positive definite."""
    rng = np.random.default_rng(3)
    good, bad = (0.012, 0.015, 0.02, 0.001, -0.002, 0.0005), (0.3, -0.2, 0.25, 0.05, 0.0, 0.1)
    for free in (False, True):
        groups = {"good": made(rng, 300, good, 0.05, True), "loud": made(rng, 200, good, 0.5, True)} | ({} if free else {"bad": made(rng, 300, bad, 0.1, True)})
        out = {r.rec: r for r in fits.tool_params_dynamic(frame(spark, groups), ["rec"], *columns(), mass=0.49, cog=(0.02, 0.01, 0.06), fit_cog=free, gyro=True).collect()}
        for rec, v in groups.items():
            r = out[rec]
            theta = theta_of(r)
            assert r.inertia_is_spd and r.moment1 > 0 and r.n == len(v["f"]) and r.status in ("converged", "not converged")
            at = cost(v, theta, 0.49, True)
            np.testing.assert_allclose(r.cost, at, rtol=1e-6)
            if rec != "bad":
                assert r.converged
            for _ in range(60):
                low = fits._factor(fits._factor_of(theta[9:]))
                low = low + np.tril(rng.normal(size=(3, 3))) * 1e-3
                m = low @ low.T
                near = np.r_[theta[:9] + rng.normal(size=9) * 1e-3 * np.r_[np.ones(6), np.full(3, float(free))], m[0, 0], m[1, 1], m[2, 2], m[0, 1], m[0, 2], m[1, 2]]
                assert cost(v, near, 0.49, True) >= at * (1 - 1e-7)
        theta = theta_of(out["good"])
        np.testing.assert_allclose(theta[9:], good, atol=0.01)


def test_rows_that_cannot_be_used(spark):
    rng = np.random.default_rng(4)
    inertia = (0.012, 0.015, 0.02, 0.001, -0.002, 0.0005)
    v, w = made(rng, 80, inertia, 0.0, False), made(rng, 5, inertia, 0.0, False)
    v["f"][3, 1], v["o"][7, 0] = np.nan, np.inf
    w["t"][:] = np.nan
    df = frame(spark, {"some": v, "none": w})
    out = {r.rec: r for r in fits.tool_params_dynamic(df, ["rec"], *columns(), mass=0.49, cog=(0.02, 0.01, 0.06)).collect()}
    assert out["some"].converged and out["some"].n == 78 and out["some"].rmsT < 1e-6
    assert out["none"].status == "no usable rows" and not out["none"].converged and out["none"].n == 0
    np.testing.assert_allclose([out["some"][c] for c in fits.INERTIA], inertia, atol=1e-7)
    assert fits.tool_params_dynamic(df.limit(0), ["rec"], *columns(), mass=0.49, cog=(0.0, 0.0, 0.0)).count() == 0
    loud = frame(spark, {"loud": made(rng, 80, inertia, 0.5, False)})
    few = fits.tool_params_dynamic(loud, ["rec"], *columns(), mass=0.49, cog=(0.02, 0.01, 0.06), rounds=1).collect()[0]
    assert few.status == "not converged" and few.rounds == 1


def test_slopes_of_the_factor():
    rng = np.random.default_rng(5)
    for _ in range(20):
        theta = rng.normal(size=6)
        slope = fits._inertia_slope(theta)
        for k in range(6):
            step = np.zeros(6)
            step[k] = 1e-6
            np.testing.assert_allclose((fits._inertia_of(theta + step) - fits._inertia_of(theta - step)) / 2e-6, slope[:, k], atol=1e-6)
        np.testing.assert_allclose(fits._inertia_of(theta), fits._inertia_of(fits._factor_of(fits._inertia_of(theta))), rtol=0.05, atol=0.2)


def test_calibration_finds_what_the_rows_were_made_with(spark):
    rng = np.random.default_rng(6)
    rows = []
    for rec in range(2):
        for i in range(160):
            q = rng.normal(size=4)
            rows.append((rec, i * 10_000_000, *(q / np.linalg.norm(q)).tolist(), *rng.normal(size=6).tolist()))
    names = ["rec", "ts", "qx", "qy", "qz", "qw", "vx", "vy", "vz", "ox", "oy", "oz"]
    poses = spark.createDataFrame(pd.DataFrame(rows, columns=names))
    smoothings = [wplan.Smoothing(5, 2, 5, 2), wplan.Smoothing(11, 3, 9, 2)]
    s, eye, lever = Series(["rec"]), (1, 0, 0, 0, 1, 0, 0, 0, 1), (0.1, 0.0, 0.2)
    offset = {0: 0, 1: 7_000_000}
    inertia, cog = (0.05, 0.06, 0.07, 0.001, -0.002, 0.0005), (0.02, 0.01, 0.06)
    # Beyond the last pose, too: these samples are outside for every candidate.
    t = pd.DataFrame([(rec, i * 10_000_000 + 2_000_000, *rng.normal(size=3).tolist()) for rec in range(2) for i in range(165)], columns=["rec", "ts", "gx", "gy", "gz"])
    parts = []
    for rec in range(2):
        at = spark.createDataFrame(t[t.rec == rec].assign(ts=lambda d: d.ts + offset[rec]))
        c = smoothings[rec]
        sig = wplan.smoothed_signals(poses.where(f"rec = {rec}"), s, (c.linear_window, c.angular_window), (c.linear_order, c.angular_order))
        pdf = wplan.signals_at(at, sig, s, device_sensor=eye, lever=lever).toPandas()
        v = {p: pdf[[f"{p}{a}" for a in "xyz"]].to_numpy() for p in "gaol"}
        f, torque = model(v, 0.5, np.array(cog), np.array([1.0, 2.0, 3.0]), np.array([0.1, 0.2, 0.3]), inertia, rec == 0)
        out = pdf[["rec", "ts", "gx", "gy", "gz"]].assign(ts=lambda d: d.ts - offset[rec])
        out[["fx", "fy", "fz"]], out[["tx", "ty", "tz"]] = f, torque
        parts.append(out)
    wrench = spark.createDataFrame(pd.concat(parts))
    fixed = dict(device_sensor=eye, lever=lever, mass=0.5, cog=cog)
    bank = wplan.signal_bank(poses, s, smoothings)
    table = spark.createDataFrame([(k, sm, gy, off) for k, (sm, gy, off) in enumerate((sm, gy, off) for sm in (0, 1) for gy in (False, True) for off in (0, 7_000_000))], wplan.CANDIDATE)
    swept = wplan.sweep(wrench, bank, s, table, **fixed).toPandas()
    assert len(swept) == 16 and swept["converged"].all() and swept["inertia_is_spd"].all()
    best = swept.loc[swept.groupby("rec")["rmsT"].idxmin()].set_index("rec")
    assert best.loc[0, ["smoothing", "gyro", "offset_ns"]].tolist() == [0, True, 0] and best.loc[1, ["smoothing", "gyro", "offset_ns"]].tolist() == [1, False, 7_000_000]
    np.testing.assert_allclose(best[list(fits.INERTIA)].to_numpy(float), [inertia] * 2, atol=1e-6)
    assert (swept.groupby("offset_ns")["n_outside"].min() >= 5).all() and (swept["n"] + swept["n_outside"] == 165).all()


def test_every_branch_of_the_offset_cascade(spark):
    from sensorframe.operators import offsets

    pairs = spark.createDataFrame([("many", q, q + 5) for q in (100, 200, 300)] + [("one", 100, 70)], "k string, device_ts long, qr_ts long")
    stored = spark.createDataFrame([("many", 1, 2), ("one", 1, 2), ("old", 10, 4), ("never", None, None)], "k string, first_device_ts long, first_qr_ts long")
    got = {r.k: (r.offset_ns, r.method) for r in offsets.offset_cascade(offsets.robust_offset(pairs, ["k"]), stored, ["k"]).collect()}
    assert got == {"many": (5, "robust"), "one": (-30, "single"), "old": (-6, "stored"), "never": (None, "manual")}
