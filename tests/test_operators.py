"""Operators against brute force on small fixtures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorframe.functions import geometry as g
from sensorframe.functions import text
from sensorframe.operators import filters, fits, intervals, metrics, pointcloud, selection
from sensorframe.operators.offsets import collapse_detections, robust_offset
from sensorframe.operators.ordered import Series
from sensorframe.plans import hands, trajectories
from sensorframe.plans import wrench as wplan

S = Series(["k"], cell_ns=64, target_rows=20)


def direct_filtfilt(b, a, x, pad):
    def lfilter(v, zi):
        out, z = np.empty(len(v)), zi.copy()
        for i, u in enumerate(v):
            y = b[0] * u + z[0]
            for j in range(len(z)):
                z[j] = b[j + 1] * u - a[j + 1] * y + (z[j + 1] if j + 1 < len(z) else 0.0)
            out[i] = y
        return out

    comp = np.zeros((len(a) - 1, len(a) - 1))
    comp[:, 0] = -a[1:]
    comp[:-1, 1:] += np.eye(len(a) - 2)
    zi = np.linalg.solve(np.eye(len(a) - 1) - comp, b[1:] - a[1:] * b[0])
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2:-pad - 2:-1]])
    y = lfilter(ext, zi * ext[0])
    y = lfilter(y[::-1], zi * y[-1])[::-1]
    return y[pad:-pad]


def test_lowpass_in_chunks_is_the_whole_series(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": 0, "ts": np.arange(1500) * 10, "v": np.cumsum(rng.normal(size=1500))})
    b, a = filters.butterworth(4, 15.0, 100.0)
    out = filters.lowpass(spark.createDataFrame(pdf), Series(["k"], cell_ns=4096), ["v"], 100.0, rows=10)
    got = out.toPandas().sort_values("ts").v_filt.to_numpy()
    np.testing.assert_allclose(got, direct_filtfilt(b, a, pdf.v.to_numpy(), 15), atol=1e-9)


def test_savgol_edges_and_short_series(spark):
    x = np.arange(40, dtype=float)
    pdf = pd.concat([
        pd.DataFrame({"k": 0, "ts": (x * 7).astype(int), "v": 1 + 2 * x - 0.3 * x**2}),
        pd.DataFrame({"k": 1, "ts": [1, 2, 3, 4], "v": [1.0, 4.0, 9.0, 16.0]}),
        pd.DataFrame({"k": 2, "ts": [1, 2], "v": [1.0, 2.0]}),
    ])
    out = filters.savgol(spark.createDataFrame(pdf), S, ["v"], 7, 2, rows=9).toPandas().sort_values(["k", "ts"])
    # A parabola is its own smoothing, ends included.
    np.testing.assert_allclose(out[out.k == 0].v_smooth, pdf[pdf.k == 0].v, atol=1e-8)
    np.testing.assert_allclose(out[out.k == 1].v_smooth[:3], [1.0, 4.0, 9.0], atol=1e-8)
    assert out[out.k == 2].v_smooth.isna().all()


@pytest.mark.parametrize("rows", [3, 1000])
def test_rate_cap(spark, rows):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 400), "ts": rng.choice(5000, 400, replace=False)})
    step, want = 25, []
    for k, grp in pdf.groupby("k"):
        last = None
        for t in sorted(grp.ts):
            if last is None or t - last >= step:
                want.append((k, t))
                last = t
    got = filters.rate_cap(spark.createDataFrame(pdf), S, 1e9 / step, rows=rows).toPandas()
    assert sorted(map(tuple, got[["k", "ts"]].to_numpy().tolist())) == sorted((int(a), int(b)) for a, b in want)


def test_offset_branches(spark):
    base = 1_700_000_000_000_000_001
    rows = [("one", 5, 9)]
    rows += [("two", 10, 20), ("two", 10, 23)]
    rows += [("flat", i, i + 7) for i in range(4)]
    rows += [("epoch", i, base + i + d) for i, d in enumerate([0, 2, 4, 900])]
    rows += [("minus", 20 + i, d) for i, d in enumerate([0, 2])]
    df = spark.createDataFrame(rows, "k string, device_ts long, qr_ts long")
    got = {r.k: r.offset_ns for r in robust_offset(df, ["k"]).collect()}
    assert got["one"] == 4 and got["two"] == 11 and got["flat"] == 7
    assert got["epoch"] == base + 2
    assert got["minus"] == -19  # the median -19.5 cut toward zero
    both = spark.createDataFrame([("a", 1, 5), ("a", 4, 5), ("a", 9, 6)], "k string, device_ts long, qr_ts long")
    assert {(r.qr_ts, r.device_ts) for r in collapse_detections(both, ["k"]).collect()} == {(5, 2), (6, 9)}


def test_detection_blocks_against_neighbour_counts(spark):
    rng = np.random.default_rng(4)
    t = np.sort(rng.choice(3000, 150, replace=False))
    for need in (2, 4):
        eps = 12
        core = [(np.abs(t - x) <= eps).sum() >= need for x in t]
        label = np.full(len(t), -1)
        c = -1
        for i in range(len(t)):
            if core[i]:
                prev = [j for j in range(i) if core[j]]
                c += not (prev and t[i] - t[prev[-1]] <= eps)
                label[i] = c
        for i in range(len(t)):
            if not core[i]:
                near = [label[j] for j in range(len(t)) if core[j] and abs(int(t[j]) - int(t[i])) <= eps]
                label[i] = min(near) if near else -1
        want = sorted((int(t[label == x].min()), int(t[label == x].max()), int((label == x).sum())) for x in set(label) - {-1})
        df = spark.createDataFrame(pd.DataFrame({"k": 0, "ts": t}))
        out = intervals.detection_blocks(df, S, eps, need).collect()
        assert sorted((r.start_ns, r.end_ns, r.n) for r in out) == [w for w in want if w[2] >= need]


def test_interaction_windows_keep_their_numbers(spark):
    sec = 1_000_000_000
    blocks = spark.createDataFrame([(0, 10 * sec, 11 * sec), (0, 12 * sec, 13 * sec), (0, 20 * sec, 21 * sec), (1, 5 * sec, 6 * sec)], "k int, start_ns long, end_ns long")
    ext = spark.createDataFrame([(0, 0, 30 * sec), (1, 0, 30 * sec)], "k int, first_ns long, last_ns long")
    out = intervals.interaction_windows(blocks, ext, Series(["k"], cell_ns=sec)).collect()
    assert sorted((r.name, r.start_ns // sec, r.end_ns // sec) for r in out) == [("window_0", 0, 10), ("window_2", 13, 20), ("window_3", 21, 30)]


def test_disjoint_windows(spark):
    win = [(0, 1, 5), (0, 3, 9), (0, 9, 12), (0, 14, 15), (0, 15, 15), (1, 2, 2)]
    out = intervals.disjoint_windows(spark.createDataFrame(win, "k int, start_ns long, end_ns long"), S).collect()
    assert sorted((r.k, r.start_ns, r.end_ns) for r in out) == [(0, 1, 12), (0, 14, 15), (1, 2, 2)]


def test_tool_parameters_are_recovered(spark):
    rng = np.random.default_rng(5)
    n = 300
    quat = rng.normal(size=(n, 4))
    pdf = pd.DataFrame(np.hstack([quat, rng.normal(size=(n, 9))]), columns=["qx", "qy", "qz", "qw", "ax", "ay", "az", "ox", "oy", "oz", "lx", "ly", "lz"])
    pdf["rec"] = np.arange(n) % 2
    from sensorframe.functions import wrench as wr

    mass, cog, inertia = 0.49, (0.021, 0.02, 0.059), (0.012, 0.015, 0.02, 0.001, -0.002, 0.0005)
    rows = spark.createDataFrame(pdf)
    grav = wr.gravity_in_sensor(g.quat_to_matrix([F.col(c) for c in ("qx", "qy", "qz", "qw")]))
    rows = rows.select("*", *[c.alias(n) for c, n in zip(grav, wplan.GRAV)])
    move = [[F.col(f"{p}{a}") for a in "xyz"] for p in "aol"]

    def measured(vectors):
        f, t = wr.internal_wrench([F.col(c) for c in wplan.GRAV], *vectors, F.lit(mass), g.lits(cog), g.lits(inertia), gyro=True)
        out = rows.select("*", *[(c + b).alias(n) for c, b, n in zip(f, (1.0, -2.0, 0.5), wplan.FORCE)], *[(c + b).alias(n) for c, b, n in zip(t, (0.1, 0.05, -0.2), wplan.TORQUE)])
        return out, [[F.col(c) for c in names] for names in (wplan.FORCE, wplan.TORQUE, wplan.GRAV)]

    still, cols = measured([g.lits((0, 0, 0))] * 3)
    for known in ({}, {"mass": mass}, {"cog": cog}, {"mass": mass, "cog": cog}):
        for r in fits.tool_params_static(still, ["rec"], *cols, **known).collect():
            np.testing.assert_allclose([r.m, r.cx, r.cy, r.cz, r.f0x, r.f0y, r.t0z], [mass, *cog, 1.0, -2.0, -0.2], atol=1e-5)
            assert r.rmsF < 1e-5 and r.rmsT < 1e-5
    moving, cols = measured(move)
    r = fits.tool_params_dynamic(moving, ["rec"], *cols, *move, mass=mass, cog=cog, gyro=True).collect()[0]
    np.testing.assert_allclose([r[c] for c in fits.INERTIA], inertia, atol=1e-6)
    assert r.inertia_is_spd and r.rmsT < 1e-6
    r = fits.tool_params_dynamic(moving, ["rec"], *cols, *move, mass=mass, cog=(0.0, 0.0, 0.05), fit_cog=True, gyro=True).collect()[0]
    np.testing.assert_allclose([r.cx, r.cy, r.cz], cog, atol=1e-5)


def test_cloud_difference_and_normals(spark):
    rng = np.random.default_rng(6)
    a = pd.DataFrame(rng.random((300, 3)), columns=list("xyz")).assign(s=0, id=range(300))
    b = pd.DataFrame(rng.random((60, 3)), columns=list("xyz")).assign(s=0, id=range(60))
    d = np.sqrt(((a[list("xyz")].to_numpy()[:, None] - b[list("xyz")].to_numpy()[None]) ** 2).sum(-1)).min(1)
    out = pointcloud.cloud_difference(spark.createDataFrame(a), spark.createDataFrame(b), ["s"], 0.2).toPandas()
    assert set(out.id) == set(np.flatnonzero(d > 0.2))
    plane = pd.DataFrame(rng.random((200, 2)), columns=list("xy")).assign(z=0.5, s=0, id=range(200))
    n = pointcloud.normals(spark.createDataFrame(plane), ["s"], "id", 0.1).toPandas()
    assert len(n) == 200 and (n.nz.abs() > 0.999).all()


def test_farthest_points(spark):
    rng = np.random.default_rng(8)
    vec = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(0, i, [float(x) for x in v]) for i, v in enumerate(vec)] + [(1, 0, [0.0] * 4), (1, 1, [1.0] * 4)], "k int, id long, v array<double>")
    want, dist = [0], np.full(60, np.inf)
    for _ in range(5):
        dist = np.minimum(dist, np.linalg.norm(vec - vec[want[-1]], axis=1))
        want.append(int(dist.argmax()))
    got = selection.farthest_points(df, ["k"], "id", "v", 6, every=2).toPandas()
    assert got[got.k == 0].sort_values("pick").id.tolist() == want
    assert sorted(got[got.k == 1].id) == [0, 1]


def test_mean_transform_of_equal_poses(spark):
    rot = [f"r{i}" for i in range(9)]
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    rows = [(0, i, *eye, 1.0, 2.0, 3.0) for i in range(7)]
    df = spark.createDataFrame(rows, "k int, id long, " + ", ".join(f"{c} double" for c in [*rot, "tx", "ty", "tz"]))
    r = metrics.mean_transform(df, ["k"], "id", rot, ["tx", "ty", "tz"], block=3).collect()[0]
    assert r.n_kept == 7 and [r[c] for c in rot] == eye and (r.tx, r.ty, r.tz) == (1.0, 2.0, 3.0)


def rotation(rng):
    q = rng.normal(size=4)
    q /= np.linalg.norm(q)
    x, y, z, w = q
    m = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    return q, m


def test_registration_finds_the_world_transform(spark):
    rng = np.random.default_rng(9)
    _, r_wq = rotation(rng)
    t_wq = np.array([3.0, -1.0, 2.0])
    _, r_dc = rotation(rng)
    t_dc = np.array([0.1, 0.0, -0.05])
    track, loc = [], []
    for i in range(12):
        q, m = rotation(rng)
        t = rng.normal(size=3)
        track.append((0, i * 1000, *map(float, t), *map(float, q)))
        # camera-from-world of the frame taken at this pose
        r_wc, t_wc = r_wq @ m @ r_dc, r_wq @ (m @ t_dc + t) + t_wq
        if i % 3 == 0:
            loc.append((0, i * 1000, True, 500, 500, *map(float, r_wc.T.ravel()), *map(float, -r_wc.T @ t_wc)))
    pose = "tx double, ty double, tz double, qx double, qy double, qz double, qw double"
    tdf = spark.createDataFrame(track, f"rec int, ts long, {pose}")
    ldf = spark.createDataFrame(loc, "rec int, ts long, success boolean, num_matches int, num_inliers int, " + ", ".join(f"r{i} double" for i in range(9)) + ", tx double, ty double, tz double")
    cam = trajectories.world_from_camera(trajectories.good_poses(ldf)).drop("success", "num_matches", "num_inliers")
    eye = ([1, 0, 0, 0, 1, 0, 0, 0, 1], [0, 0, 0])
    mean, moved = trajectories.register(cam, tdf, Series(["rec"], cell_ns=4096), eye, (list(r_dc.ravel()), list(t_dc)))
    r = mean.collect()[0]
    np.testing.assert_allclose([r[f"r{i}"] for i in range(9)], r_wq.ravel(), atol=1e-9)
    np.testing.assert_allclose([r.tx, r.ty, r.tz], t_wq, atol=1e-9)
    p = moved.where("ts = 5000").collect()[0]
    np.testing.assert_allclose([p.tx, p.ty, p.tz], r_wq @ np.array(track[5][2:5]) + t_wq, atol=1e-9)


def test_trajectory_comparison(spark):
    rng = np.random.default_rng(10)
    _, m = rotation(rng)
    rows, other = [], []
    for i in range(50):
        t = np.array([math.cos(i / 7), math.sin(i / 5), i / 20])
        q, _ = rotation(rng)
        rows.append((0, i * 10**8, *map(float, t), *map(float, q)))
        other.append((0, i * 10**8, *map(float, 2.0 * m @ t + [1, 2, 3]), *map(float, q)))
    schema = "rec int, ts long, tx double, ty double, tz double, qx double, qy double, qz double, qw double"
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)
    r = trajectories.align_and_compare(a, b, Series(["rec"]), 10.0, with_scale=True).collect()[0]
    assert r.n == 50 and r.rmse < 1e-9 and abs(r.scale - 0.5) < 1e-9


def test_hand_ground_truth(spark):
    ms = 1_000_000
    frames = spark.createDataFrame([(0, i * 33 * ms) for i in range(10)], "rec int, ts long")
    marks = spark.createDataFrame([(0, i * 10 * ms, 1.0 if i < 25 else 0.5, 0.1, 0.0, 2.0, 0.0, 0.1, 2.0) for i in range(35)], "rec int, ts long, confidence double, lx double, ly double, lz double, wx double, wy double, wz double")
    poses = spark.createDataFrame([(0, i * 20 * ms, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0) for i in range(20)], "rec int, ts long, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    depth = spark.createDataFrame([(0, i * 33 * ms, 4, 4, [1.0 if i == 3 else 2.0] * 16) for i in range(10)], "rec int, ts long, w int, h int, values array<double>")
    out = hands.hand_ground_truth(frames, marks, poses, depth, Series(["rec"]), intrinsics=(100, 100, 50, 50), image=(100, 100)).toPandas().sort_values("ts")
    # Frame 3 is hidden, frames after the last sure landmark have none.
    assert out.ts.tolist() == [i * 33 * ms for i in (0, 1, 2, 4, 5, 6, 7)]
    np.testing.assert_allclose(out.u, 55.0)
    np.testing.assert_allclose(out.distance, math.sqrt(4.01))
    assert set(out.part) == {"far"} and out.measured.eq(2.0).all()


def test_dynamic_signals_of_a_steady_turn(spark):
    # Constant turn about z with the device at rest: the lever feels the centripetal pull only.
    w, ms = 2.0, 1_000_000
    rows = []
    for i in range(200):
        a = w * i * 0.01
        rows.append((0, i * 10 * ms, 0.0, 0.0, 0.0, 0.0, 0.0, math.sin(a / 2), math.cos(a / 2), 0.0, 0.0, 0.0, 0.0, 0.0, w))
    poses = spark.createDataFrame(rows, "rec int, ts long, tx double, ty double, tz double, qx double, qy double, qz double, qw double, vx double, vy double, vz double, ox double, oy double, oz double")
    times = spark.createDataFrame([(0, 505 * ms), (0, 1000 * ms)], "rec int, ts long")
    out = wplan.dynamic_signals(poses, times, Series(["rec"]), device_sensor=(1, 0, 0, 0, 1, 0, 0, 0, 1), lever=(0.5, 0.0, 0.0)).toPandas()
    np.testing.assert_allclose(out.ax, -w * w * 0.5, atol=1e-8)
    np.testing.assert_allclose(out[["ay", "az", "lx", "ly", "lz"]], 0.0, atol=1e-8)
    np.testing.assert_allclose(out.oz, w, atol=1e-8)


def test_messages(spark):
    v = "geometry_msgs__msg__Vector3(x=1.0, y=-2.5e-3, z=3, __msgtype__='geometry_msgs/msg/Vector3')"
    q = "geometry_msgs__msg__Quaternion(x=0.0, y=0.0, z=0.0, w=1.0, __msgtype__='q')"
    t = f"geometry_msgs__msg__Transform(translation={v}, rotation={q}, __msgtype__='t')"
    h = "std_msgs__msg__Header(seq=7, stamp=builtin_interfaces__msg__Time(sec=1, nanosec=2, __msgtype__='x'), frame_id='world', __msgtype__='h')"
    ts = f"geometry_msgs__msg__TransformStamped(header={h}, child_frame_id='tool', transform={t}, __msgtype__='s')"
    df = spark.createDataFrame([(ts, v), ("nonsense", "Vector3(1)")], "a string, b string")
    r = df.select(text.message(F.col("a"), "TransformStamped").alias("m"), text.message(F.col("b"), "Vector3").alias("v")).collect()
    m = r[0].m
    assert m.header.stamp.sec == 1 and m.header.frame_id == "world" and m.child_frame_id == "tool"
    assert m.transform.translation.y == -2.5e-3 and m.transform.rotation.w == 1.0 and r[0].v.z == 3.0
    assert r[1].m is None and r[1].v is None
    lists = spark.createDataFrame([("[1. 2. 3.]",), ("[1, 2e-1]",), ("[]",), ("[a]",)], "s string").select(text.float_list(F.col("s")).alias("l")).collect()
    assert [x.l for x in lists] == [[1.0, 2.0, 3.0], [1.0, 0.2], [], None]


def test_strict_and_clamped_interpolation(spark):
    from sensorframe.operators.interp import interpolate_clamped, interpolate_pose, interpolate_strict

    src = spark.createDataFrame([(0, 10, 1.0), (0, 20, 3.0), (0, 90, 5.0)], "k int, ts long, v double")
    at = spark.createDataFrame([(0, t) for t in (5, 10, 15, 50, 90, 99)], "k int, ts long")
    strict = {r.ts: r.v for r in interpolate_strict(at, src, S, ["v"], 10).collect()}
    assert strict == {5: None, 10: 1.0, 15: 2.0, 50: None, 90: 5.0, 99: None}
    soft = {r.ts: r.v for r in interpolate_clamped(at, src, S, ["v"]).collect()}
    assert soft[5] == 1.0 and soft[99] == 5.0 and soft[15] == 2.0
    q = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (0, 10, 1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0)], "k int, ts long, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    mid = interpolate_pose(spark.createDataFrame([(0, 5)], "k int, ts long"), q, S).collect()[0]
    assert abs(abs(mid.qz) - math.sqrt(0.5)) < 1e-12 and abs(mid.tx - 0.5) < 1e-12


def test_compensated_wrench_of_a_free_tool_is_zero(spark):
    from sensorframe.functions import wrench as wr

    rng = np.random.default_rng(12)
    ms, n = 1_000_000, 400
    rows, poses = [], []
    for i in range(n):
        a = i / 40
        q = (0.3 * math.sin(a), 0.2 * math.cos(a), 0.1, 1.0)
        q = tuple(np.array(q) / np.linalg.norm(q))
        poses.append((0, i * 10 * ms, 0.0, 0.0, 0.0, *map(float, q)))
        x, y, z, w = q
        gs = np.array([2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]) * -wr.GRAVITY
        f = 0.49 * gs + [1.0, 2.0, 3.0]
        tau = np.cross([0.021, 0.02, 0.059], 0.49 * gs) + [0.1, 0.2, 0.3]
        rows.append((0, i * 10 * ms, *map(float, f), *map(float, tau)))
    wrench = spark.createDataFrame(rows, "rec int, ts long, fx double, fy double, fz double, tx double, ty double, tz double")
    track = spark.createDataFrame(poses, "rec int, ts long, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    out = wplan.compensate_wrench(
        wrench, track, Series(["rec"]), (1, 0, 0, 0, 1, 0, 0, 0, 1), mass=0.49, cog=(0.021, 0.02, 0.059), rate_hz=100.0, min_free_s=0.1, erode_s=0.0
    ).toPandas()
    assert len(out) == n
    np.testing.assert_allclose(out[[f"ext_{c}_filt" for c in ("fx", "fy", "fz", "tx", "ty", "tz")]], 0.0, atol=1e-5)


def test_resampling_weights_are_independent():
    from sensorframe.operators.metrics import resample_weight

    rows, reps = np.arange(5000)[:, None], np.arange(400)[None, :]
    w = resample_weight(rows, reps).astype(float)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    # The total weight of a replicate spreads as a sum of independent weights does.
    assert abs(w.sum(axis=0).std() / 5000**0.5 - 1) < 0.12
    for lag in (1, 7, 100):
        assert abs(np.corrcoef(w[:, lag:].ravel(), w[:, :-lag].ravel())[0, 1]) < 0.01
        assert abs(np.corrcoef(w[lag:].ravel(), w[:-lag].ravel())[0, 1]) < 0.01
    far = resample_weight(rows + (1 << 40), reps)
    assert (far != w).mean() > 0.3


def test_bootstrap_interval_is_that_of_plain_resampling(spark):
    from sensorframe.operators.metrics import bootstrap_rmse

    rng = np.random.default_rng(5)
    # An error that drifts along the series, on consecutive ids.
    e = np.linspace(0, 2, 2000) + rng.normal(0, 0.5, 2000)
    df = spark.createDataFrame([(i, 0.0, float(x)) for i, x in enumerate(e)], "id bigint, y double, yhat double")
    got = bootstrap_rmse(df, [], "id", "y", "yhat", 2000).first()
    plain = np.sqrt((e[rng.integers(0, 2000, (2000, 2000))] ** 2).mean(axis=1))
    low, high = np.percentile(plain, [2.5, 97.5])
    assert abs(got.ci_halfwidth / ((high - low) / 2) - 1) < 0.1
    assert abs(got.ci_low - low) < 0.1 * (high - low) and abs(got.ci_high - high) < 0.1 * (high - low)


def test_quantiles_with_nan_and_infinities_are_the_same_for_any_size(spark):
    from sensorframe.operators.quantiles import exact_quantiles

    nan, inf = float("nan"), float("inf")
    groups = {
        "plain": [float(i) for i in range(1, 10)], "up": [*map(float, range(1, 10)), inf], "nan": [*map(float, range(1, 10)), *[nan] * 4], "low": [-inf, -inf, 0.0, 1.0],
        "all": [-inf, inf, nan, 0.0, -0.0, 1e308, -1e308, 5e-324], "none": [None, None], "only": [nan, nan], "ends": [-inf, inf],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    wanted = {f"q{int(100 * p)}": (df["v"], p) for p in (0.0, 0.25, 0.5, 0.9, 1.0)}
    small = exact_quantiles(df, ["g"], wanted, 60_000).collect()
    large = exact_quantiles(df, ["g"], wanted, 0).collect()
    assert sorted(map(repr, small)) == sorted(map(repr, large))


def test_farthest_rows_of_equal_vectors(spark):
    from sensorframe.operators.selection import farthest_points

    df = spark.createDataFrame([(i, [0.0, 0.0] if i < 6 else [1.0, 0.0]) for i in range(9)], "id bigint, v array<double>")
    got = farthest_points(df.selectExpr("1 as g", "id", "v"), ["g"], "id", "v", 5).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.pick)] == [0, 6, 1, 2, 3]


def _same_windows(spark):
    """Rows at 0, 10 .. 990 and 3000 windows that share two extents."""
    rows = spark.range(100).selectExpr("0 as rig", "id as event_id", "id * 10 as ts", "cast(id % 50 as double) as fz", "0.0D as fx", "0.0D as fy")
    windows = spark.range(3000).selectExpr("0 as rig", "id as window_index", "100 * (id % 2) as start_ns", "100 * (id % 2) + 205 as end_ns")
    return rows, windows


def test_window_members_of_shared_extents(spark):
    rows, windows = _same_windows(spark)
    out = intervals.window_members(rows, windows, Series(["rig"], cell_ns=1000), ["window_index"], width_ns=64)
    got = {(r.event_id, r.window_index) for r in out.collect()}
    want = {(e, w) for w in range(3000) for e in range(100) if 100 * (w % 2) <= 10 * e <= 100 * (w % 2) + 205}
    assert got == want and out.count() == len(want)
    # Windows of one extent move as lists, so the join sees fewer rows than there are windows.
    assert "collect_list" in out._jdf.queryExecution().optimizedPlan().toString()


def test_window_peaks_meet_each_extent_once(spark):
    rows, windows = _same_windows(spark)
    peaks = intervals.window_peaks(rows, windows, Series(["rig"], cell_ns=1000), F.abs("fz"), ["event_id"], width_ns=64)
    assert sorted((r.start_ns, r.end_ns, r.peak_ts, r.event_id) for r in peaks.collect()) == [(0, 205, 200, 20), (100, 305, 300, 30)]


def test_peak_samples_attach_windows_last(spark):
    from sensorframe.plans import load

    rows, windows = _same_windows(spark)
    out = load.peak_samples(rows, windows, rows.select("rig", "ts"), Series(["rig"], cell_ns=1000), lead_ns=12, width_ns=64)
    got = {(r.window_index, r.peak_ts, r.frame_ts) for r in out.collect()}
    assert got == {(w, 200 + 100 * (w % 2), 190 + 100 * (w % 2)) for w in range(3000)}
    # Nothing is grouped by window: its pairs with rows are never made.
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_force_episodes_mark_one_frame_a_window(spark):
    from sensorframe.plans import load

    zero = {c: 0.0 for c in ("tx", "ty", "tz", "qx", "qy", "qz", "vy", "vz", "ox", "oy", "oz")}
    at = [100, 150, 200, 200]
    frames = spark.createDataFrame([(0, i, t) for i, t in enumerate(at)], "rig int, event_id long, ts long")
    motor = spark.createDataFrame([(0, t, 0.1, 100.0) for t in sorted(set(at))], "rig int, ts long, position double, effort double")
    wrench = spark.createDataFrame([(0, t, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0) for t in sorted(set(at))], "rig int, ts long, fx double, fy double, fz double, mx double, my double, mz double")
    track = spark.createDataFrame([{"rig": 0, "ts": t, "qw": 1.0, "vx": 1.0, **zero} for t in sorted(set(at))])
    windows = spark.createDataFrame([(0, 1, 90, 160), (0, 2, 90, 300), (0, 3, 210, 300)], "rig int, window_index long, start_ns long, end_ns long")
    rows = load.force_episodes(frames, windows, motor, wrench, track, Series(["rig"], cell_ns=1000), width_ns=64).collect()
    assert sorted((r.window_index, r.ts) for r in rows if r.keyframe_step) == [(1, 150), (2, 200)]
    assert len(rows) == 6


def test_mean_transform_moves_a_pose_once_per_tile(spark):
    rng = np.random.default_rng(4)
    rot = [f"r{i}" for i in range(9)]
    pdf = pd.DataFrame(rng.normal(size=(60, 12)), columns=[*rot, "tx", "ty", "tz"])
    pdf["k"], pdf["id"] = np.arange(60) % 2, np.arange(60)
    df = spark.createDataFrame(pdf)
    got = metrics.mean_transform(df, ["k"], "id", rot, ["tx", "ty", "tz"], block=4, tile=7).toPandas().set_index("k")
    for k, g_ in pdf.groupby("k"):
        r = g_[rot].to_numpy()
        d = np.linalg.norm(r[:, None] - r[None], axis=2).mean(axis=1)
        n = np.linalg.norm(g_[["tx", "ty", "tz"]], axis=1)
        keep = (d >= 0.75 * np.median(d)) & (d <= 1.25 * np.median(d)) & (n >= 0.75 * np.median(n)) & (n <= 1.25 * np.median(n))
        assert got.loc[k, "n_kept"] == keep.sum()
        assert np.allclose(got.loc[k, [*rot, "tx"]].astype(float), g_.loc[keep, [*rot, "tx"]].mean())


def test_resample_weights_by_upper_half():
    from sensorframe.operators.metrics import STEPS, _BY_HALF, resample_weight

    words = np.unique(np.concatenate([STEPS.astype("int64") + d for d in (-1, 0, 1)]).clip(0, 2**32 - 1)).astype("uint32")
    for w in words:
        quick = _BY_HALF[w >> np.uint32(16)]
        assert quick == np.searchsorted(STEPS, w, side="right") or quick == 255
    rows = np.array([0, 1, -1, 2**40 + 7, -(2**62)])[:, None]
    got = resample_weight(rows, np.arange(2000)[None, :])
    assert got.shape == (5, 2000) and abs(got.mean() - 1) < 0.05
