"""Registration, comparison and drift segments of trajectories."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe.functions import geometry as g
from sensorframe.operators import intervals, metrics
from sensorframe.operators.interp import interpolate_pose, uniform_times
from sensorframe.operators.ordered import Series
from sensorframe.operators.quantiles import attach
from sensorframe.session import stage

ROT = tuple(f"r{i}" for i in range(9))
TRANS = ("tx", "ty", "tz")
QUAT = ("qx", "qy", "qz", "qw")


def _c(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def good_poses(poses: DataFrame, matches: int = 400, inliers: int = 400) -> DataFrame:
    """Successful localizations with enough matches and inliers."""
    return poses.where(F.col("success") & (F.col("num_matches") >= matches) & (F.col("num_inliers") >= inliers))


def world_from_camera(poses: DataFrame) -> DataFrame:
    """World pose of the camera from camera-from-world rotation ``r0..r8`` and translation.

    Rotation and translation are both inverted, so the quaternion agrees with the translation.
    """
    r, t = g.invert(_c(ROT), _c(TRANS))
    q = g.matrix_to_quat(r)
    keep = [c for c in poses.columns if c not in (*ROT, *TRANS)]
    return poses.select(*keep, *[x.alias(n) for x, n in zip(t, TRANS)], *[x.alias(n) for x, n in zip(q, QUAT)])


def frame_candidates(localized: DataFrame, trajectory: DataFrame, s: Series, rect: tuple[Sequence[float], Sequence[float]], device_camera: tuple[Sequence[float], Sequence[float]]) -> DataFrame:
    """Per localized frame a world-from-query transform ``r0..r8, tx..tz``.

    ``localized`` has the world pose of the camera; ``rect`` and ``device_camera`` are fixed (rotation, translation)
    pairs. Frames without a device pose are left out.
    """
    names = ("_tx", "_ty", "_tz", "_qx", "_qy", "_qz", "_qw")
    side = trajectory.select(*s.keys, s.ts, *[F.col(c).alias(n) for c, n in zip((*TRANS, *QUAT), names)])
    rows = interpolate_pose(localized, side, s, clamp=False, names=names).dropna(subset=list(names))
    dev_cam = g.compose(g.lits(device_camera[0]), g.lits(device_camera[1]), g.lits(rect[0]), g.lits(rect[1]))
    query_cam = g.compose(g.quat_to_matrix(_c(names[3:])), _c(names[:3]), *dev_cam)
    back = g.invert(*query_cam)
    rows = rows.select("*", *[x.alias(f"_b{i}") for i, x in enumerate([*back[0], *back[1]])])
    r, t = g.compose(g.quat_to_matrix(_c(QUAT)), _c(TRANS), _c([f"_b{i}" for i in range(9)]), _c([f"_b{i}" for i in range(9, 12)]))
    return rows.select(*s.keys, s.ts, *[x.alias(n) for x, n in zip(r, ROT)], *[x.alias(f"{n}_") for x, n in zip(t, TRANS)]).withColumnsRenamed(
        {f"{n}_": n for n in TRANS}
    )


def register(localized: DataFrame, trajectory: DataFrame, s: Series, rect, device_camera) -> tuple[DataFrame, DataFrame]:
    """One world-from-query transform per recording, and its trajectory in the world."""
    cand = stage(frame_candidates(localized, trajectory, s, rect, device_camera))
    mean = stage(metrics.mean_transform(cand, s.keys, s.ts, ROT, TRANS))
    return mean, apply_transform(trajectory, mean, s.keys)


def apply_transform(poses: DataFrame, transforms: DataFrame, keys: Sequence[str], vectors: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Poses (and further vectors, such as gravity) under their recording's transform."""
    side = transforms.select(*keys, *[F.col(n).alias(f"_{n}") for n in (*ROT, *TRANS)])
    rows = attach(poses, side, keys).where(F.col("_r0").isNotNull())
    m, t = _c([f"_{n}" for n in ROT]), _c([f"_{n}" for n in TRANS])
    new = dict(zip(TRANS, g.transform(m, t, _c(TRANS))))
    rows = rows.select("*", *[x.alias(f"_q{i}") for i, x in enumerate(g.matrix_to_quat(m))])
    new.update(zip(QUAT, g.quat_product(_c([f"_q{i}" for i in range(4)]), _c(QUAT))))
    for v in vectors:
        new.update(zip(v, g.rotate(m, _c(v))))
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in poses.columns])


def static_trajectory(frames: DataFrame, pose: dict[str, float]) -> DataFrame:
    """One fixed pose at every frame time."""
    return frames.select("*", *[F.lit(float(v)).alias(k) for k, v in pose.items()])


def align_and_compare(a: DataFrame, b: DataFrame, s: Series, rate_hz: float = 30.0, with_scale: bool = False) -> DataFrame:
    """Resample both trajectories over their overlap, align ``b`` to ``a`` and report position errors.

    The alignment needs 15 sums per recording; only those meet in one place.
    """
    def ends(df, name):
        return df.groupBy(*s.keys).agg(F.min(s.ts).alias(f"_s{name}"), F.max(s.ts).alias(f"_e{name}"))

    over = ends(a, "a").join(ends(b, "b"), list(s.keys)).select(
        *s.keys, F.greatest("_sa", "_sb").alias("_s0"), F.least("_ea", "_eb").alias("_s1")
    ).where(F.col("_s0") <= F.col("_s1"))
    grid = stage(uniform_times(over, "_s0", "_s1", rate_hz, s.ts).select(*s.keys, s.ts))
    pa = interpolate_pose(grid, a, s).withColumnsRenamed({n: f"a_{n}" for n in TRANS}).drop(*QUAT)
    rows = stage(interpolate_pose(stage(pa), b, s).drop(*QUAT))
    xs, ys = _c([f"a_{n}" for n in TRANS]), _c(TRANS)
    mean = rows.groupBy(*s.keys).agg(*[F.avg(c).alias(f"_mx{i}") for i, c in enumerate(xs)], *[F.avg(c).alias(f"_my{i}") for i, c in enumerate(ys)])
    cen = attach(rows, stage(mean), s.keys)
    dx, dy = [c - F.col(f"_mx{i}") for i, c in enumerate(xs)], [c - F.col(f"_my{i}") for i, c in enumerate(ys)]
    sums = cen.groupBy(*s.keys).agg(
        *[F.avg(dx[i] * dy[j]).alias(f"_c{i}{j}") for i in range(3) for j in range(3)], F.avg(g.dot(dy, dy)).alias("_vy"),
        *[F.first(f"_m{p}{i}").alias(f"_m{p}{i}") for p in "xy" for i in range(3)],
    )
    fields = [sums.schema[k] for k in s.keys] + [T.StructField(n, T.DoubleType()) for n in (*ROT, *TRANS, "scale")]

    def solve(batches):
        for pdf in batches:
            out = pdf[list(s.keys)].copy()
            res = []
            for row in pdf.to_dict("records"):
                cov = np.array([[row[f"_c{i}{j}"] for j in range(3)] for i in range(3)])
                u, d, vt = np.linalg.svd(cov)
                sign = np.array([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
                r = u @ np.diag(sign) @ vt
                k = float((d * sign).sum() / row["_vy"]) if with_scale and row["_vy"] > 0 else 1.0
                t = np.array([row[f"_mx{i}"] for i in range(3)]) - k * r @ np.array([row[f"_my{i}"] for i in range(3)])
                res.append([*r.ravel(), *t, k])
            for i, n in enumerate((*ROT, *TRANS, "scale")):
                out[n] = [v[i] for v in res]
            yield out

    fit = stage(sums.mapInPandas(solve, T.StructType(fields)))
    side = fit.select(*s.keys, *[F.col(n).alias(f"_{n}") for n in (*ROT, *TRANS, "scale")])
    near = attach(rows, side, s.keys)
    moved = g.vadd([F.col("_scale") * x for x in g.rotate(_c([f"_{n}" for n in ROT]), ys)], _c([f"_{n}" for n in TRANS]))
    near = near.withColumn("_err", g.norm(g.vsub(xs, moved)))
    err = near.groupBy(*s.keys).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.col("_err") * F.col("_err"))).alias("rmse"), F.avg("_err").alias("mean_error"), F.max("_err").alias("max_error")
    )
    return attach(err, fit, s.keys)


def drift_segments(trajectory: DataFrame, anchors: DataFrame, s: Series) -> DataFrame:
    """Trajectory rows per segment between anchors, scaled and moved so that each starts at its anchor.

    A segment's scale is the anchors' distance over the trajectory's distance between the segment's ends. Rows at an
    inner anchor belong to two segments and are kept once, from the earlier one.
    """
    seg = stage(intervals.anchor_segments(trajectory, anchors, s))
    group = [*s.keys, "segment_start"]
    pose = [*TRANS, *QUAT]
    ends = seg.groupBy(*group).agg(
        F.first("segment_end").alias("segment_end"), F.min_by(F.struct(*pose), s.ts).alias("_f"), F.max_by(F.struct(*TRANS), s.ts).alias("_l")
    )
    at = intervals.keep_first(anchors.select(*s.keys, s.ts, *pose), [*s.keys, s.ts], pose)
    a0 = at.select(*s.keys, F.col(s.ts).alias("segment_start"), F.struct(*pose).alias("_a"))
    a1 = at.select(*s.keys, F.col(s.ts).alias("segment_end"), F.struct(*TRANS).alias("_z"))
    info = ends.join(a0, group).join(a1, [*s.keys, "segment_end"])

    def span(p, q):
        return g.norm([F.col(f"{p}.{n}") - F.col(f"{q}.{n}") for n in TRANS])

    travelled = span("_f", "_l")
    info = info.withColumn("scale", span("_a", "_z") / F.when(travelled > 0, travelled))
    rf = g.quat_to_matrix([F.col(f"_f.{n}") for n in QUAT])
    ra = g.quat_to_matrix([F.col(f"_a.{n}") for n in QUAT])
    # Rotation that takes the segment's first orientation to the anchor's.
    turn = [g.dot(ra[3 * i: 3 * i + 3], rf[3 * j: 3 * j + 3]) for i in range(3) for j in range(3)]
    info = stage(info.select(*group, "scale", "_f", "_a", *[x.alias(f"_r{i}") for i, x in enumerate(turn)]))
    rows = attach(seg, info, group).where(F.col("scale").isNotNull())
    m = _c([f"_r{i}" for i in range(9)])
    local = [(F.col(n) - F.col(f"_f.{n}")) * F.col("scale") for n in TRANS]
    moved = g.vadd(g.rotate(m, local), [F.col(f"_a.{n}") for n in TRANS])
    q = g.quat_product(g.matrix_to_quat(m), g.unit(_c(QUAT)))
    new = {**dict(zip(TRANS, moved)), **dict(zip(QUAT, q))}
    out = rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in trajectory.columns], "segment_start", "scale")
    return intervals.keep_first(out, [*s.keys, s.ts], ["segment_start"])
