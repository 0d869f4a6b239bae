"""Hand landmarks: world frame, ground truth in a camera and its export (L5 parts, L10, S21, F29, F30, G5, G9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.functions import geometry as g
from sensorframe.operators.asof import asof_join
from sensorframe.operators.interp import guarded_speed, interpolate_pose, interpolate_strict
from sensorframe.operators.ordered import Series, rolling
from sensorframe.session import stage

# Landmark order of the exported annotation, as positions in the source's 21 landmarks.
EXPORT_ORDER = (5, 20, 6, 7, 0, 8, 9, 10, 1, 11, 12, 13, 2, 14, 15, 16, 3, 17, 18, 19, 4)


def _pose_columns(pose: dict[str, Column]) -> tuple[list[Column], list[Column]]:
    t = [pose[c] for c in ("tx", "ty", "tz")]
    return g.quat_to_matrix([pose[c] for c in ("qx", "qy", "qz", "qw")]), t


def landmarks_to_world(marks: Column, confidence: Column, pose: dict[str, Column], min_confidence: float = 0.7, eps: float = 1e-6) -> Column:
    """Array of device-frame landmarks in the world frame; null where tracking is unsure or the point is unset."""
    m, t = _pose_columns(pose)

    def lift(p):
        v = [p["x"], p["y"], p["z"]]
        world = F.struct(*[c.alias(a) for c, a in zip(g.transform(m, t, v), "xyz")])
        return F.when((confidence > min_confidence) & (g.norm(v) > eps), world)

    return F.transform(marks, lift)


def normal_to_world(normal: Sequence[Column], pose: dict[str, Column]) -> list[Column]:
    """Palm or wrist normal turned into the world frame, of unit length; null for a zero normal."""
    m, _ = _pose_columns(pose)
    v = g.rotate(m, normal)
    n = g.norm(v)
    return [x / F.when(n > 0, n) for x in v]


def keypoint_box(points: Column, width: int, height: int) -> Column:
    """whole-pixel box held inside the image, its centre and longer side."""
    def edge(axis: str, pick, limit: int) -> Column:
        value = pick(F.transform(points, lambda p: p[axis]))
        return F.greatest(F.lit(0), F.least(F.lit(limit - 1), value.cast("int")))

    x0, x1 = edge("u", F.array_min, width), edge("u", F.array_max, width)
    y0, y1 = edge("v", F.array_min, height), edge("v", F.array_max, height)
    return F.struct(
        x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), ((x0 + x1) / 2.0).alias("cx"), ((y0 + y1) / 2.0).alias("cy"),
        F.greatest(x1 - x0, y1 - y0).cast("double").alias("side"),
    )


def reorder(points: Column, order: Sequence[int] = EXPORT_ORDER) -> Column:
    """landmarks in the exported order."""
    return F.transform(F.array(*[F.lit(i) for i in order]), lambda i: F.get(points, i))


def occluded(measured: Column, expected: Column, margin: float = 0.1) -> Column:
    """Something lies in front of the point; unknown depth counts as free."""
    return F.coalesce(measured + margin < expected, F.lit(False))


def distance_class(distance: Column, limit: float = 2.0) -> Column:
    """``close`` below the limit, ``far`` from it on, null for unknown distance."""
    return F.when(distance < limit, "close").when(distance >= limit, "far")


def distance_to_camera(rows: DataFrame, poses: DataFrame, s: Series, point: Sequence[str], max_gap_ns: int = 100_000_000, out: str = "distance") -> DataFrame:
    """Distance of a world point to the nearest camera pose in time; null beyond ``max_gap_ns``.

    ``poses`` has ``cam_x, cam_y, cam_z``.
    """
    cam = ["cam_x", "cam_y", "cam_z"]
    hit = asof_join(rows, poses, s, cam, tolerance=max_gap_ns)
    d = g.norm([F.col(a) - F.col(b) for a, b in zip(point, cam)])
    return hit.withColumn(out, d).drop(*cam)


def neighbour_frames(rows: DataFrame, frames: DataFrame, s: Series, tolerance: int, path: str = "path") -> DataFrame:
    """Nearest frame of each row and the paths two and one before and after it."""
    names = ["frame_m2", "frame_m1", "frame_p1", "frame_p2"]
    near = rolling(
        frames.select(*s.keys, s.ts, path), s, 2, 2,
        lambda w: [(F.lag(path, k) if k > 0 else F.lead(path, -k)).over(w).alias(n) for n, k in zip(names, (2, 1, -1, -2))],
    )
    return asof_join(rows, stage(near), s, [path, *names], tolerance=tolerance)


def hand_ground_truth(
    frames: DataFrame, landmarks: DataFrame, camera_poses: DataFrame, depth: DataFrame, s: Series, *,
    intrinsics: Sequence[float], image: tuple[int, int], min_confidence: float = 0.99, frame_tolerance: int = 5_000_000,
    pose_tolerance: int = 5_000_000, max_gap_ns: int = 30_000_000,
) -> DataFrame:
    """Camera frames with interpolated world landmarks that are visible, close in time and not hidden.

    ``landmarks`` has ``confidence`` and ``lx, ly, lz`` of the palm plus ``wx, wy, wz`` of the wrist in the world;
    ``camera_poses`` has a world pose; ``depth`` has ``w, h, values`` per time. Rows carry the pixel, the camera-frame
    depth, the measured depth, distance and speed.
    """
    world = ["lx", "ly", "lz", "wx", "wy", "wz"]
    sure = landmarks.where(F.col("confidence") > min_confidence)
    rows = stage(interpolate_strict(frames, sure, s, world, max_gap_ns)).dropna(subset=world)
    # Written out before each filter: the optimizer would otherwise follow the filter through every formula.
    posed = stage(interpolate_pose(rows, camera_poses, s, clamp=False)).dropna(subset=["tx"])
    # In steps: each works on columns of the one before, so no expression is written out many times.
    quat, place = [F.col(c) for c in ("qx", "qy", "qz", "qw")], [F.col(c) for c in ("tx", "ty", "tz")]
    posed = posed.select("*", *[x.alias(f"_m{i}") for i, x in enumerate(g.transpose(g.quat_to_matrix(quat)))])
    m = [F.col(f"_m{i}") for i in range(9)]
    points = [g.rotate(m, g.vsub([F.col(c) for c in axes], place)) for axes in (world[:3], world[3:])]
    posed = posed.select("*", *[x.alias(f"_{p}{i}") for p, v in zip("cw", points) for i, x in enumerate(v)])
    cam, wrist = ([F.col(f"_{p}{i}") for i in range(3)] for p in "cw")
    k = g.lits(intrinsics)
    u, v = g.project_safe(k, cam, *image)
    seen = posed.select("*", u.alias("u"), v.alias("v"), cam[2].alias("cam_z"), g.project_safe(k, wrist, *image)[0].alias("_wu"))
    seen = seen.drop(*[f"_m{i}" for i in range(9)], *[f"_{p}{i}" for p in "cw" for i in range(3)])
    seen = stage(seen).where(F.col("u").isNotNull() & F.col("_wu").isNotNull()).drop("_wu")
    seen = stage(asof_join(seen, depth, s, ["w", "h", "values"], tolerance=frame_tolerance))
    du, dv = F.col("u") * F.col("w") / float(image[0]), F.col("v") * F.col("h") / float(image[1])
    seen = seen.withColumn("measured", g.bilinear(F.col("values"), F.col("w"), F.col("h"), du, dv)).drop("values", "w", "h")
    seen = stage(seen).where(~occluded(F.col("measured"), F.col("cam_z")))
    out = guarded_speed(seen, s, ["lx", "ly", "lz"])
    dist = g.norm([F.col(a) - F.col(b) for a, b in zip(world[:3], ("tx", "ty", "tz"))])
    return out.withColumn("distance", dist).withColumn("part", distance_class(F.col("distance")))


def annotation_json(points: Column, box: Column, scores: Column, hidden: Column, exists: Column, points_3d: Column) -> Column:
    """Annotation of one row as a JSON text."""
    return F.to_json(F.struct(
        points.alias("keypoints"), box.alias("bbox"), scores.alias("scores"), hidden.alias("occluded"), exists.alias("exists"),
        points_3d.alias("keypoints_3d"),
    ))
