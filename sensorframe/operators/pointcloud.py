"""Point-cloud tables (A28-A30, C1-C6, J18, J21): every operator keys points by grid cell."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.functions.geometry import Vec, project, transform, unproject
from sensorframe.operators.metrics import finite
from sensorframe.operators.nearest import nearest_fit
from sensorframe.operators.quantiles import attach, exact_quantiles
from sensorframe.session import stage

XYZ = ("x", "y", "z")


def quality_filter(points: DataFrame) -> DataFrame:
    """Semi-dense points of sufficient certainty."""
    ok = finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z"))
    return points.where(ok & (F.col("inv_dist_std") <= 0.005) & (F.col("dist_std") <= 0.01))


def voxel_downsample(points: DataFrame, keys: Sequence[str], voxel: float, cols: Sequence[str] = XYZ) -> DataFrame:
    """Mean point (and colour) per voxel; the grid starts half a voxel below the cloud's minimum."""
    low = points.groupBy(*keys).agg(*[F.min(c).alias(f"_lo_{c}") for c in XYZ])
    rows = attach(points, low, keys)
    cell = [F.floor((F.col(c) - F.col(f"_lo_{c}") + voxel / 2) / voxel).alias(f"v{c}") for c in XYZ]
    return rows.groupBy(*keys, *cell).agg(*[F.avg(c).alias(c) for c in cols], F.count("*").alias("n"))


def voxel_dedup(points: DataFrame, keys: Sequence[str], voxel: float, order: str) -> DataFrame:
    """First point by ``order`` of every voxel of rounded coordinates; ``voxel <= 0`` keeps all."""
    if voxel <= 0:
        return points
    cell = [F.rint(F.col(c) / voxel).cast("bigint").alias(f"_v{c}") for c in XYZ]
    rest = [c for c in points.columns if c not in keys]
    best = points.groupBy(*keys, *cell).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return best.select(*keys, "_r.*").select(*points.columns)


def cloud_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], radius: float) -> DataFrame:
    """Points of ``a`` farther than ``radius`` from every point of ``b``.

    Cells are small enough that two points of one cell are within the radius, so a dense cell is settled by its
    existence alone, without comparing points. What is left meets only the surrounding cells, whose points are
    first merged where they coincide.
    """
    side = radius / math.sqrt(3.0) * (1.0 - 1e-9)

    def cell(prefix: str) -> list[Column]:
        return [F.floor(F.col(c) / side).cast("bigint").alias(f"{prefix}{c}") for c in XYZ]

    bp = stage(b.select(*keys, *XYZ).distinct().select("*", *cell("_b")))
    bcells = bp.select(*keys, *[f"_b{c}" for c in XYZ]).distinct()
    rows = a.select("*", *cell("_a"))
    same = rows.join(
        bcells.select(*keys, *[F.col(f"_b{c}").alias(f"_a{c}") for c in XYZ]), [*keys, *[f"_a{c}" for c in XYZ]], "left_anti"
    )
    open_points = stage(same.select(*a.columns, *[f"_a{c}" for c in XYZ]))
    reach = int(math.ceil(radius / side)) + 0
    # Offsets whose nearest corners are already out of reach are left out.
    near = [
        (i, j, k)
        for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) for k in range(-reach, reach + 1)
        if (i, j, k) != (0, 0, 0) and sum(max(abs(d) - 1, 0) ** 2 for d in (i, j, k)) * side**2 <= radius**2
    ]
    # The neighbour lookup is decided per distinct cell first; only occupied pairs of cells reach the points.
    acells = open_points.select(*keys, *[f"_a{c}" for c in XYZ]).distinct()
    offsets = F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(o, XYZ)]) for o in near])
    pairs = acells.withColumn("_o", F.explode(offsets)).select(
        *keys, *[f"_a{c}" for c in XYZ], *[(F.col(f"_a{c}") + F.col(f"_o.{c}")).alias(f"_b{c}") for c in XYZ]
    ).join(bcells, [*keys, *[f"_b{c}" for c in XYZ]])
    targets = pairs.join(
        bp.select(*keys, *[f"_b{c}" for c in XYZ], *[F.col(c).alias(f"_p{c}") for c in XYZ]), [*keys, *[f"_b{c}" for c in XYZ]]
    ).select(*[F.col(k).alias(f"_t_{k}") for k in keys], *[F.col(f"_a{c}").alias(f"_t{c}") for c in XYZ], *[f"_p{c}" for c in XYZ])
    cond = F.sqrt(sum(((F.col(c) - F.col(f"_p{c}")) * (F.col(c) - F.col(f"_p{c}")) for c in XYZ), F.lit(0.0))) <= radius
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_t_{k}"))
    for c in XYZ:
        cond = cond & (F.col(f"_a{c}") == F.col(f"_t{c}"))
    return open_points.join(targets, cond, "left_anti").select(*a.columns)


def instance_summary(points: DataFrame, keys: Sequence[str], tile: str) -> DataFrame:
    """Point count, tiles and box of every instance; the number of tiles bounds the collected list."""
    box = points.groupBy(*keys).agg(
        F.count("*").alias("n_points"), F.sort_array(F.collect_set(tile)).alias("tiles"),
        *[F.min(c).alias(f"min_{c}") for c in XYZ], *[F.max(c).alias(f"max_{c}") for c in XYZ],
        *[F.avg(c).alias(f"center_{c}") for c in XYZ],
    )
    return box.select(*keys, "n_points", "tiles", F.size("tiles").cast("bigint").alias("n_tiles"), *box.columns[len(keys) + 2:])


def robust_center(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Middle of the 5th and 95th percentile per axis."""
    wanted = {f"_{c}{p}": (F.col(c), p / 100) for c in XYZ for p in (5, 95)}
    qs = exact_quantiles(points, keys, wanted)
    return qs.select(*keys, *[((F.col(f"_{c}5") + F.col(f"_{c}95")) / 2).alias(f"c{c}") for c in XYZ])


def lift_pixels(masks: DataFrame, tiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """World points of the masked pixels with finite, non-zero coordinates.

    ``masks`` has ``row, col`` and instance columns, ``tiles`` has ``row, col, x, y, z``.
    """
    good = finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z"))
    some = (F.col("x") != 0) | (F.col("y") != 0) | (F.col("z") != 0)
    return masks.join(tiles.where(good & some), [*keys, "row", "col"])


def lift_instances(masks: DataFrame, tiles: DataFrame, keys: Sequence[str], instance: Sequence[str], tile: str, voxel: float, order: str) -> DataFrame:
    """Instances as clouds without repeated voxels, summarized."""
    points = lift_pixels(masks, tiles, keys)
    return instance_summary(voxel_dedup(points, instance, voxel, order), instance, tile)


def depth_points(depth: DataFrame, k: Vec, r: Vec, t: Vec, stride: int = 1) -> DataFrame:
    """World points of every ``stride``-th pixel with positive depth.

    ``depth`` has ``w`` and ``values`` in row order; adds ``u, v, x, y, z``.
    """
    keep = [c for c in depth.columns if c != "values"]
    rows = depth.select(*keep, F.posexplode("values").alias("_i", "_z")).withColumn("_z", F.col("_z").cast("double"))
    rows = rows.where(finite(F.col("_z")) & (F.col("_z") > 0)).withColumn("u", F.col("_i") % F.col("w")).withColumn("v", F.floor(F.col("_i") / F.col("w")))
    if stride > 1:
        rows = rows.where((F.col("u") % stride == 0) & (F.col("v") % stride == 0))
    p = transform(r, t, unproject(k, F.col("u"), F.col("v"), F.col("_z")))
    return rows.select(*keep, "u", "v", *[x.alias(c) for x, c in zip(p, XYZ)])


def colour_points(points: DataFrame, colours: DataFrame, keys: Sequence[str], k: Vec, width: int, height: int) -> DataFrame:
    """Attach the colour of the pixel a camera-frame point falls on; points outside the image are dropped."""
    u, v = project(k, [F.col(c) for c in XYZ])
    rows = points.where(F.col("z") > 0).withColumn("_u", F.rint(u).cast("int")).withColumn("_v", F.rint(v).cast("int"))
    rows = rows.where(F.col("_u").between(0, width - 1) & F.col("_v").between(0, height - 1))
    side = colours.select(*keys, F.col("u").cast("int").alias("_u"), F.col("v").cast("int").alias("_v"), "r", "g", "b")
    return rows.join(side, [*keys, "_u", "_v"]).drop("_u", "_v")


def normals(points: DataFrame, keys: Sequence[str], point_id: str, voxel: float, neighbours: int = 30) -> DataFrame:
    """Unit normal from the nearest ``neighbours`` points (itself included) within two voxels.

    Points of one place are searched for once and count as many; points that are not finite have no neighbours.
    """
    rows = stage(points.where(" and ".join(f"{c} is not null" for c in XYZ)).select(*keys, F.col(point_id).alias("_id"), *XYZ))
    good = finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z"))
    spots = stage(rows.where(good).groupBy(*keys, *XYZ).agg(F.count("*").alias("_m")))

    def fit(p):
        if len(p) < 3:
            return 0.0, 0.0, 1.0
        _, axes = np.linalg.eigh(np.cov(p.T, bias=True))
        return tuple(axes[:, 0])

    out = ("nx", "ny", "nz")
    fits = nearest_fit(spots, keys, 2.0 * voxel, neighbours, fit, out)
    fitted = attach(rows, fits, [*keys, *XYZ])
    return fitted.select(*keys, F.col("_id").alias(point_id), *[F.coalesce(c, F.lit(v)).alias(c) for c, v in zip(out, (0.0, 0.0, 1.0))])
