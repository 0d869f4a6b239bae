"""Rigid-body column functions.

Vectors are sequences of three columns, quaternions ``(x, y, z, w)`` of four, rotation matrices of nine in row order.
All of it is plain column arithmetic, so it stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Sequence[Column]


def lits(values) -> list[Column]:
    return [F.lit(float(v)) for v in values]


def dot(a: Vec, b: Vec) -> Column:
    return reduce(add, [x * y for x, y in zip(a, b)])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vec, b: Vec) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def vadd(a: Vec, b: Vec) -> list[Column]:
    return [x + y for x, y in zip(a, b)]


def vsub(a: Vec, b: Vec) -> list[Column]:
    return [x - y for x, y in zip(a, b)]


def scale(a: Vec, k: Column) -> list[Column]:
    return [x * k for x in a]


def unit(a: Vec) -> list[Column]:
    n = norm(a)
    return [x / n for x in a]


def quat_to_matrix(q: Vec) -> list[Column]:
    """G1: rotation matrix of a quaternion of any non-zero length."""
    x, y, z, w = q
    two = F.lit(2.0) / dot(q, q)
    one = F.lit(1.0)
    return [
        one - two * (y * y + z * z), two * (x * y - z * w), two * (x * z + y * w),
        two * (x * y + z * w), one - two * (x * x + z * z), two * (y * z - x * w),
        two * (x * z - y * w), two * (y * z + x * w), one - two * (x * x + y * y),
    ]


def matrix_to_quat(m: Vec) -> list[Column]:
    """G1: unit quaternion with non-negative largest component first chosen among trace and diagonal."""
    trace = m[0] + m[4] + m[8]
    one, quarter = F.lit(1.0), F.lit(0.25)
    zero = F.lit(0.0)

    def root(v):
        return F.sqrt(F.greatest(v, zero)) * 2.0

    s_w, s_x = root(one + trace), root(one + m[0] - m[4] - m[8])
    s_y, s_z = root(one - m[0] + m[4] - m[8]), root(one - m[0] - m[4] + m[8])
    by_w = [(m[7] - m[5]) / s_w, (m[2] - m[6]) / s_w, (m[3] - m[1]) / s_w, quarter * s_w]
    by_x = [quarter * s_x, (m[1] + m[3]) / s_x, (m[2] + m[6]) / s_x, (m[7] - m[5]) / s_x]
    by_y = [(m[1] + m[3]) / s_y, quarter * s_y, (m[5] + m[7]) / s_y, (m[2] - m[6]) / s_y]
    by_z = [(m[2] + m[6]) / s_z, (m[5] + m[7]) / s_z, quarter * s_z, (m[3] - m[1]) / s_z]
    use_w = trace > 0
    use_x = (m[0] >= m[4]) & (m[0] >= m[8])
    use_y = m[4] >= m[8]
    return [F.when(use_w, a).when(use_x, b).when(use_y, c).otherwise(d) for a, b, c, d in zip(by_w, by_x, by_y, by_z)]


def matrix_to_euler(m: Vec) -> list[Column]:
    """G1: angles about the fixed x, y, z axes, applied in that order."""
    sy = F.greatest(F.least(-m[6], F.lit(1.0)), F.lit(-1.0))
    return [F.atan2(m[7], m[8]), F.asin(sy), F.atan2(m[3], m[0])]


def euler_to_matrix(angles: Vec) -> list[Column]:
    """G1: inverse of ``matrix_to_euler``."""
    (cx, cy, cz), (sx, sy, sz) = [F.cos(a) for a in angles], [F.sin(a) for a in angles]
    return [
        cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx,
        sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx,
        -sy, cy * sx, cy * cx,
    ]


def rotate(m: Vec, v: Vec) -> list[Column]:
    """``R v``."""
    return [dot(m[3 * i: 3 * i + 3], v) for i in range(3)]


def transform(m: Vec, t: Vec, p: Vec) -> list[Column]:
    """``R p + t``."""
    return vadd(rotate(m, p), t)


def transpose(m: Vec) -> list[Column]:
    return [m[3 * j + i] for i in range(3) for j in range(3)]


def quat_product(a: Vec, b: Vec) -> list[Column]:
    """Rotation ``a`` after rotation ``b``."""
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return [
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
        aw * bw - ax * bx - ay * by - az * bz,
    ]


def invert(m: Vec, t: Vec) -> tuple[list[Column], list[Column]]:
    """Inverse rigid transform."""
    r = transpose(m)
    return r, [-x for x in rotate(r, t)]


def compose(ma: Vec, ta: Vec, mb: Vec, tb: Vec) -> tuple[list[Column], list[Column]]:
    """Transform ``a`` after transform ``b``."""
    m = [dot(ma[3 * i: 3 * i + 3], [mb[j], mb[3 + j], mb[6 + j]]) for i in range(3) for j in range(3)]
    return m, transform(ma, ta, tb)


def slerp_weights(d: Column, w: Column) -> tuple[Column, Column]:
    """Factors of two unit quaternions with product ``d`` at ``w`` on the shorter arc; linear when parallel.

    Take ``d`` from a column computed one step earlier, so that it is not worked out again at each use.
    """
    sign = F.when(d < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    theta = F.acos(F.least(F.abs(d), F.lit(1.0)))
    st = F.sin(theta)
    flat = st < 1e-8
    ka = F.when(flat, F.lit(1.0) - w).otherwise(F.sin((F.lit(1.0) - w) * theta) / st)
    kb = F.when(flat, w).otherwise(F.sin(w * theta) / st)
    return ka, sign * kb


def project(k: Vec, p: Vec) -> list[Column]:
    """Pixel of a camera-frame point with intrinsics ``(fx, fy, cx, cy)``."""
    fx, fy, cx, cy = k
    return [fx * p[0] / p[2] + cx, fy * p[1] / p[2] + cy]


def project_safe(k: Vec, p: Vec, width: int, height: int, z_min: float = 1e-6) -> list[Column]:
    """Pixel, or nulls when the point is behind the camera or its pixel lies outside the half-open image."""
    front = F.when(p[2] > z_min, p[2])
    u, v = project(k, [p[0], p[1], front])
    ok = (u >= 0) & (u < width) & (v >= 0) & (v < height)
    return [F.when(ok, u), F.when(ok, v)]


def to_radians(v: Vec) -> list[Column]:
    """turn rates given in degrees."""
    return [F.radians(c) for c in v]


def scale_pixel(u: Column, v: Column, rgb_size: tuple[int, int], depth_size: tuple[int, int]) -> list[Column]:
    """Colour-image pixel in depth-image coordinates; sizes are (width, height)."""
    return [u * (depth_size[0] / rgb_size[0]), v * (depth_size[1] / rgb_size[1])]


def bilinear(values: Column, width: Column, height: Column, u: Column, v: Column) -> Column:
    """Depth at a sub-pixel position from its valid (finite, positive) neighbours among the four around it.

    Null when one of the four lies outside the image or none is valid.
    """
    u0, v0 = F.floor(u), F.floor(v)
    du, dv = u - u0, v - v0

    def at(dx: int, dy: int):
        val = F.try_element_at(values, ((v0 + dy) * width + u0 + dx + 1).cast("int")).cast("double")
        good = val.isNotNull() & ~F.isnan(val) & (val > 0) & (val < float("inf"))
        wx = du if dx else F.lit(1.0) - du
        wy = dv if dy else F.lit(1.0) - dv
        return F.when(good, val).otherwise(F.lit(0.0)), F.when(good, wx * wy).otherwise(F.lit(0.0))

    cells = [at(0, 0), at(1, 0), at(0, 1), at(1, 1)]
    weight = reduce(add, [w for _, w in cells])
    total = reduce(add, [x * w for x, w in cells])
    inside = (u0 >= 0) & (u0 + 1 < width) & (v0 >= 0) & (v0 + 1 < height)
    return F.when(inside, total / F.when(weight > 0, weight))


def transport_velocity(v: Vec, omega: Vec, r: Vec) -> list[Column]:
    """Velocity of a point at offset ``r`` of a turning body."""
    return vadd(v, cross(omega, r))


def along(force: Vec, motion: Vec, eps: float = 1e-12) -> tuple[Column, list[Column]]:
    """Signed size of ``force`` along ``motion`` and that part as a vector; zero when there is no motion."""
    n = norm(motion)
    moving = n > eps
    direction = [F.when(moving, x / n).otherwise(F.lit(0.0)) for x in motion]
    size = dot(force, direction)
    return size, scale(direction, size)


def move_wrench(force: Vec, torque: Vec, lever: Vec) -> list[Column]:
    """Torque about a point reached by ``lever`` from the point to the sensor."""
    return vadd(torque, cross(lever, force))


def fingertips(tool_axis: Vec, center: Vec, half_gap: Column) -> tuple[list[Column], list[Column]]:
    """Two tip positions at plus and minus ``half_gap`` along the tool axis."""
    step = scale(tool_axis, half_gap)
    return vadd(center, step), vsub(center, step)


def unproject(k: Vec, u: Column, v: Column, depth: Column) -> list[Column]:
    """Camera-frame point of a pixel with depth."""
    fx, fy, cx, cy = k
    return [(u - cx) * depth / fx, (v - cy) * depth / fy, depth]


def equirect_pixel(d: Vec, width: int, height: int) -> list[Column]:
    """Panorama pixel of a camera direction (longitude from z towards x, latitude towards y)."""
    import math

    n = norm(d)
    lon = F.atan2(d[0], d[2])
    lat = F.asin(F.greatest(F.least(d[1] / n, F.lit(1.0)), F.lit(-1.0)))
    u = (lon / (2 * math.pi) + 0.5) * width
    v = (F.lit(0.5) - lat / math.pi) * height
    return [u, v]


def rescale_depth(values: Column, factor: Column, mask: Column | None = None) -> Column:
    """Depth array divided by ``factor``, zero outside the mask array."""
    if mask is None:
        return F.transform(values, lambda x: x / factor)
    return F.zip_with(values, mask, lambda x, m: F.when(m, x / factor).otherwise(F.lit(0.0)))


def depth_to_millimetres(depth: Column) -> Column:
    """Metres to whole millimetres in the 16-bit range, rounding half to even."""
    return F.least(F.greatest(F.rint(depth * 1000.0), F.lit(0.0)), F.lit(65535.0)).cast("int")
