"""Gripper and force-torque column functions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorframe.functions.geometry import Vec, cross, dot, norm, rotate, vadd, vsub

GRAVITY = 9.81

# Fixed values of the gripper model: link lengths [m], mounting angle and closed threshold [deg], motor constants
# [N m / A] and [N m], fingertip helper offsets [m].
L1 = 0.038
L2 = 0.0444
TAU_DEG = 64.0
PARTIALLY_CLOSED_DEG = 85.0
K1 = 1.769
K2 = -0.2214
HELPER_RY = 2 * 0.007071
HELPER_RZ = 0.144
# Motor current range [mA] of the efficiency table and its efficiencies, one per equal-width bin.
CURRENT_MIN_MA = -200.0
CURRENT_MAX_MA = 1200.0
ETA_BINS = (
    0.03186942920960295, 0.03186942920960295, 0.025132572541536807, 0.09254881657478439, 1.5, 1.5,
    0.9738673713505731, 0.6192106650584402, 0.46332143648903246, 0.48681474522139245, 0.4833029744117554,
    0.4172706221064947, 0.3740295235488369, 0.3874455458009995, 0.4275646686392278, 0.38496224305917287,
    0.33775737967135905, 0.33775737967135905, 0.33775737967135905, 0.33775737967135905,
)
# Sensor capacity per axis (two fingers of 4, 4 and 5 N).
LOAD_CAPS = (8.0, 8.0, 10.0)


def motor_angle(position: Column) -> Column:
    """Crank angle from the motor position [rad]."""
    return position + math.radians(180.0 - TAU_DEG)


def closed_position() -> float:
    """P10: motor position above which the gripper counts as partially closed [rad]."""
    return math.radians(PARTIALLY_CLOSED_DEG + TAU_DEG - 180.0)


def finger_position(alpha: Column) -> Column:
    """F16: finger travel of one side [m]."""
    rest = F.lit(L2**2) - F.pow(F.lit(L1) * F.sin(alpha), F.lit(2.0))
    return F.lit(L1) * F.cos(alpha) + F.sqrt(F.greatest(rest, F.lit(0.0)))


def gap_slope(alpha: Column) -> Column:
    """F16: change of the full gap with the crank angle [m/rad]."""
    s, c = F.sin(alpha), F.cos(alpha)
    rest = F.greatest(F.lit(L2**2) - F.lit(L1**2) * s * s, F.lit(1e-12))
    return F.lit(2.0) * (-F.lit(L1) * s - F.lit(L1**2) * s * c / F.sqrt(rest))


def motor_torque(current_ma: Column) -> Column:
    """torque [N m] from motor current in mA, converted to A exactly once."""
    return F.lit(K1) * (current_ma / 1000.0) + F.lit(K2)


def clamp_force(alpha: Column, current_ma: Column, eta: Column | float = 1.0) -> Column:
    """clamp force of one finger [N]."""
    eta = F.lit(float(eta)) if isinstance(eta, (int, float)) else eta
    return F.abs(eta * motor_torque(current_ma)) / F.greatest(F.abs(gap_slope(alpha)), F.lit(1e-9))


def piecewise_linear(x: Column, first: float, step: float, values: Sequence[float]) -> Column:
    """linear lookup on evenly spaced nodes, the end values outside."""
    last = len(values) - 1
    pos = F.greatest(F.least((x - first) / step, F.lit(float(last))), F.lit(0.0))
    i = F.least(F.floor(pos), F.lit(last - 1)).cast("int")
    table = F.array(*[F.lit(float(v)) for v in values])
    a, b = F.get(table, i), F.get(table, i + 1)
    return a + (pos - i) * (b - a)


def efficiency(current_ma: Column, values: Sequence[float] = ETA_BINS) -> Column:
    """motor efficiency at a current, linear between bin centres."""
    width = (CURRENT_MAX_MA - CURRENT_MIN_MA) / len(values)
    return piecewise_linear(current_ma, CURRENT_MIN_MA + width / 2, width, values)


def first_of_list(text: Column) -> Column:
    """number in a text such as ``[v]``."""
    return F.regexp_extract(text, r"\[?\s*([-+0-9.eE]+)", 1).try_cast("double")


def drop_outlier(value: Column, limit: float) -> Column:
    """zero where the reading exceeds ``limit``."""
    return F.when(value > limit, F.lit(0.0)).otherwise(value)


def gravity_in_sensor(r_sensor_world: Vec, g: float = GRAVITY) -> list[Column]:
    """World gravity ``(0, 0, -g)`` seen by the sensor; the rotation maps world to sensor."""
    return [r_sensor_world[3 * i + 2] * F.lit(-g) for i in range(3)]


def compensate(force: Vec, torque: Vec, g_s: Vec, mass: Column, cog: Vec, f0: Vec, tau0: Vec) -> tuple[list[Column], list[Column]]:
    """Contact force and torque after removing bias and tool weight."""
    weight = [mass * x for x in g_s]
    return vsub(vsub(force, f0), weight), vsub(vsub(torque, tau0), cross(cog, weight))


def inertia_times(inertia: Vec, v: Vec) -> list[Column]:
    """Symmetric inertia ``(xx, yy, zz, xy, xz, yz)`` times a vector."""
    xx, yy, zz, xy, xz, yz = inertia
    return [dot([xx, xy, xz], v), dot([xy, yy, yz], v), dot([xz, yz, zz], v)]


def internal_wrench(g_s: Vec, acc: Vec, omega: Vec, alpha: Vec, mass: Column, cog: Vec, inertia: Vec, gyro: bool = False) -> tuple[list[Column], list[Column]]:
    """Force and torque the moving tool itself puts on the sensor."""
    a_c = vadd(acc, vadd(cross(alpha, cog), cross(omega, cross(omega, cog))))
    force = [mass * (g + a) for g, a in zip(g_s, a_c)]
    torque = vadd(cross(cog, force), inertia_times(inertia, alpha))
    if gyro:
        torque = vadd(torque, cross(omega, inertia_times(inertia, omega)))
    return force, torque


def load_columns(helper: Vec, clamp: Column, caps: Sequence[float] = LOAD_CAPS) -> dict[str, Column]:
    """Load per finger-pad axis and its norms, raw and with every axis capped.

    ``helper`` is the external force in the helper frame, whose y, z and x axes lie along the pad's x, y and normal;
    the clamp force of both fingers adds to the normal.
    """
    x, y = F.abs(helper[1]), F.abs(helper[2])
    z = F.lit(2.0) * F.abs(clamp) + F.abs(helper[0])
    out = {}
    for suffix, axes in (("", (x, y, z)), ("_clipped", [F.least(v, F.lit(c)) for v, c in zip((x, y, z), caps)])):
        out.update({f"L_star_{n}{suffix}": v for n, v in zip("xyz", axes)})
        out[f"L_star{suffix}"] = axes[0] + axes[1] + axes[2]
        out[f"L_star_L2{suffix}"] = norm(axes)
        out[f"L_star_tangential_L2{suffix}"] = norm(axes[:2])
    return out


def load_lower_bound(force: Vec, torque: Vec, p1: Vec, p2: Vec, inward: Vec) -> Column:
    """Load the couple about the middle of the fingertips needs; null when the tips coincide."""
    d = vsub(p1, p2)
    gap = norm(d)
    gap = F.when(gap > 0, gap)
    axis = cross([x / gap for x in d], inward)
    size = norm(axis)
    middle = [(a + b) * 0.5 for a, b in zip(p1, p2)]
    couple = vsub(torque, cross(middle, force))
    return F.lit(2.0) * F.abs(dot(couple, axis) / F.when(size > 0, size)) / gap


def combined_prediction(left: Vec, right: Vec, caps: Sequence[float] | None = None) -> dict[str, Column]:
    """Tangential, normal and combined size of the summed absolute predictions; missing sides count zero."""
    axes = [F.abs(F.coalesce(a, F.lit(0.0))) + F.abs(F.coalesce(b, F.lit(0.0))) for a, b in zip(left, right)]
    if caps is not None:
        axes = [F.least(v, F.lit(c)) for v, c in zip(axes, caps)]
    return {"tangential_L2": norm(axes[:2]), "normal_L2": axes[2], "combined_L2": norm(axes)}


def to_log(force: Column) -> Column:
    """F21."""
    return F.log1p(force)


def from_log(value: Column) -> Column:
    """inverse of ``to_log`` with the result held in 0..80."""
    return F.greatest(F.least(F.expm1(value), F.lit(80.0)), F.lit(0.0))


def world_wrench(r_world_sensor: Vec, force: Vec, torque: Vec, lever: Vec) -> tuple[list[Column], list[Column]]:
    """Wrench in world axes about a tool point; ``lever`` runs from the point to the sensor, in world axes."""
    f = rotate(r_world_sensor, force)
    return f, vadd(rotate(r_world_sensor, torque), cross(lever, f))
