"""Scalar column functions: feature algebra, rotations, interpolation, formatting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Overflow gives infinity and a zero divisor gives NULL: a feature that cannot be
# computed for one row must not fail the whole table.


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


UNARY = {
    "^2": lambda a: a * a,
    "^3": lambda a: a * a * a,
    "^-1": lambda a: ratio(F.lit(1.0), a),
    "^-2": lambda a: ratio(F.lit(1.0), a * a),
    "^-3": lambda a: ratio(F.lit(1.0), a * a * a),
    "sqrt": lambda a: F.sqrt(F.abs(a)),
    "exp": F.exp,
    "exp^2": lambda a: F.exp(a * a),
    "exp^3": lambda a: F.exp(a * a * a),
}

BINARY = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "|+|": lambda a, b: F.abs(a + b),
    "|-|": lambda a, b: F.abs(a - b),
    "/": ratio,
}

SUM_COMPOSITES = {name: (lambda a, b, f=UNARY[name]: f(a + b))
                  for name in ("^2", "^3", "exp", "exp^2", "exp^3")}


def r_sigma(rp_a: Column, rs_a: Column, rp_b: Column, rs_b: Column) -> Column:
    return F.abs(rp_a + rs_a - rp_b + rs_b)


def r_pi(rp_a: Column, rs_a: Column, rp_b: Column, rs_b: Column) -> Column:
    return F.abs(rp_a - rs_a) + F.abs(rp_b - rs_b)


def energy_per_root_valence(energy: Column, valence: Column) -> Column:
    return ratio(energy, F.sqrt(valence))


Vec3 = tuple[Column, Column, Column]


def _turn(u: Column, v: Column, degrees: Column) -> tuple[Column, Column]:
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return c * u + s * v, c * v - s * u


def rotate_x(v: Vec3, degrees: Column) -> Vec3:
    """The axes turn by ``degrees``; a point keeps its place (passive rotation)."""
    y, z = _turn(v[1], v[2], degrees)
    return v[0], y, z


def rotate_y(v: Vec3, degrees: Column) -> Vec3:
    x, z = _turn(v[0], v[2], degrees)
    return x, v[1], z


def rotate_z(v: Vec3, degrees: Column) -> Vec3:
    x, y = _turn(v[0], v[1], degrees)
    return x, y, v[2]


def linspace_value(step: Column, start: float, stop: float, count: int) -> Column:
    """Value number ``step`` (0-based) of ``count`` evenly spaced ones, both ends included."""
    if count < 2:
        return F.lit(float(start))
    return F.lit(float(start)) + step * F.lit((float(stop) - float(start)) / (count - 1))


def interpolated(start: Sequence[Column], stop: Sequence[Column], steps: int,
                 include_final: bool = True) -> Column:
    """Array of ``(i, values)`` structs along the straight line from start to stop."""
    last = steps if include_final else steps - 1
    return F.transform(
        F.sequence(F.lit(0), F.lit(last)),
        lambda i: F.struct(i.alias("i"), F.array(*[a + (b - a) * i / F.lit(float(steps))
                                                  for a, b in zip(start, stop)]).alias("values")))


def scientific(value: Column) -> Column:
    """Three decimals in scientific notation; text that is no number stays as it is."""
    text = value.cast("string")
    number = text.try_cast("double")
    return F.when(number.isNull(), text).otherwise(F.format_string("%.3E", number))


def box_name(source: Column, kz: Column, iy: Column, jx: Column) -> Column:
    return F.concat_ws("_", source, kz, iy, jx)
