"""Three-dimensional linear algebra as column expressions, all inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def norm(x, y, z) -> Column:
    x, y, z = col(x), col(y), col(z)
    return F.sqrt(x * x + y * y + z * z)


def dot(a, b) -> Column:
    return sum((col(x) * col(y) for x, y in zip(a[1:], b[1:])), col(a[0]) * col(b[0]))


def apply_matrix(m, v, t=(0.0, 0.0, 0.0)) -> list[Column]:
    """Rows of m (numbers or columns) times v, plus t."""
    one = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return [one(r[0]) * col(v[0]) + one(r[1]) * col(v[1]) + one(r[2]) * col(v[2]) + one(k) for r, k in zip(m, t)]


def yaw(x, y, angle: float) -> tuple[Column, Column]:
    c, s = math.cos(angle), math.sin(angle)
    return col(x) * c - col(y) * s, col(x) * s + col(y) * c


def arc_to_z(n) -> list[list[float]]:
    """The shortest rotation that takes the unit vector n to +z."""
    a, b, c = n
    if c < -1 + 1e-12:
        return [[1.0, 0, 0], [0, -1.0, 0], [0, 0, -1.0]]
    k = 1 / (1 + c)
    return [[1 - a * a * k, -a * b * k, -a], [-a * b * k, 1 - b * b * k, -b], [a, b, 1 - (a * a + b * b) * k]]


def rotate_by_vector(v, w) -> list[Column]:
    """Rodrigues' rotation of v by the rotation vector w."""
    x, y, z = (col(k) for k in v)
    a, b, c = (col(k) for k in w)
    th2 = a * a + b * b + c * c
    th = F.sqrt(th2)
    small = th2 < 1e-24
    s = F.when(small, 1.0).otherwise(F.sin(th) / th)
    k = F.when(small, 0.5).otherwise((1 - F.cos(th)) / th2)
    d = a * x + b * y + c * z
    return [F.cos(th) * p + s * q + k * d * r for p, q, r in ((x, b * z - c * y, a), (y, c * x - a * z, b), (z, a * y - b * x, c))]


def quaternion(r: list) -> list[Column]:
    """w, x, y, z of a rotation matrix given as nine columns, row by row; w is not negative."""
    m = [col(x) for x in r]
    half = lambda e: F.sqrt(F.greatest(F.lit(0.0), e)) / 2
    w, x, y, z = half(1 + m[0] + m[4] + m[8]), half(1 + m[0] - m[4] - m[8]), half(1 - m[0] + m[4] - m[8]), half(1 - m[0] - m[4] + m[8])
    sign = lambda v, e: F.when(e < 0, -v).otherwise(v)
    return [w, sign(x, m[7] - m[5]), sign(y, m[2] - m[6]), sign(z, m[3] - m[1])]


def axial_gap(a, b, period: float) -> Column:
    """Difference of two undirected angles."""
    d = F.pmod(col(a) - col(b), F.lit(period))
    return F.least(d, F.lit(period) - d)
