"""Geometry as column expressions: points, voxels, polar cells, rigid motions."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column, Column]


def xyz(prefix: str = "", names: tuple[str, str, str] = ("x", "y", "z")) -> Point:
    return tuple(F.col(prefix + n) for n in names)


def square_distance(a: Point, b: Point) -> Column:
    dx, dy, dz = (p - q for p, q in zip(a, b))
    return dx * dx + dy * dy + dz * dz


def norm(p: Point) -> Column:
    return F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2])


def distance(a: Point, b: Point) -> Column:
    return F.sqrt(square_distance(a, b))


def voxel(v: Column, size: float) -> Column:
    """Cell number, truncated toward zero: the cells that touch 0 are two cells wide."""
    return (v / F.lit(float(size))).cast("bigint")


def voxel_key(p: Point, size: float, names: tuple[str, str, str] = ("vx", "vy", "vz")) -> list[Column]:
    return [voxel(v, size).alias(n) for v, n in zip(p, names)]


def planar_range(p: Point) -> Column:
    return F.sqrt(p[0] * p[0] + p[1] * p[1])


def polar_angle(p: Point) -> Column:
    """Azimuth in [0, 2 pi); the origin has 0."""
    angle = F.atan2(p[1], p[0])
    return F.when((p[0] == 0) & (p[1] == 0), 0.0).when(p[1] < 0, angle + 2 * math.pi).otherwise(angle)


def elevation(p: Point) -> Column:
    return F.atan2(p[2], planar_range(p))


def sweep_correction(p: Point, degrees: float = 0.205) -> Point:
    """Tilt each point by a fixed angle in the vertical plane through it; points on the axis stay."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    x, y, z = p
    rho = planar_range(p)
    away = rho > 0
    return (
        F.when(away, x * c - x * z / rho * s).otherwise(x),
        F.when(away, y * c - y * z / rho * s).otherwise(y),
        F.when(away, z * c + rho * s).otherwise(z),
    )


def _single(v: float) -> float:
    return struct.unpack("f", struct.pack("f", v))[0]


#: Coefficients of the arctangent polynomial, in single precision.
ATAN_COEFFICIENTS = (0.9997878412794807, -0.3258083974640975, 0.1555786518463281, -0.04432655554792128)
ATAN_DEGREES = tuple(_single(v) * (180 / math.pi) for v in ATAN_COEFFICIENTS)
EPSILON = 2.0**-52


def fast_angle(y: Column, x: Column) -> Column:
    """Angle in degrees in [0, 360) by the odd polynomial of degree 7; sector edges follow it."""
    p1, p3, p5, p7 = ATAN_DEGREES
    ax, ay = F.abs(x), F.abs(y)
    c = F.least(ax, ay) / (F.greatest(ax, ay) + F.lit(EPSILON))
    # one use of the polynomial: the octant picks a sign and an offset
    steep, back, below = ax < ay, x < 0, y < 0
    sign = F.when(steep, -1.0).otherwise(1.0) * F.when(back, -1.0).otherwise(1.0) * F.when(below, -1.0).otherwise(1.0)
    first = F.when(steep, 90.0).otherwise(0.0)
    second = F.when(back, F.lit(180.0) - first).otherwise(first)
    return F.when(below, F.lit(360.0) - second).otherwise(second) + sign * _odd_polynomial(c, p1, p3, p5, p7)


def _odd_polynomial(c: Column, p1: float, p3: float, p5: float, p7: float) -> Column:
    c2 = c * c
    return (((c2 * p7 + p5) * c2 + p3) * c2 + p1) * c


def apply_pose(m: Column, p: Point) -> Point:
    """A pose as array<double>(12), row-major 3 x 4, applied to a point."""
    g = lambda i: m.getItem(i)
    return tuple(g(4 * r) * p[0] + g(4 * r + 1) * p[1] + g(4 * r + 2) * p[2] + g(4 * r + 3) for r in range(3))


def inverse_pose(m: Column) -> Column:
    g = lambda r, c: m.getItem(4 * r + c)
    rows = []
    for r in range(3):
        rows += [g(0, r), g(1, r), g(2, r), -(g(0, r) * g(0, 3) + g(1, r) * g(1, 3) + g(2, r) * g(2, 3))]
    return F.array(*rows)


def compose_pose(a: Column, b: Column) -> Column:
    g = lambda m, r, c: m.getItem(4 * r + c)
    out = []
    for r in range(3):
        for c in range(4):
            v = g(a, r, 0) * g(b, 0, c) + g(a, r, 1) * g(b, 1, c) + g(a, r, 2) * g(b, 2, c)
            out.append(v + g(a, r, 3) if c == 3 else v)
    return F.array(*out)


def relative_pose(a: Column, b: Column) -> Column:
    """The motion from pose a to pose b: inverse(a) * b."""
    return compose_pose(inverse_pose(a), b)


def rotation_angle(m: Column) -> Column:
    trace = m.getItem(0) + m.getItem(5) + m.getItem(10)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2)))


def translation_norm(m: Column) -> Column:
    return norm((m.getItem(3), m.getItem(7), m.getItem(11)))


def model_error(m: Column, max_range: float) -> Column:
    """Largest shift that a deviation causes within range: |t| + 2 range sin(angle / 2)."""
    return translation_norm(m) + 2 * max_range * F.sin(rotation_angle(m) / 2)


def robust_weight(residual2: Column, th: float) -> Column:
    return (th * th) / ((residual2 + th) * (residual2 + th))


def edge_weight(d: Column, limit: float = 60.0) -> Column:
    return (limit - d) / limit


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _length(v: Column, zero: float) -> Column:
    return bind(dot(v, v), lambda s: F.when(s == 0, F.lit(zero)).otherwise(F.sqrt(s)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """dot / (|a| |b|) where a zero length counts as sqrt(1e-11)."""
    return dot(a, b) / (_length(a, math.sqrt(1e-11)) * _length(b, math.sqrt(1e-11)))


def l2_normalise(v: Column) -> Column:
    """v / |v|, with |v| = 1e-6 for a zero vector."""
    return bind(v, lambda w: bind(_length(w, 1e-6), lambda n: F.transform(w, lambda x: x / n)))


def rounded(x: Column, places: int) -> Column:
    """As SQL's round(): half away from zero, and what rounds to zero keeps its sign."""
    return F.round(F.abs(x), places) * F.signum(x)


def l2_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays."""
    d = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.aggregate(F.zip_with(a, b, d), F.lit(0.0), lambda s, x: s + x)


def l1_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def so2_distance(a: Column, b: Column) -> Column:
    """Signed turn from a's last component to b's, within (-pi, pi]."""
    d = F.element_at(b, -1).cast("double") - F.element_at(a, -1).cast("double")
    return F.when(d > math.pi, d - 2 * math.pi).when(d < -math.pi, d + 2 * math.pi).otherwise(d)


def strip_leading_slash(s: Column) -> Column:
    return F.regexp_replace(s, "^/", "")
