"""Geometry as Column expressions: they stay inside whole-stage code generation.

A point or vector is a tuple of three DOUBLE columns. Lengths are millimetres, deviations micrometres.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
#: Below this length a vector has no direction.
TINY = 1e-12


def point(prefix: str = "", suffix: str = "") -> Vec:
    """The columns x, y, z of a row as doubles (stored values are floats)."""
    return tuple(F.col(f"{prefix}{c}{suffix}").cast("double") for c in "xyz")  # type: ignore[return-value]


def literal(v) -> Vec:
    return tuple(F.lit(float(x)) for x in v)  # type: ignore[return-value]


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b, strict=True))  # type: ignore[return-value]


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))  # type: ignore[return-value]


def scale(a: Vec, k) -> Vec:
    return tuple(p * k for p in a)  # type: ignore[return-value]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vec, b: Vec) -> Column:
    return length(sub(a, b))


def normalized(a: Vec) -> Vec:
    """Unit vector; one without direction stays as it is."""
    n = length(a)
    return tuple(F.when(n > TINY, x / n).otherwise(x) for x in a)  # type: ignore[return-value]


def face_normal(a: Vec, b: Vec, c: Vec) -> Vec:
    return normalized(cross(sub(b, a), sub(c, a)))


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    return length(cross(sub(b, a), sub(c, a))) * 0.5


def tetra_volume(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Signed volume of the tetrahedron over four points."""
    return dot(sub(b, a), cross(sub(c, a), sub(d, a))) / 6.0


def origin_tetra_volume(a: Vec, b: Vec, c: Vec) -> Column:
    """Signed volume of the tetrahedron of a triangle and the origin."""
    return dot(a, cross(b, c)) / 6.0


def project_onto_sphere(p: Vec, center: Vec, radius) -> Vec:
    """Radial projection; the centre itself goes to centre + (radius, 0, 0)."""
    v = sub(p, center)
    n = length(v)
    return tuple(F.when(n < TINY, c + (radius if i == 0 else 0.0)).otherwise(c + x * (radius / n)) for i, (c, x) in enumerate(zip(center, v, strict=True)))  # type: ignore[return-value]


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def spherical(p: Vec, center: Vec, axis: Vec) -> tuple[Column, Column, Column]:
    """(latitude from the axis, longitude in [0, 2 pi), radius)."""
    v = sub(p, center)
    r, along = length(v), dot(v, axis)
    flat = sub(v, scale(axis, along))
    lon = F.atan2(flat[2], flat[0])
    return F.acos(clamp(along / r, -1.0, 1.0)), F.when(lon < 0, lon + 2 * F.pi()).otherwise(lon), r


def local_frame(w: Vec) -> tuple[Vec, Vec, Vec]:
    """Orthonormal U, V for a unit axis W: U lies across x unless W is close to x, V = W x U."""
    steep = F.abs(w[0]) < 0.9
    zero = F.lit(0.0)
    u = normalized((F.when(steep, zero).otherwise(w[2]), F.when(steep, -w[2]).otherwise(zero), F.when(steep, w[1]).otherwise(-w[0])))
    return u, cross(w, u), w


def longitude(p: Vec, center: Vec, u: Vec, v: Vec) -> Column:
    d = sub(p, center)
    lon = F.atan2(dot(d, v), dot(d, u))
    return F.when(lon < 0, lon + 2 * F.pi()).otherwise(lon)


def plane_distance(p: Vec, origin: Vec, normal: Vec) -> Column:
    return dot(sub(p, origin), normal)


def cap_volume(center: Vec, radius: Column, origin: Vec, normal: Vec) -> Column:
    """Volume of the sphere's part on the normal's side of a plane."""
    h = radius + plane_distance(center, origin, normalized(normal))
    return F.when(h <= 0, F.lit(0.0)).when(h >= 2 * radius, 4.0 / 3.0 * F.pi() * radius * radius * radius).otherwise(F.pi() / 3.0 * h * h * (3 * radius - h))


def round_half_up(x: Column) -> Column:
    """To the nearest integer, halves toward plus infinity."""
    return F.floor(x + 0.5)


def nice_interval(rough: Column) -> Column:
    """1, 2, 5 or 10 times a power of ten: a readable axis step for a rough one."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(rough)))
    share = rough / power
    return F.when(share <= 1, power).when(share <= 2, 2 * power).when(share <= 5, 5 * power).otherwise(10 * power)


def colour_bucket(value: Column, lo: Column, hi: Column, n: int = 512) -> Column:
    """Entry of an n-entry colour table for a value, after clamping to [lo, hi]; null for an empty range."""
    share = (F.greatest(lo, F.least(hi, value)) - lo) / (hi - lo)
    return F.when(hi > lo, F.least(F.lit(n - 1), round_half_up(share * n)).cast("int"))


def auto_range(max_abs_deviation: Column) -> Column:
    """Half width of a colour range: the next ten above, at least ten."""
    return F.greatest(F.lit(10.0), F.ceil(max_abs_deviation / 10) * 10.0)


def diverging_colour(value: Column, lo: Column, hi: Column) -> Vec:
    """Blue to purple below zero, yellow to red above, green within one percent of the range."""
    t = value / F.greatest(F.abs(lo), F.abs(hi))
    s = F.least(F.lit(1.0), F.abs(t))
    below, above = t < -0.01, t > 0.01
    pick = lambda a, b, c: F.when(below, a).when(above, b).otherwise(F.lit(c))
    return pick(0.15 + 0.05 * s, 0.8 + 0.2 * s, 0.3), pick(0.1 * (1 - s), 0.6 * (1 - s), 0.7), pick(0.5 + 0.5 * s, 0.1 * (1 - s), 0.3)


def rgb555(deviation: Column) -> Column:
    """16-bit colour of a facet for a mean deviation in micrometres; bit 15 marks it as set."""
    t = F.least(F.lit(1.0), F.abs(deviation) / 50.0)
    dip, bump = deviation < -1, deviation > 1
    channel = lambda a, b, c: F.least(F.lit(31), F.greatest(F.lit(0), round_half_up(F.when(dip, a).when(bump, b).otherwise(F.lit(float(c)))))).cast("int")
    r, g, b = channel(5 * (1 - t), 20 + 11 * t, 8), channel(2 * (1 - t), 10 * (1 - t), 20), channel(15 + 16 * t, 3 * (1 - t), 8)
    return F.lit(1 << 15).bitwiseOR(F.shiftleft(r, 10)).bitwiseOR(F.shiftleft(g, 5)).bitwiseOR(b)


#: Colour tables: shares of the range, and the colours (0 to 255) there, between which colours go straight. Fixed values.
HEAT = {
    "rainbow": ((0.0, (0, 0, 255)), (0.2, (0, 255, 255)), (0.5, (0, 255, 0)), (0.8, (255, 255, 0)), (1.0, (255, 0, 0))),
    "cooltowarm": ((0.0, (60, 78, 194)), (0.2, (155, 188, 255)), (0.5, (220, 220, 220)), (0.8, (246, 163, 133)), (1.0, (180, 4, 38))),
    "blackbody": ((0.0, (0, 0, 0)), (0.2, (120, 0, 0)), (0.5, (230, 50, 0)), (0.8, (255, 255, 0)), (1.0, (255, 255, 255))),
}


def heat_colour(value: Column, lo: Column, hi: Column, table: str = "rainbow", n: int = 512) -> Vec:
    """Red, green and blue (0 to 1) of a value's entry in an n-entry colour table; grey for an empty range."""
    at = colour_bucket(value, lo, hi, n) / n
    stops = HEAT[table]

    def channel(k: int) -> Column:
        out = F.lit(stops[-1][1][k] / 255)
        for (a, first), (b, last) in reversed(list(zip(stops, stops[1:]))):
            out = F.when(at < b, (first[k] + (at - a) / (b - a) * (last[k] - first[k])) / 255).otherwise(out)
        return F.when(at.isNull(), F.lit(0.5)).otherwise(out)

    return channel(0), channel(1), channel(2)
