"""Geometry as Catalyst expressions: vectors, boxes, planes and rays of any number of dimensions.

A coordinate is a Column or a number. Numbers are folded in Python, so that a
filter with a literal query object compares a bare column with a literal, which
reaches the Parquet scan. All predicates are unrolled per dimension and stay in
whole-stage code generation; there are no Python UDFs. A null coordinate makes a
predicate null, so a filter drops the row. NaN isn't supported.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Scalar = Column | float
Vector = Sequence[Scalar]

EPSILON = sys.float_info.epsilon
#: Default tolerance of all predicates.
BASE_TOLERANCE = EPSILON * 100

SEPARATED, ADJACENT, OVERLAPPED = -1, 0, 1
NEGATIVE, HIT, POSITIVE = -1, 0, 1


@dataclass(frozen=True)
class Box:
    """An axis-aligned box; lo <= hi in every dimension, flat boxes allowed."""

    lo: Vector
    hi: Vector

    @property
    def dims(self) -> int:
        return len(self.lo)


@dataclass(frozen=True)
class Plane:
    """Points p with dot(normal, p) = distance; the normal has unit length."""

    distance: Scalar
    normal: Vector


@dataclass(frozen=True)
class Ray:
    """A half line; the direction has unit length."""

    origin: Vector
    direction: Vector


def column(x: Scalar) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def both(parts: Sequence[Column]) -> Column:
    """All of these conditions."""
    return reduce(lambda a, b: a & b, parts)


def total(parts: Sequence[Scalar]) -> Scalar:
    """Sum from left to right."""
    return reduce(lambda a, b: a + b, parts)


def _largest(parts: Sequence[Scalar]) -> Column:
    return F.greatest(*map(column, parts)) if len(parts) > 1 else column(parts[0])


def _smallest(parts: Sequence[Scalar]) -> Column:
    return F.least(*map(column, parts)) if len(parts) > 1 else column(parts[0])


# Vectors


def add(v: Vector, w: Vector) -> list[Scalar]:
    return [a + b for a, b in zip(v, w, strict=True)]


def sub(v: Vector, w: Vector) -> list[Scalar]:
    return [a - b for a, b in zip(v, w, strict=True)]


def multiply(v: Vector, k: Scalar) -> list[Scalar]:
    return [a * k for a in v]


def dot(v: Vector, w: Vector) -> Scalar:
    return total([a * b for a, b in zip(v, w, strict=True)])


def size2(v: Vector) -> Scalar:
    return dot(v, v)


def size(v: Vector) -> Column:
    return F.sqrt(column(size2(v)))


def distance2(v: Vector, w: Vector) -> Scalar:
    return size2(sub(v, w))


def distance(v: Vector, w: Vector) -> Column:
    return F.sqrt(column(distance2(v, w)))


def points_equal(v: Vector, w: Vector, tolerance: float = BASE_TOLERANCE) -> Column:
    return column(distance2(v, w)) <= tolerance * tolerance


def is_normalized(v: Sequence[float]) -> bool:
    return abs(sum(x * x for x in v) - 1.0) < 1e-6


def normalized(v: Vector) -> Column:
    """The same for columns."""
    return F.abs(column(size2(v)) - 1.0) < 1e-6


def almost_equal(a: Scalar, b: Scalar, tolerance: float = BASE_TOLERANCE) -> Column:
    """Two numbers that differ by the tolerance at most."""
    return F.abs(column(a) - column(b)) <= tolerance


def less(a: Scalar, b: Scalar, tolerance: float = BASE_TOLERANCE) -> Column:
    """a is below b by more than the tolerance."""
    return column(a) + tolerance < column(b)


def array_dot(v: Column, w: Column) -> Column:
    """Dot product of two array columns, for many dimensions."""
    return F.aggregate(F.zip_with(v, w, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def array_distance2(v: Column, w: Column) -> Column:
    def term(a: Column, b: Column) -> Column:
        d = a.cast("double") - b.cast("double")
        return d * d

    return F.aggregate(F.zip_with(v, w, term), F.lit(0.0), lambda s, x: s + x)


# Boxes


def center(b: Box) -> list[Scalar]:
    return [(lo + hi) * 0.5 for lo, hi in zip(b.lo, b.hi, strict=True)]


def extent(b: Box) -> list[Scalar]:
    return [hi - lo for lo, hi in zip(b.lo, b.hi, strict=True)]


def move(b: Box, v: Vector) -> Box:
    return Box(add(b.lo, v), add(b.hi, v))


def box_of(p: Vector) -> Box:
    return Box(list(p), list(p))


def unite(a: Box, b: Box) -> Box:
    return Box([F.least(column(x), column(y)) for x, y in zip(a.lo, b.lo, strict=True)], [F.greatest(column(x), column(y)) for x, y in zip(a.hi, b.hi, strict=True)])


def volume(b: Box) -> Scalar:
    return reduce(lambda x, y: x * y, extent(b))


def surface(b: Box) -> Scalar:
    """Perimeter in two dimensions, else the area of all faces."""
    e = extent(b)
    if len(e) == 2:
        return (e[0] + e[1]) * 2.0
    if len(e) == 3:
        return (e[0] * e[1] + e[1] * e[2] + e[2] * e[0]) * 2.0
    faces = [reduce(lambda x, y: x * y, [e[k] for k in range(len(e)) if k != d], 1.0) for d in range(len(e))]
    return total(faces) * 2.0


def contains_point(b: Box, p: Vector, tolerance: float = BASE_TOLERANCE) -> Column:
    """With a tolerance strictly between the widened faces; without one, faces belong to the box."""
    if tolerance:
        return both([(column(lo - tolerance) < column(x)) & (column(x) < column(hi + tolerance)) for lo, hi, x in zip(b.lo, b.hi, p, strict=True)])
    return both([(column(lo) <= column(x)) & (column(x) <= column(hi)) for lo, hi, x in zip(b.lo, b.hi, p, strict=True)])


def overlaps(a: Box, b: Box, tolerance: float = BASE_TOLERANCE) -> Column:
    """Strict overlap: boxes that only touch don't overlap."""
    return both([(column(al + tolerance) < column(bh)) & (column(bl + tolerance) < column(ah)) for al, ah, bl, bh in zip(a.lo, a.hi, b.lo, b.hi, strict=True)])


def relation(a: Box, b: Box, tolerance: float = BASE_TOLERANCE) -> Column:
    """OVERLAPPED, ADJACENT or SEPARATED; the lowest of all dimensions."""
    parts = []
    for al, ah, bl, bh in zip(a.lo, a.hi, b.lo, b.hi, strict=True):
        over = (column(al + tolerance) < column(bh)) & (column(bl + tolerance) < column(ah))
        touch = (F.abs(column(al - bh)) <= tolerance) | (F.abs(column(ah - bl)) <= tolerance)
        parts.append(F.when(over, OVERLAPPED).when(touch, ADJACENT).otherwise(SEPARATED))
    return _least_of(parts)


def _least_of(parts: list[Column]) -> Column:
    return F.least(*parts) if len(parts) > 1 else parts[0]


def inside(outer: Box, inner: Box) -> Column:
    """inner lies in outer, faces included; there is no tolerance here."""
    return both([(column(ol) <= column(il)) & (column(ih) <= column(oh)) for ol, oh, il, ih in zip(outer.lo, outer.hi, inner.lo, inner.hi, strict=True)])


def overlaps_or_touches(a: Box, b: Box, tolerance: float = BASE_TOLERANCE) -> Column:
    return relation(a, b, tolerance) != SEPARATED


def range_contains(outer: Box, inner: Box, tolerance: float = BASE_TOLERANCE) -> Column:
    """Containment widened by the tolerance."""
    return both([
        (column(ol - tolerance) <= column(il)) & (column(il) <= column(oh + tolerance)) & (column(ol - tolerance) <= column(ih)) & (column(ih) <= column(oh + tolerance))
        for ol, oh, il, ih in zip(outer.lo, outer.hi, inner.lo, inner.hi, strict=True)
    ])


def overlaps_by_corner(a: Box, corner: Vector, sizes: Vector) -> Column:
    """Strict overlap with the box that a corner and sizes give; for pruning only."""
    return both([(column(lo) < column(c + s)) & (column(c) < column(hi)) for lo, hi, c, s in zip(a.lo, a.hi, corner, sizes, strict=True)])


def boxes_equal(a: Box, b: Box, tolerance: float = BASE_TOLERANCE) -> Column:
    return both([(F.abs(column(x - y)) <= tolerance) for x, y in zip([*a.lo, *a.hi], [*b.lo, *b.hi], strict=True)])


def wall_distance(p: Vector, b: Box, inside_is_zero: bool = True) -> Column:
    """Distance to a box; inside it zero, or the distance to the nearest face."""
    half = [e * 0.5 for e in extent(b)]
    away = [F.abs(column(lo + h - x)) for lo, h, x in zip(b.lo, half, p, strict=True)]
    within = both([a <= column(h) for a, h in zip(away, half, strict=True)])
    outside = size([F.greatest(F.lit(0.0), a - h) for a, h in zip(away, half, strict=True)])
    inner = F.lit(0.0) if inside_is_zero else _smallest([half[0], *(column(h) - a for a, h in zip(away, half, strict=True))])
    return F.when(within, inner).otherwise(outside)


def min_max_distance(p: Vector, b: Box, tolerance: float = BASE_TOLERANCE) -> tuple[Column, Column]:
    """Distance to the nearest point of a box, and the least distance within which some face must be met (Roussopoulos et al. 1995)."""
    outside, near, far, gap, face = [], [], [], [], []
    for lo, hi, x in zip(b.lo, b.hi, p, strict=True):
        to_lo, to_hi = column(lo - x), column(hi - x)
        a, c = to_lo * to_lo, to_hi * to_hi
        out = ~((column(lo - tolerance) <= column(x)) & (column(x) <= column(hi + tolerance)))
        low, high = F.least(a, c), F.greatest(a, c)
        outside.append(out)
        near.append(F.when(out, low).otherwise(0.0))
        far.append(high)
        gap.append(high - low)
        face.append(F.greatest(F.abs(to_lo), F.abs(to_hi)))
    any_out = reduce(lambda s, t: s | t, outside)
    minimum = F.when(any_out, F.sqrt(total(near))).otherwise(0.0)
    minimax = F.when(any_out, F.sqrt(total(far) - _largest(gap))).otherwise(_smallest(face))
    return minimum, minimax


def upper(value: Scalar, tolerance: float = BASE_TOLERANCE) -> Column:
    """A distance widened by the tolerance."""
    return F.greatest(F.lit(float(tolerance)), column(value) * (1.0 + tolerance))


def lower(value: Scalar, tolerance: float = BASE_TOLERANCE) -> Column:
    """A distance narrowed by the tolerance, zero at least."""
    return F.greatest(F.lit(0.0), F.least(column(value) - tolerance, column(value) * (1.0 - tolerance)))


# Planes


def point_plane(p: Vector, plane: Plane, tolerance: float = BASE_TOLERANCE) -> Column:
    s = column(dot(plane.normal, p))
    return F.when(s < column(plane.distance - tolerance), NEGATIVE).when(s > column(plane.distance + tolerance), POSITIVE).otherwise(HIT)


def box_plane(b: Box, plane: Plane, tolerance: float = BASE_TOLERANCE) -> Column:
    c = center(b)
    half = [(hi - lo) * 0.5 for lo, hi in zip(b.lo, b.hi, strict=True)]
    reach = column(total([tolerance, *(h * (abs(n) if not isinstance(n, Column) else F.abs(n)) for h, n in zip(half, plane.normal, strict=True))]))
    s = column(dot(plane.normal, c)) - plane.distance
    return F.when(s + reach < 0.0, NEGATIVE).when(s - reach > 0.0, POSITIVE).otherwise(HIT)


def checked_plane(plane: Plane) -> Plane:
    """The plane, if its literal normal has unit length."""
    if not any(isinstance(n, Column) for n in plane.normal) and not is_normalized([float(n) for n in plane.normal]):
        raise ValueError("the plane's normal isn't of unit length")
    return plane


# Rays


def ray_hits_box(ray: Ray, b: Box, tolerance: float = BASE_TOLERANCE, increment: float = 0.0) -> Column:
    """STRUCT<enter, exit> of the distances along the ray, or null; the tolerance grows by `increment` per unit of distance."""
    enters, exits, flat = [], [], []
    for o, d, lo, hi in zip(ray.origin, ray.direction, b.lo, b.hi, strict=True):
        if not isinstance(d, Column):
            if abs(d) < 2 * EPSILON:
                flat.append((F.lit(True), column(lo - o), column(hi - o)))
            else:
                x, y = column((lo - o) / d), column((hi - o) / d)
                enters.append(F.least(x, y))
                exits.append(F.greatest(x, y))
            continue
        still = F.abs(d) < 2 * EPSILON
        x, y = column(lo - o) / d, column(hi - o) / d
        flat.append((still, column(lo - o), column(hi - o)))
        enters.append(F.when(still, F.lit(-math.inf)).otherwise(F.least(x, y)))
        exits.append(F.when(still, F.lit(math.inf)).otherwise(F.greatest(x, y)))
    enter, leave = _largest(enters or [-math.inf]), _smallest(exits or [math.inf])
    slack = F.greatest(F.lit(0.0), leave) * increment + tolerance
    first = enter - (F.greatest(F.lit(0.0), enter) * increment + tolerance) * 0.5
    last = leave + slack * 0.5
    miss = [(first >= last) | (last <= 0.0), *(still & ((lo > slack) | (hi < -slack)) for still, lo, hi in flat)]
    hit = ~reduce(lambda s, t: s | t, miss)
    return F.when(hit, F.struct(F.greatest(F.lit(0.0), first).alias("enter"), last.alias("exit")))


def ray_hits_point(ray: Ray, p: Vector, tolerance: float = BASE_TOLERANCE, increment: float = 0.0) -> Column:
    """As ray_hits_box, for a point."""
    v = sub(p, ray.origin)
    s = column(dot(v, ray.direction))
    off = F.greatest(F.lit(0.0), column(size2(v)) - s * s)
    slack = F.greatest(F.lit(0.0), s) * increment + tolerance
    return F.when((off <= slack * slack) & (s >= -slack), F.struct(F.greatest(F.lit(0.0), s - slack).alias("enter"), (s + slack).alias("exit")))
