"""Filters: one query object against a table. Each returns the rows that match, with all their columns.

Literal query objects become comparisons of columns with folded numbers, which
Spark pushes to the Parquet scan. A user's test is a Column (a pandas UDF's call
is one too) and is evaluated only on rows that pass the geometry.
"""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions import geometry as g
from gridlark.functions.geometry import BASE_TOLERANCE, Box, Plane
from gridlark.sources.spec import STABLE, GeometrySpec


class RangeMode(Enum):
    INSIDE = "inside"
    OVERLAP = "overlap"


class Logic(Enum):
    AND = "and"
    OR = "or"


# Conditions: Columns over a table's geometry, for filters and compound queries.


def within(spec: GeometrySpec, box: Box, tolerance: float = BASE_TOLERANCE) -> Column:
    """Points in the box; boxes that lie in it."""
    return g.contains_point(box, spec.point(), tolerance) if spec.kind == "point" else g.inside(box, spec.box())


def overlapping(spec: GeometrySpec, box: Box, tolerance: float = BASE_TOLERANCE) -> Column:
    """Points in the box; boxes that overlap it."""
    return g.contains_point(box, spec.point(), tolerance) if spec.kind == "point" else g.overlaps(spec.box(), box, tolerance)


def plane_relation(spec: GeometrySpec, plane: Plane, tolerance: float = BASE_TOLERANCE) -> Column:
    """-1, 0 or 1: below, on or above the plane."""
    plane = g.checked_plane(plane)
    return g.point_plane(spec.point(), plane, tolerance) if spec.kind == "point" else g.box_plane(spec.box(), plane, tolerance)


def intersecting(spec: GeometrySpec, plane: Plane, tolerance: float = BASE_TOLERANCE) -> Column:
    return plane_relation(spec, plane, tolerance) == g.HIT


def in_frustum(spec: GeometrySpec, planes: Sequence[Plane], crossing: Sequence[bool] | None = None, tolerance: float = BASE_TOLERANCE) -> Column:
    """Not below any plane; on it only where crossing is allowed. No planes: nothing."""
    if not planes:
        return F.lit(False)
    allowed = list(crossing) if crossing is not None else [True] * len(planes)
    return g.both([plane_relation(spec, p, tolerance) >= (g.HIT if ok else g.POSITIVE) for p, ok in zip(planes, allowed, strict=True)])


def satisfying(test: Column) -> Column:
    """Any test of the user's."""
    return test


# Filters


def pick(df: DataFrame, spec: GeometrySpec, point: Sequence[float], tolerance: float = BASE_TOLERANCE, test: Column | None = None) -> DataFrame:
    """Boxes that contain the point; points equal to it."""
    hit = g.points_equal(spec.point(), point, tolerance) if spec.kind == "point" else g.contains_point(spec.box(), point, tolerance)
    return _tested(df.where(hit), test)


def range_search(df: DataFrame, spec: GeometrySpec, box: Box, mode: RangeMode = RangeMode.INSIDE, tolerance: float = BASE_TOLERANCE, test: Column | None = None, domain: Box | None = None) -> DataFrame:
    """Rows inside, or overlapping, the range.

    A range that contains the whole domain (if that is given, and ids aren't
    stable) gives all rows without the test; any other range without volume
    gives none.
    """
    if domain is not None and spec.ids != STABLE and all(a - tolerance <= c and d <= b + tolerance for a, b, c, d in zip(box.lo, box.hi, domain.lo, domain.hi, strict=True)):
        return df
    if any(a >= b for a, b in zip(box.lo, box.hi, strict=True)):
        return df.where(F.lit(False))
    hit = (within if mode is RangeMode.INSIDE else overlapping)(spec, box, tolerance)
    return _tested(df.where(hit), test)


def plane_search(df: DataFrame, spec: GeometrySpec, plane: Plane, tolerance: float = BASE_TOLERANCE, test: Column | None = None) -> DataFrame:
    """Rows on the plane."""
    return _tested(df.where(intersecting(spec, plane, tolerance)), test)


plane_intersection = plane_search


def plane_positive(df: DataFrame, spec: GeometrySpec, plane: Plane, tolerance: float = BASE_TOLERANCE, test: Column | None = None) -> DataFrame:
    """Rows that aren't below the plane."""
    return _tested(df.where(plane_relation(spec, plane, tolerance) >= g.HIT), test)


def frustum_culling(df: DataFrame, spec: GeometrySpec, planes: Sequence[Plane], tolerance: float = BASE_TOLERANCE, test: Column | None = None) -> DataFrame:
    """Rows that aren't below any plane; the test is asked only of rows that some plane hits."""
    kept = df.where(in_frustum(spec, planes, None, tolerance))
    if test is None or not planes:
        return kept
    above = g.both([plane_relation(spec, p, tolerance) == g.POSITIVE for p in planes])
    return kept.where(above | test)


def query(df: DataFrame, conditions: Sequence[Column], logic: Logic = Logic.AND) -> DataFrame:
    """Rows for which all, or any, of the conditions hold. No conditions: all rows, or none."""
    if not conditions:
        return df if logic is Logic.AND else df.where(F.lit(False))
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c if logic is Logic.AND else out | c
    return df.where(out)


def contains(df: DataFrame, spec: GeometrySpec, geometry: Box | Sequence[float], tolerance: float = BASE_TOLERANCE) -> bool:
    """Is there a row with this geometry?"""
    if isinstance(geometry, Box):
        hit = g.boxes_equal(spec.box(), geometry, tolerance)
    else:
        hit = g.points_equal(spec.point(), geometry, tolerance)
    return not df.where(hit).isEmpty()


def contains_id(df: DataFrame, spec: GeometrySpec, *ids) -> bool:
    return not get(df, spec, *ids).isEmpty()


def get(df: DataFrame, spec: GeometrySpec, *ids) -> DataFrame:
    """The row with this key."""
    return df.where(g.both([F.col(k) == v for k, v in zip(spec.key, ids, strict=True)]))


def domain_box(df: DataFrame, spec: GeometrySpec) -> DataFrame:
    """One row: least and greatest coordinates, min0, max0, min1, ..."""
    b = spec.box()
    sums = [f for d in range(spec.dims) for f in (F.min(b.lo[d]).alias(f"min{d}"), F.max(b.hi[d]).alias(f"max{d}"))]
    return df.agg(*sums)


def domain_of(df: DataFrame, spec: GeometrySpec) -> Box:
    """The domain box, as numbers; that of an empty table is the unit box."""
    r = domain_box(df, spec).first()
    if r["min0"] is None:
        return Box([0.0] * spec.dims, [1.0] * spec.dims)
    return Box([r[f"min{d}"] for d in range(spec.dims)], [r[f"max{d}"] for d in range(spec.dims)])


def _tested(df: DataFrame, test: Column | None) -> DataFrame:
    return df if test is None else df.where(test)
