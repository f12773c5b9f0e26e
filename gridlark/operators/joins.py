"""Joins on overlap and on distance, as equi-joins of grid cells.

Every row goes to the cells that it covers, at a cell size of its own level:
level L's cells are base * 2**L, base being a power of two, and a row's level is
the least at which it is no larger than a cell. One pass over a table tells its
domain, its typical extents and its levels. Thus a row covers at most 2**dims cells at its level, however large
it is. Rows of level A meet rows of level B >= A in cells of level B: the smaller
side's rows are put into those cells too. Only levels that occur are used; there
are a few dozen at most. A pair is kept in one cell only, that of the corner
that both share, so no distinct is needed. Spark chooses the join (broadcast,
hash or sort-merge) by size and splits hot cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions import geometry as g
from gridlark.functions.geometry import BASE_TOLERANCE, Box, Plane
from gridlark.operators.filters import domain_of
from gridlark.plans.storage import cut
from gridlark.sources.spec import GeometrySpec

MOST_LEVELS = 40


@dataclass(frozen=True)
class Stats:
    """What one pass over a table tells: its number of rows, domain, mean extents, and the exponents of two that extents reach."""

    rows: int
    lo: list[float]
    hi: list[float]
    mean: list[float]
    exponents: list[list[int]]

    def cell_sizes(self, rows_per_cell: float = 4.0) -> list[float]:
        """Powers of two: such that evenly spread rows are a few to a cell, and no smaller than a typical row."""
        spread = [b - a for a, b in zip(self.lo, self.hi, strict=True)]
        live = sum(s > 0 for s in spread) or 1
        share = (rows_per_cell / max(1, self.rows)) ** (1 / live)
        return _powers([max(s * share, m, abs(h) * 1e-9, 1e-12) for s, m, h in zip(spread, self.mean, self.hi, strict=True)])

    def levels(self, sizes: Sequence[float]) -> list[int]:
        """All levels that rows may have; at most a few dozen numbers."""
        return sorted({0, *(min(MOST_LEVELS, max(0, e - round(math.log2(s)))) for found, s in zip(self.exponents, sizes, strict=True) for e in found)})


def _powers(sizes: Sequence[float]) -> list[float]:
    return [2.0 ** math.ceil(math.log2(s)) for s in sizes]


def _exponent(lo: Column, hi: Column) -> Column:
    """The least power of two that is no less than an extent; null for flat ones."""
    return F.when(hi > lo, F.ceil(F.log2(hi - lo)).cast("int"))


def stats_of(df: DataFrame, b: Box) -> Stats:
    """One pass, added up before anything is sent."""
    dims = range(b.dims)
    lo, hi = [g.column(x) for x in b.lo], [g.column(x) for x in b.hi]
    sums = [f for d in dims for f in (F.min(lo[d]).alias(f"a{d}"), F.max(hi[d]).alias(f"z{d}"), F.avg(hi[d] - lo[d]).alias(f"m{d}"), F.collect_set(_exponent(lo[d], hi[d])).alias(f"e{d}"))]
    r = df.agg(F.count(lo[0]).alias("n"), *sums).first()
    none = r["a0"] is None
    return Stats(r["n"], *([default if none else r[f"{name}{d}"] for d in dims] for name, default in (("a", 0.0), ("z", 1.0), ("m", 0.0))), [list(r[f"e{d}"]) for d in dims])


def cell_sizes(df: DataFrame, spec: GeometrySpec, rows_per_cell: float = 4.0) -> list[float]:
    """Base cell sizes for a table."""
    return stats_of(df, spec.box()).cell_sizes(rows_per_cell)


def _level(b: Box, sizes: Sequence[float]) -> Column:
    parts = [F.coalesce(_exponent(g.column(lo), g.column(hi)) - round(math.log2(s)), F.lit(0)) for lo, hi, s in zip(b.lo, b.hi, sizes, strict=True)]
    return F.least(F.greatest(F.lit(0), *parts), F.lit(MOST_LEVELS)).cast("int")


def _covered(df: DataFrame, b: Box, sizes: Sequence[float], level: Column) -> DataFrame:
    """One row for each cell of a level that a box covers, with c0, c1, ..."""
    for d, s in enumerate(sizes):
        step = F.lit(s) * F.pow(F.lit(2.0), level)
        df = df.withColumn(f"c{d}", F.explode(F.sequence(F.floor(b.lo[d] / step).cast("long"), F.floor(b.hi[d] / step).cast("long"))))
    return df


def _in_own_cell(a: Box, b: Box, sizes: Sequence[float], level: Column) -> Column:
    """True in one of the cells that two boxes share: that of the corner where both begin."""
    return g.both([F.floor(F.greatest(x, y) / (F.lit(s) * F.pow(F.lit(2.0), level))).cast("long") == F.col(f"c{d}") for d, (x, y, s) in enumerate(zip(a.lo, b.lo, sizes, strict=True))])


def _sided(df: DataFrame, spec: GeometrySpec, side: str, grow: float) -> tuple[DataFrame, Box]:
    """Ids and bounds only, under names of their own, and the bounds as a Box."""
    b = spec.box()
    dims = range(spec.dims)
    rows = df.select(
        *(F.col(k).alias(f"{side}_{k}") for k in spec.key),
        *(g.column(b.lo[d] - grow).alias(f"{side}_min{d}") for d in dims), *(g.column(b.hi[d] + grow).alias(f"{side}_max{d}") for d in dims),
    ).where(g.both([F.col(f"{side}_min{d}").isNotNull() & F.col(f"{side}_max{d}").isNotNull() for d in dims]))
    return rows, Box([F.col(f"{side}_min{d}") for d in dims], [F.col(f"{side}_max{d}") for d in dims])


def _meet(left: DataFrame, lb: Box, right: DataFrame, rb: Box, sizes: Sequence[float], condition: Column, l_levels: list[int] | None = None, r_levels: list[int] | None = None) -> DataFrame:
    """Pairs for which the condition holds, of rows whose closed boxes share a point. Levels are counted where they aren't known."""
    sizes = _powers(sizes)
    l_levels = l_levels if l_levels is not None else stats_of(left, lb).levels(sizes)
    r_levels = r_levels if r_levels is not None else stats_of(right, rb).levels(sizes)
    left, right = left.withColumn("l_level", _level(lb, sizes)), right.withColumn("r_level", _level(rb, sizes))

    def dealt(rows: DataFrame, b: Box, own: str, others: list[int]) -> DataFrame:
        at = F.array(*(F.lit(x) for x in others))
        meet = F.array_distinct(F.transform(at, lambda x: F.greatest(x, F.col(own))))
        return _covered(rows.withColumn("level", F.explode(meet)), b, sizes, F.col("level"))

    a, z = dealt(left, lb, "l_level", r_levels), dealt(right, rb, "r_level", l_levels)
    both = a.join(z, ["level", *(f"c{d}" for d in range(len(sizes)))])
    own_level = F.col("level") == F.greatest("l_level", "r_level")
    return both.where(own_level & _in_own_cell(lb, rb, sizes, F.col("level")) & condition)


def collide(df: DataFrame, spec: GeometrySpec, tolerance: float = BASE_TOLERANCE, sizes: Sequence[float] | None = None, pair_test: Column | None = None) -> DataFrame:
    """Pairs of rows that overlap, each once, l_id < r_id. pair_test may use the l_ and r_ columns."""
    if spec.kind == "point":
        return collide_points(df, spec, tolerance)
    found = stats_of(df, spec.box())
    sizes = _powers(sizes or found.cell_sizes())
    levels = found.levels(sizes)
    left, lb = _sided(df, spec, "l", 0.0)
    right, rb = _sided(df, spec, "r", 0.0)
    ordered = F.struct(*(F.col(f"l_{k}") for k in spec.key)) < F.struct(*(F.col(f"r_{k}") for k in spec.key))
    hit = ordered & g.overlaps(lb, rb, tolerance)
    met = _meet(left, lb, right, rb, sizes, hit if pair_test is None else hit & pair_test, levels, levels)
    return met.select(*(f"l_{k}" for k in spec.key), *(f"r_{k}" for k in spec.key))


def collide_two(left: DataFrame, left_spec: GeometrySpec, right: DataFrame, right_spec: GeometrySpec, tolerance: float = BASE_TOLERANCE, sizes: Sequence[float] | None = None, pair_test: Column | None = None, hit=None) -> DataFrame:
    """Pairs of a left and a right row that overlap. hit(l, r) may replace the overlap by a condition that implies a common point."""
    l_stats, r_stats = stats_of(left, left_spec.box()), stats_of(right, right_spec.box())
    sizes = _powers(sizes or [max(x) for x in zip(l_stats.cell_sizes(), r_stats.cell_sizes(), strict=True)])
    a, lb = _sided(left, left_spec, "l", 0.0)
    z, rb = _sided(right, right_spec, "r", 0.0)
    meets = g.overlaps(lb, rb, tolerance) if hit is None else hit(lb, rb)
    found = _meet(a, lb, z, rb, sizes, meets if pair_test is None else meets & pair_test, l_stats.levels(sizes), r_stats.levels(sizes))
    return found.select(*(f"l_{k}" for k in left_spec.key), *(f"r_{k}" for k in right_spec.key))


def within_distance(left: DataFrame, left_spec: GeometrySpec, right: DataFrame, right_spec: GeometrySpec, distance: float) -> DataFrame:
    """Pairs of points no farther apart than the distance, with dist2."""
    sizes = [max(distance, x) for x in cell_sizes(right, right_spec)]
    a, lb = _sided(left, left_spec, "l", distance)
    z, rb = _sided(right, right_spec, "r", 0.0)
    a = a.join(left.select(*(F.col(k).alias(f"l_{k}") for k in left_spec.key), *(x.alias(f"l_x{d}") for d, x in enumerate(left_spec.point()))), [f"l_{k}" for k in left_spec.key])
    dist2 = g.column(g.distance2([F.col(f"l_x{d}") for d in range(left_spec.dims)], rb.lo))
    near = _meet(a, lb, z, rb, sizes, dist2 <= distance * distance)
    return near.select(*(f"l_{k}" for k in left_spec.key), *(f"r_{k}" for k in right_spec.key), dist2.alias("dist2"))


def collide_points(df: DataFrame, spec: GeometrySpec, tolerance: float = BASE_TOLERANCE) -> DataFrame:
    """Pairs of points with equal first coordinates and a distance within the tolerance: an equi-join."""
    side = lambda s: df.select(*(F.col(k).alias(f"{s}_{k}") for k in spec.key), *(x.alias(f"{s}_p{d}") for d, x in enumerate(spec.point())))
    left, right = side("l"), side("r")
    ordered = F.struct(*(F.col(f"l_{k}") for k in spec.key)) < F.struct(*(F.col(f"r_{k}") for k in spec.key))
    dims = range(spec.dims)
    near = g.points_equal([F.col(f"l_p{d}") for d in dims], [F.col(f"r_p{d}") for d in dims], tolerance)
    return left.join(right, F.col("l_p0") == F.col("r_p0")).where(ordered & near).select(*(f"l_{k}" for k in spec.key), *(f"r_{k}" for k in spec.key))


def batch_range(queries: DataFrame, query_spec: GeometrySpec, df: DataFrame, spec: GeometrySpec, inside: bool = True, tolerance: float = BASE_TOLERANCE) -> DataFrame:
    """Many ranges against a table: l_ keys of queries, r_ keys of rows. Ranges without volume find nothing."""

    def hit(q: Box, r: Box) -> Column:
        solid = g.both([g.column(a) < g.column(b) for a, b in zip(q.lo, q.hi, strict=True)])
        if spec.kind == "point":
            return solid & g.contains_point(q, r.lo, tolerance)
        return solid & (g.inside(q, r) if inside else g.overlaps(q, r, tolerance))

    return collide_two(queries, query_spec, df, spec, hit=hit, sizes=cell_sizes(df, spec))


def batch_pick(queries: DataFrame, query_spec: GeometrySpec, df: DataFrame, spec: GeometrySpec, tolerance: float = BASE_TOLERANCE) -> DataFrame:
    """Many points against a table of boxes."""
    return collide_two(queries, query_spec, df, spec, hit=lambda q, r: g.contains_point(r, q.lo, tolerance), sizes=cell_sizes(df, spec))


#: Planes, or frusta, that are sent to all tasks at once; more go in blocks.
MOST_QUERIES = 10_000


def _in_blocks(queries: DataFrame, key: str, df: DataFrame, condition: Column) -> DataFrame:
    """Rows of df with each query for which the condition holds. No key tells which rows a plane may meet: all queries are compared with all rows, block by block of at most about MOST_QUERIES."""
    n = queries.count()
    blocks = max(1, -(-n // MOST_QUERIES))
    out = None
    for i in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == i)
        met = df.join(F.broadcast(part), condition)
        out = met if out is None else out.unionAll(met)
    return out


def batch_planes(planes: DataFrame, df: DataFrame, spec: GeometrySpec, positive: bool = False, tolerance: float = BASE_TOLERANCE, key: str = "qid") -> DataFrame:
    """Many planes (key, d, n0, n1, ...) against a table: key and r_ keys of the rows on each plane; positive: of those not below it. A normal that isn't of unit length finds nothing."""
    asked = planes.select(F.col(key).alias("_q"), F.col("d").alias("_d"), *(F.col(f"n{i}").alias(f"_n{i}") for i in range(spec.dims)))
    normal = [F.col(f"_n{i}") for i in range(spec.dims)]
    asked = asked.where(g.normalized(normal))
    plane = Plane(F.col("_d"), normal)
    relation = g.point_plane(spec.point(), plane, tolerance) if spec.kind == "point" else g.box_plane(spec.box(), plane, tolerance)
    met = _in_blocks(asked, "_q", df, relation >= g.HIT if positive else relation == g.HIT)
    return met.select(F.col("_q").alias(key), *(F.col(k).alias(f"r_{k}") for k in spec.key))


def batch_frusta(planes: DataFrame, df: DataFrame, spec: GeometrySpec, tolerance: float = BASE_TOLERANCE, key: str = "qid") -> DataFrame:
    """Many frusta (rows of key, d, n0, n1, ...; the planes of a key are one frustum) against a table: key and r_ keys of the rows that aren't below any of its planes."""
    fields = [F.col("d"), *(F.col(f"n{i}") for i in range(spec.dims))]
    asked = planes.groupBy(F.col(key).alias("_q")).agg(F.collect_list(F.struct(*fields)).alias("_planes"))

    def kept(p: Column) -> Column:
        plane = Plane(p["d"], [p[f"n{i}"] for i in range(spec.dims)])
        return (g.point_plane(spec.point(), plane, tolerance) if spec.kind == "point" else g.box_plane(spec.box(), plane, tolerance)) >= g.HIT

    met = _in_blocks(asked, "_q", df, F.forall("_planes", kept))
    return met.select(F.col("_q").alias(key), *(F.col(k).alias(f"r_{k}") for k in spec.key))


def knn_join(queries: DataFrame, query_spec: GeometrySpec, df: DataFrame, spec: GeometrySpec, k: int, tolerance: float = BASE_TOLERANCE, max_distance: float | None = None) -> DataFrame:
    """For each query point its k nearest points, and those as near as the k-th: l_ keys, r_ keys, dist.

    Queries look into the 3**dims cells around them. One with k points no
    farther than a cell's width has its answer; the others go on with cells
    twice as wide. There are no more rounds than doublings from the first cell to the domain.
    """
    if k <= 0:
        return within_distance(queries.where(F.lit(False)), query_spec, df, spec, 1.0).select(*(f"l_{x}" for x in query_spec.key), *(f"r_{x}" for x in spec.key), F.lit(0.0).alias("dist"))
    domain = domain_of(df.select(*spec.point()), GeometrySpec("point", [f"`{c}`" for c in df.select(*spec.point()).columns]))
    asked = domain_of(queries.select(*query_spec.point()), GeometrySpec("point", [f"`{c}`" for c in queries.select(*query_spec.point()).columns]))
    span = math.sqrt(sum((max(b, d) - min(a, c)) ** 2 for a, b, c, d in zip(domain.lo, domain.hi, asked.lo, asked.hi, strict=True))) or 1.0
    n = max(1, df.count())
    width = max(max(b - a for a, b in zip(domain.lo, domain.hi, strict=True)) * (k / n) ** (1 / spec.dims), span * 2.0**-30)
    dims = range(spec.dims)
    left = cut(queries.select(*(F.col(c).alias(f"l_{c}") for c in query_spec.key), *(x.alias(f"x{d}") for d, x in enumerate(query_spec.point()))))
    right = cut(df.select(*(F.col(c).alias(f"r_{c}") for c in spec.key), *(x.alias(f"y{d}") for d, x in enumerate(spec.point()))))
    keys = [f"l_{c}" for c in query_spec.key]
    done: list[DataFrame] = []
    limit = None if max_distance is None else max(tolerance, max_distance * (1.0 + tolerance))
    while True:
        last = width >= span * 1.01
        a, z = left, right
        for d in dims:
            c = F.floor(F.col(f"x{d}") / width).cast("long")
            a = a.withColumn(f"c{d}", F.explode(F.sequence(c - 1, c + 1)))
            z = z.withColumn(f"c{d}", F.floor(F.col(f"y{d}") / width).cast("long"))
        dist = g.distance([F.col(f"x{d}") for d in dims], [F.col(f"y{d}") for d in dims])
        near = a.join(z, [f"c{d}" for d in dims]).withColumn("dist", dist).where(F.col("dist") <= (span * 2 if last else width))
        near = near if limit is None else near.where(F.col("dist") < limit)
        kth = _kth(near, keys, k)
        full = kth if last else kth.where((F.col("n") >= k) & (g.upper(F.col("kth"), tolerance) <= width))
        full = cut(full)
        bound = F.when(F.col("n") >= k, g.upper(F.col("kth"), tolerance)).otherwise(F.lit(math.inf))
        found = near.join(full, keys).where((F.col("dist") < bound) | (F.col("dist") <= F.col("kth")))
        done.append(cut(found.select(*keys, *(f"r_{c}" for c in spec.key), "dist")))
        if last:
            break
        left = cut(left.join(full.select(*keys), keys, "left_anti"))
        if left.isEmpty():
            break
        width *= 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _kth(near: DataFrame, keys: list[str], k: int) -> DataFrame:
    """n and kth: how many rows a query has, and its k-th least distance (the greatest, if fewer)."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("dist"))
    return near.withColumn("at", at).where(F.col("at") <= k).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("kth"))
