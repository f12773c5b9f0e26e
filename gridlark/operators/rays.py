"""Rays against a table of boxes or points."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions import geometry as g
from gridlark.functions.geometry import BASE_TOLERANCE, EPSILON, Box, Ray
from gridlark.operators.joins import Stats, _covered, _in_own_cell, _level, _powers, _sided, stats_of
from gridlark.sources.spec import GeometrySpec

#: Pieces of a ray at one level; beyond that they are longer than a cell, and cover more of them.
MOST_PIECES = 1 << 16


def _hits(df: DataFrame, spec: GeometrySpec, ray: Ray, tolerance: float, increment: float, test: Column | None, user_distance: Column | None) -> DataFrame:
    if not any(isinstance(x, Column) for x in ray.direction) and not g.is_normalized([float(x) for x in ray.direction]):
        return df.withColumns({"enter": F.lit(0.0), "exit": F.lit(0.0)}).where(F.lit(False))
    hit = g.ray_hits_point(ray, spec.point(), tolerance, increment) if spec.kind == "point" else g.ray_hits_box(ray, spec.box(), tolerance, increment)
    rows = df.withColumn("_hit", hit).where(F.col("_hit").isNotNull())
    rows = rows.withColumns({"enter": F.col("_hit.enter"), "exit": F.col("_hit.exit")}).drop("_hit")
    if test is not None:
        rows = rows.where(test)
    return rows if user_distance is None else rows.withColumn("_user", user_distance).where(F.col("_user").isNotNull())


def ray_all(df: DataFrame, spec: GeometrySpec, ray: Ray, max_distance: float = 0.0, tolerance: float = BASE_TOLERANCE, increment: float = 0.0, test: Column | None = None, user_distance: Column | None = None) -> DataFrame:
    """All rows that the ray hits, nearest first, with enter and exit. A max_distance of 0 is none; a direction not of unit length hits nothing."""
    rows = _hits(df, spec, ray, tolerance, increment, test, user_distance)
    rows = rows if not max_distance else rows.where(F.col("enter") <= max_distance)
    return rows.orderBy("enter") if user_distance is None else rows.withColumn("enter", F.col("_user")).drop("_user").orderBy("enter")


def ray_first(df: DataFrame, spec: GeometrySpec, ray: Ray, max_distance: float = 0.0, tolerance: float = BASE_TOLERANCE, increment: float = 0.0, test: Column | None = None, user_distance: Column | None = None) -> DataFrame:
    """All rows that the ray may hit first: entered before the nearest exit, widened by the tolerances; farthest first."""
    rows = _hits(df, spec, ray, tolerance, increment, test, user_distance)
    if user_distance is not None:
        rows = rows.withColumns({"enter": F.col("_user"), "exit": F.col("_user")}).drop("_user")
    rows = rows if not max_distance else rows.where(F.col("enter") <= max_distance)
    bound = rows.agg((F.min("exit") * (1.0 + increment) + max(tolerance, 0.0 if tolerance else EPSILON)).alias("_bound"))
    return rows.crossJoin(F.broadcast(bound)).where(F.col("enter") <= F.col("_bound")).drop("_bound").orderBy(F.desc("enter"))


def _sizes_along(stats: Stats, runs: Sequence[float], wide: float, rows_per_cell: float = 4.0) -> list[float]:
    """Cell sizes, powers of two, for rays that run so far in each dimension on average: a few rows to a cell, if they were evenly spread, and about as many cells along a ray in every dimension; no smaller than a typical row or than what a ray may miss one by."""
    spread = [b - a for a, b in zip(stats.lo, stats.hi, strict=True)]
    runs = [max(r, max(runs) * 1e-3) for r in runs]
    live = [d for d, s in enumerate(spread) if s > 0 and runs[d] > 0]
    share = (rows_per_cell / max(1, stats.rows) * math.prod(spread[d] / runs[d] for d in live)) ** (1 / (len(live) or 1))
    return _powers([max(min(r * share, s), m, wide, abs(h) * 1e-9, 1e-12) for r, s, m, h in zip(runs, spread, stats.mean, stats.hi, strict=True)])


def batch_rays(rays: DataFrame, df: DataFrame, spec: GeometrySpec, dims: int, first: bool = False, tolerance: float = BASE_TOLERANCE, increment: float = 0.0, key: str = "qid") -> DataFrame:
    """Many rays (key, o0.., d0.., optional max_dist) against a table: key, r_ keys, enter and exit.

    Equal rays are looked up once, and their keys joined to what was found. Rows
    are in the cells of their own level. For each level that occurs, a ray is
    cut, where it crosses the domain, into pieces no longer than a cell, which
    meet the rows of that level by cell; so the work goes with the cells along the
    ray. A pair counts in the piece in which the ray enters the row, and in one
    cell. No ray meets all rows, and no pair is tested anew. The joins are merges:
    Spark's estimates don't know of the pieces, and would send them to every task
    by way of the driver.
    """
    stats = stats_of(df, spec.box())
    reach = math.sqrt(sum((b - a) ** 2 for a, b in zip(stats.lo, stats.hi, strict=True)))
    ray = Ray([F.col(f"o{d}") for d in range(dims)], [F.col(f"d{d}") for d in range(dims)])
    wide = tolerance + increment * reach
    whole = Box([a - wide for a in stats.lo], [b + wide for b in stats.hi])
    span = g.ray_hits_box(ray, whole, max(tolerance, 1e-9 * (reach or 1.0)), increment)
    limited = "max_dist" in rays.columns
    limit = [F.coalesce("max_dist", F.lit(math.inf)).alias("max_dist")] if limited else []
    asked = rays.select(key, *ray.origin, *ray.direction, *limit)
    shape = [c for c in asked.columns if c != key]
    near = asked.select(*shape).distinct().withColumn("_span", span)
    near = near.where(F.col("_span").isNotNull() & g.normalized(ray.direction))
    stop = F.least(F.col("_span.exit"), F.col("max_dist")) if limited else F.col("_span.exit")
    near = near.withColumns({"_from": F.col("_span.enter"), "_to": stop, "_end": F.col("_span.exit")}).where("_from <= _to").drop("_span")

    def bounds(a: Column, z: Column) -> Box:
        """Of what lies between two distances; what a ray may miss a row by grows up to where it leaves the row, which is within the domain."""
        slack = F.greatest(F.lit(0.0), F.col("_end")) * increment + tolerance + (F.abs(z) + 1.0) * 1e-9
        ends = [(o + v * a, o + v * z) for o, v in zip(ray.origin, ray.direction, strict=True)]
        return Box([F.least(p, q) - slack for p, q in ends], [F.greatest(p, q) + slack for p, q in ends])

    all_of = bounds(F.col("_from"), F.col("_to"))
    run = [F.avg(F.abs(v) * (F.col("_to") - F.col("_from"))).alias(f"r{d}") for d, v in enumerate(ray.direction)]
    seen = near.agg(*run, *(F.min(x).alias(f"a{d}") for d, x in enumerate(all_of.lo)), *(F.max(x).alias(f"z{d}") for d, x in enumerate(all_of.hi))).first()
    none = seen["r0"] is None
    sizes = _sizes_along(stats, [0.0 if none else seen[f"r{d}"] for d in range(dims)], wide)
    near = near.withColumn("level", F.explode(F.array(*(F.lit(x) for x in stats.levels(sizes)))))
    cells = g._largest([F.abs(d) * (F.col("_to") - F.col("_from")) / F.lit(s) for d, s in zip(ray.direction, sizes, strict=True)]) / F.pow(F.lit(2.0), F.col("level"))
    near = near.withColumn("_pieces", F.greatest(F.lit(1), F.least(F.lit(MOST_PIECES), F.ceil(cells).cast("int"))))
    near = near.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
    near = near.withColumn("_step", (F.col("_to") - F.col("_from")) / F.col("_pieces"))
    own = bounds(F.col("_from") + F.col("_step") * F.col("_piece"), F.col("_from") + F.col("_step") * (F.col("_piece") + 1))
    near = near.withColumns({f"l_{side}{d}": x for side, bound in (("min", own.lo), ("max", own.hi)) for d, x in enumerate(bound)})
    pieces = Box([F.col(f"l_min{d}") for d in range(dims)], [F.col(f"l_max{d}") for d in range(dims)])
    right, box = _sided(df, spec, "r", 0.0)
    # Rows beyond all rays take no part.
    right = right.where(F.lit(False) if none else g.both([(x <= seen[f"z{d}"]) & (y >= seen[f"a{d}"]) for d, (x, y) in enumerate(zip(box.lo, box.hi, strict=True))]))
    right = right.withColumn("level", _level(box, sizes))
    met = _covered(near, pieces, sizes, F.col("level")).hint("merge").join(_covered(right, box, sizes, F.col("level")), ["level", *(f"c{d}" for d in range(dims))])
    # Most pairs of a cell don't touch; that is found out before a hit is computed.
    touch = g.both([(x <= w) & (y <= v) for x, v, y, w in zip(pieces.lo, pieces.hi, box.lo, box.hi, strict=True)])
    met = met.where(touch & _in_own_cell(pieces, box, sizes, F.col("level")))
    hit = g.ray_hits_point(ray, box.lo, tolerance, increment) if spec.kind == "point" else g.ray_hits_box(ray, box, tolerance, increment)
    hits = met.withColumn("_hit", hit).where(F.col("_hit").isNotNull())
    piece = F.when(F.col("_step") > 0, F.floor((F.col("_hit.enter") - F.col("_from")) / F.col("_step"))).otherwise(0)
    hits = hits.where(F.greatest(F.lit(0), F.least(F.col("_pieces") - 1, piece)) == F.col("_piece"))
    names = [f"r_{k}" for k in spec.key]
    hits = hits.select(*shape, *names, F.col("_hit.enter").alias("enter"), F.col("_hit.exit").alias("exit"))
    if limited:
        hits = hits.where(F.col("enter") <= F.col("max_dist"))

    def entered_first(rows: DataFrame, of: Sequence[str]) -> DataFrame:
        bound = F.min("exit").over(Window.partitionBy(*of)) * (1.0 + increment) + max(tolerance, 0.0 if tolerance else EPSILON)
        return rows.withColumn("_bound", bound).where(F.col("enter") <= F.col("_bound")).drop("_bound")

    if first:
        hits = entered_first(hits, shape)
    hits = asked.hint("merge").join(hits, shape).select(key, *names, "enter", "exit")
    # Rays of one key have one bound.
    return entered_first(hits, [key]) if first else hits


def ray(origin: Sequence[float], direction: Sequence[float]) -> Ray:
    """A ray with its direction brought to unit length."""
    n = math.sqrt(sum(x * x for x in direction))
    return Ray(list(origin), [x / n for x in direction])
