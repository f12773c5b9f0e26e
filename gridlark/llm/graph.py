"""Connected components of a graph that is never collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import drop_staged, staged, tidy


def _mark(edges: DataFrame) -> tuple:
    """Number and checksum: equal if no edge has changed."""
    with tidy(edges.sparkSession):
        return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the least node it reaches) of every node that an edge names.

    Alternating large-star and small-star steps; each round is written to the
    shared folder, so that a lost executor costs one round at most. Hubs are
    reduced before they are shuffled, and the joins can be split by Spark.
    """
    e = staged(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = _mark(e)
    while before[0]:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        own = least.select("u", F.col("m").alias("v"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = staged(own.unionAll(small).distinct(), "edges")
        mark = _mark(after)
        drop_staged(e)
        e = after
        if before == mark:
            break
        before = mark
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
