"""Spatial tables made of the driver's tables: the same select list for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlark.sources.spec import GeometrySpec, boxes, points

#: name: (table, select list)
SELECTS = {
    "order_boxes": ("orders", ["o_orderkey as id", "o_totalprice / 1000 as min0", "o_totalprice / 1000 + cast(o_custkey % 7 as double) as max0", "cast(o_custkey as double) as min1", "cast(o_custkey + o_orderkey % 5 as double) as max1"]),
    "order_points": ("orders", ["o_orderkey as id", "o_totalprice as p0", "cast(o_custkey as double) as p1"]),
    "part_boxes": ("part", ["p_partkey as id", "p_retailprice / 4 as min0", "p_retailprice / 4 + cast(p_size % 11 as double) as max0", "cast(p_partkey % 1500 as double) as min1", "cast(p_partkey % 1500 + 3 as double) as max1"]),
    "part_points": ("part", ["p_partkey as id", "cast(p_size as double) as p0", "p_retailprice as p1"]),
    "line_boxes": ("lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice / 1000 as min0", "l_extendedprice / 1000 + l_quantity as max0", "l_discount * 100 as min1", "l_discount * 100 + l_tax * 100 as max1"]),
    "event_points": ("events", ["event_id as id", "value as p0", "cast(user_id as double) as p1"]),
    "customer_points": ("customer", ["c_custkey as id", "c_acctbal as p0", "cast(c_custkey as double) as p1"]),
    "supplier_points": ("supplier", ["s_suppkey as id", "s_acctbal as p0", "cast(s_suppkey * 15 as double) as p1"]),
    "nation_boxes": ("nation", ["cast(n_nationkey as bigint) as id", "cast(n_nationkey * 400 as double) as min0", "cast(n_nationkey * 400 + 700 as double) as max0", "cast(n_regionkey * 100 as double) as min1", "cast(n_regionkey * 100 + 400 as double) as max1"]),
    "vectors3": ("embeddings", ["vec_id as id", "cast(embedding[{0}] as double) as p0", "cast(embedding[{1}] as double) as p1", "cast(embedding[{2}] as double) as p2"]),
}
POINTS2, BOXES2, POINTS3 = points(2), boxes(2), points(3)
LINES = GeometrySpec("box", ["min0", "min1"], ["max0", "max1"], key=("l_orderkey", "l_linenumber"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = SELECTS[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*(c.format(0, 1, 2) for c in columns))


def sql(name: str) -> str:
    """The same table for DuckDB, whose arrays begin at 1."""
    source, columns = SELECTS[name]
    return f"(select {', '.join(c.format(1, 2, 3) for c in columns)} from {source})"
