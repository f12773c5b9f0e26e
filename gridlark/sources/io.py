"""Saving and loading spatial tables, and reading clouds of points from text."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions.morton import Grid, loose_key, point_key
from gridlark.sources.spec import GeometrySpec

VERSION = 2


def save(df: DataFrame, spec: GeometrySpec, path: str, grid: Grid | None = None, order: bool = True, mode: str = "errorifexists") -> None:
    """Parquet files, and what is needed to read them again beside them.

    With a grid, rows get their tree key and are sorted by it: then the row
    groups' least and greatest coordinates let a filter skip most of them.
    """
    if grid is not None:
        df = df.withColumn("node_key", point_key(spec.point(), grid) if spec.kind == "point" else loose_key(spec.box(), grid))
        if order:
            df = df.repartitionByRange("node_key").sortWithinPartitions("node_key")
    df.write.mode(mode).parquet(f"{path}/data")
    meta = {"version": VERSION, "spec": asdict(spec), "grid": None if grid is None else {"lo": list(grid.lo), "hi": list(grid.hi), "depth": grid.depth, "outside": grid.outside}}
    df.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode(mode).parquet(f"{path}/_meta_table")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, GeometrySpec, Grid | None]:
    """What save() has written; a file of a newer version isn't read."""
    meta = json.loads(spark.read.parquet(f"{path}/_meta_table").first()["meta"])
    if meta["version"] > VERSION:
        raise ValueError(f"version {meta['version']} is newer than {VERSION}")
    spec = meta["spec"]
    spec["key"], spec["lo"], spec["hi"] = tuple(spec["key"]), tuple(spec["lo"]), tuple(spec["hi"])
    grid = meta["grid"]
    return spark.read.parquet(f"{path}/data"), GeometrySpec(**spec), Grid(**grid) if grid else None


def save_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, for other programs."""
    df.write.mode(mode).json(path)


def read_text_cloud(spark: SparkSession, path: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """Numbers from lines of text: a group of the pattern per name; lines that don't match are left out."""
    number: list[Column] = [F.regexp_extract("value", pattern, i + 1).cast("double").alias(n) for i, n in enumerate(names)]
    return spark.read.text(path).where(F.col("value").rlike(pattern)).select(*number)
