"""Edits of a spatial table that come as a stream.

Each micro-batch has rows with `seq`, `op` (add, update or erase) and the table's
columns. Only the last edit of a key in a batch counts. The table is kept in a
folder that all executors share, as a whole version (v=<number>) and what later
batches changed (d=<number>): a batch reads the keys of the table and writes only
its own changes. Every few batches these are merged into a new whole version, and
what is older than the version before it is removed. All are named by the batch's
number, so that a batch that is run again writes the same again; a folder counts
once its writer has finished it, so readers always see whole ones.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridlark.operators.table import SpatialTable
from gridlark.sources.spec import GeometrySpec

COMPACT_EVERY = 16


def last_edits(batch: DataFrame, spec: GeometrySpec) -> DataFrame:
    """Of each key the edit with the greatest seq."""
    others = [c for c in batch.columns if c not in spec.key]
    best = batch.groupBy(*spec.key).agg(F.max_by(F.struct(*others), F.col("seq")).alias("_e"))
    return best.select(*spec.key, *(F.col(f"_e.{c}").alias(c) for c in others))


def apply_edits(table: SpatialTable, batch: DataFrame) -> SpatialTable:
    """The table after a batch: adds of known keys and updates of unknown ones are ignored, as are erases of missing ones."""
    edits = last_edits(batch, table.spec)
    columns = table.rows.columns
    table, _ = table.erase(edits.where("op = 'erase'").select(*table.spec.key))
    table, _ = table.update(edits.where("op = 'update'").select(*columns))
    table, _ = table.add(edits.where("op = 'add'").select(*columns))
    return table


def _store(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path


def _written(spark: SparkSession, folder: str) -> dict[str, list[int]]:
    """Numbers of the finished versions (v) and changes (d)."""
    path, store, make = _store(spark, folder)
    out: dict[str, list[int]] = {"v": [], "d": []}
    for status in store.listStatus(path):
        if (m := re.fullmatch(r"([vd])=(-?\d+)", status.getPath().getName())) and store.exists(make(status.getPath(), "_SUCCESS")):
            out[m[1]].append(int(m[2]))
    return {k: sorted(v) for k, v in out.items()}


def current(spark: SparkSession, folder: str, spec: GeometrySpec, before: int | None = None) -> DataFrame:
    """The table as it is now, or as it was before a batch: the last whole version and the last change of each key since."""
    found = _written(spark, folder)
    version = max(v for v in found["v"] if before is None or v < before)
    base = spark.read.parquet(f"{folder}/v={version}")
    changes = None
    for n in found["d"]:
        if n > version and (before is None or n < before):
            more = spark.read.parquet(f"{folder}/d={n}").withColumn("_batch", F.lit(n))
            changes = more if changes is None else changes.unionByName(more)
    if changes is None:
        return base
    key = list(spec.key)
    others = [c for c in changes.columns if c not in (*key, "_batch")]
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*others), F.col("_batch")).alias("_e"))
    put = last.where("not _e._gone").select(*key, *(F.col(f"_e.{c}").alias(c) for c in others if c != "_gone"))
    return base.join(last.select(*key), key, "left_anti").unionByName(put.select(*base.columns))


def start(spark: SparkSession, edits: DataFrame, spec: GeometrySpec, folder: str, checkpoint: str, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Run the edits of a streaming DataFrame on the table kept in the folder; version -1 is the first one. current() reads it."""
    key = list(spec.key)

    def one(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = current(session, folder, spec, number)
        known = before.select(*key).withColumn("_known", F.lit(True))
        marked = last_edits(batch, spec).join(known, key, "left")
        there = F.col("_known").isNotNull()
        counts = F.when(F.col("op") == "add", ~there).otherwise(there)
        changed = marked.where(counts).withColumn("_gone", F.col("op") == "erase").select(*before.columns, "_gone")
        changed.write.mode("overwrite").parquet(f"{folder}/d={number}")
        if (number + 1) % compact_every == 0:
            current(session, folder, spec, number + 1).write.mode("overwrite").parquet(f"{folder}/v={number}")
            _, store, make = _store(session, folder)
            found = _written(session, folder)
            # The version before stays, for readers that have begun and for a batch that is run again.
            keep = found["v"][-2] if len(found["v"]) > 1 else found["v"][-1]
            for kind, numbers in found.items():
                for n in numbers:
                    if n < keep or (kind == "d" and n == keep):
                        store.delete(make(f"{folder}/{kind}={n}"), True)

    return edits.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
