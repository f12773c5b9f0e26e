"""Query of the sharding operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.sharding import shard_documents


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law that holds is `bytes`: sizes of shards near equal, with equal texts together."""
    rows = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_sharding": op7_sharding}
ORACLE_SQL: dict[str, str] = {}
