"""Query of the removal of repeated passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlark.llm.dedup import deduplicate


def op5_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests, and in `text` what is left of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deduplicate(docs, least=400).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")


QUERIES = {"op5_dedup": op5_dedup}
ORACLE_SQL: dict[str, str] = {}
