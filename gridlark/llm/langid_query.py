"""Query of language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlark.llm.langid import fit, identify


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))


QUERIES = {"op3_langid": op3_langid}
ORACLE_SQL: dict[str, str] = {}
