"""Query of the BPE operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlark.llm.bpe import encode_texts


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_texts(docs, vocabulary_path(), with_ids=False)


QUERIES = {"op10_bpe": op10_bpe}
ORACLE_SQL: dict[str, str] = {}
