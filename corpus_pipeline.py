"""The corpus pipeline: stages that each take a documents table and return what they keep of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridlark.llm.bpe import encode_texts
from gridlark.llm.bpe_query import vocabulary_path
from gridlark.llm.common import scratch, staged
from gridlark.llm.decontam import without_items
from gridlark.llm.dedup import clean_documents
from gridlark.llm.jaccard import without_near_copies
from gridlark.llm.quality import keep_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Each row is judged by its own text: repeated rows alike, rows with equal ids
    each, rows without id or text too (a null text is an empty one). Labels that
    aren't there are no labels; without any, all rows stay. No rows give none.
    """
    return keep_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five words, 0.8) one row, that with the least id.

    Rows are dropped one by one and not by id: of wholly repeated rows one stays,
    rows that share an id with a near copy stay, and rows without id may go. Rows
    without words all stay. No rows give none.
    """
    return without_near_copies(docs, words=5, num=4, den=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words, and the 400-byte strings, that start anywhere else too.

    Rows that lose all their text go; null and empty texts stay. Ids play no part;
    texts that are wholly equal lose all, as the stage before left one of each.
    """
    return clean_documents(docs, least=400, words=51)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark.

    Each row is judged by its own text, whatever its id, so that only rows that hold
    an item go; null and empty texts stay. No items, or no rows, are no reason to fail.
    """
    return without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and digests of what is left, a row for each row; null and empty texts have no tokens."""
    return encode_texts(docs, vocabulary_path(), with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("tokens", tokens),
]
#: The quality scores and the ids of the tokenizer can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over what its predecessor kept; between two stages the table is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scratch(spark):  # what a stage has staged goes when its result is written
            docs = staged(stage(spark, docs, sf_dir), name, keep=True)
    return docs
