"""Query of the WARC operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.warc import archive_pages, read_archives


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of responses are those that the reader has computed; a revisit's are those of its header."""
    files, folder = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    last = read_archives(files, folder, with_data=False).where("is_last")
    response = F.col("record_type") == "response"
    return last.select(
        F.col("record_id").alias("page_id"),
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("header_digest")).alias("payload_digest"),
        "record_type", "refers_to",
    )


QUERIES = {"op1_warc": op1_warc}
ORACLE_SQL = {
    "op1_warc": """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, cast(strlen(html) as bigint) as payload_bytes, sha256(html) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest, payload_bytes) as first_id from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from f"""
}
