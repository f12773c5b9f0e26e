"""Query of the n-gram Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlark.llm.jaccard import classes


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, Jaccard similarity of 85 in 100 or more."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, num=85, den=100)


def oracle(words: int = 4, num: int = 85, den: int = 100) -> str:
    blank = "[\\x20\\x09-\\x0D]+"
    return f"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{blank}'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < {words} then [w] else list_transform(generate_series(1, len(w) - {words - 1}), lambda i: w[i : i + {words - 1}]) end) as g from w),
n as (select w.doc_id, count(s.doc_id) as n from (select distinct doc_id from w) w left join s on s.doc_id = w.doc_id group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where {den} * shared >= {num} * (x.n + y.n - shared)),
r as (select doc_id, doc_id as other from n union select r.doc_id, l.b from r join l on l.a = r.other)
select n.doc_id, cast(n.n as bigint) as n_shingles, c.component_id from n join (select doc_id, min(other) as component_id from r group by 1) c using (doc_id)"""


QUERIES = {"op8_jaccard": op8_jaccard}
ORACLE_SQL = {"op8_jaccard": oracle()}
