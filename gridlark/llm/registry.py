"""All queries of the training-data operators, with the SQL that checks them."""

from __future__ import annotations

from gridlark.llm import ann_query, bpe_query, decontam_query, dedup_query, jaccard_query, langid_query, quality_query, sharding_query, urlfilter_query, warc_query

_MODULES = [warc_query, ann_query, langid_query, urlfilter_query, dedup_query, quality_query, sharding_query, jaccard_query, decontam_query, bpe_query]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
