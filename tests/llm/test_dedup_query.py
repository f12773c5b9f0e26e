"""The registered query of repeated passages: 400 bytes decide, not words; the columns of every row against brute force."""

import hashlib
import random

import duckdb
import pytest
from helpers_llm import documents
from test_text_operators import repeated_by_force

from gridlark.llm import registry


def shared(rng, words, size):
    """So many words in exactly so many bytes."""
    lengths = [1] * words
    for _ in range(size - 2 * words + 1):
        lengths[rng.randrange(words)] += 1
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(n)) for n in lengths)


@pytest.mark.parametrize("words", [51, 63, 90])
def test_passages_go_by_bytes(spark, tmp_path, words):
    rng = random.Random(words)
    texts = []
    for size in (399, 400, 450):
        passage = shared(rng, words, size)
        # A different letter on each side, so that what is shared is no longer than the passage.
        texts += [f"{shared(rng, 20, 110)}K{passage}L{shared(rng, 9, 50)}", f"{shared(rng, 7, 40)}M{passage}N{shared(rng, 30, 160)}"]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in registry.QUERIES["op5_dedup"](spark, str(tmp_path)).collect()}
    assert [(found[i]["n_bytes"], found[i]["n_removed"], found[i]["n_spans"]) for i in range(6)] == [(len(t), n, n > 0) for t, n in zip(texts, (0, 0, 400, 400, 450, 450), strict=True)]
    assert [found[i]["text"] for i in (0, 1)] == texts[:2]


def test_all_rows_against_brute_force(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet' order by doc_id").fetchall()
    found = {r["doc_id"]: r for r in registry.QUERIES["op5_dedup"](spark, "/root/testdata/sf0.01").collect()}
    expected = repeated_by_force([t for _, t in rows], 400)
    assert len(found) == len(rows)
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in (found[k] for k, _ in rows)] == expected
    for (k, text), (_, removed, _, digest) in zip(rows, expected, strict=True):
        assert removed or found[k]["text"] == text and hashlib.sha256((text or "").encode()).hexdigest() == digest
