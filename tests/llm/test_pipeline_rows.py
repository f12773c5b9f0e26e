"""The pipeline's stages on repeated rows, equal ids, rows without id and clashing columns, and each stage against brute force."""

import random

import corpus_pipeline
from helpers_llm import documents

from gridlark.llm.jaccard import without_near_copies

SF = "/root/testdata/sf0.001"


def prose(rng, n):
    return [rng.choice("abcdefghij") + "".join(rng.choice("klmnopqr") for _ in range(rng.randrange(2, 7))) for _ in range(n)]


def shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def one_of_each_class(rows, num=4, den=5):
    """(id, text) rows that stay: of each class that with the least id, null last."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    found = {}
    for i, (key, _) in enumerate(rows):
        name = top(i) if sets[i] else ("alone", i)
        rank = (key is None, key or 0)
        if name not in found or rank < found[name][0]:
            found[name] = (rank, i)
    return sorted(i for _, i in found.values())


def odd_rows():
    rng = random.Random(31)
    base, other, third = prose(rng, 120), prose(rng, 120), prose(rng, 90)
    near = [*base[:60], "changed", *base[61:]]
    text = " ".join
    return [
        (1, text(base)), (1, text(base)), (7, text(near)), (7, text(other)), (None, text([*base[:20], "else", *base[21:]])), (2, text(third)), (None, text(prose(rng, 40))), (None, None), (3, None), (4, ""), (4, " \n"),
        (None, text([*third, "more"])), (8, "two words"), (9, "two words"), (5, text(prose(rng, 30_000))),
    ]


def test_near_copies_go_row_by_row(spark):
    rows = odd_rows()
    found = corpus_pipeline.near_duplicates(spark, documents(spark, rows), SF)
    kept = sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=repr)
    expected = sorted((rows[i] for i in one_of_each_class(rows)), key=repr)
    assert kept == expected and kept.count(rows[0]) == 1 and rows[3] in kept and (9, "two words") not in kept


def test_near_copies_in_real_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = sorted(r["doc_id"] for r in without_near_copies(docs).collect())
    assert kept == sorted(rows[i][0] for i in one_of_each_class(rows))


def test_every_stage_keeps_documents_that_share_ids(spark):
    rows = odd_rows()
    docs = documents(spark, rows, extra=True)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toArrow())
    kept = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert (1, rows[0][1]) in kept and rows[3] in kept and rows[5] in kept and rows[6] in kept and (3, None) in kept and (5, rows[14][1]) in kept
    assert corpus_pipeline.tokens(spark, docs, SF).count() == len(kept)


def test_items_are_found_in_rows_without_id(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rng = random.Random(5)
    clean = " ".join(prose(rng, 50))
    rows = [(None, f"{clean} {item}"), (None, clean), (3, f"before it {item}"), (3, clean), (4, None), (5, "")]
    found = [(r["doc_id"], r["text"]) for r in corpus_pipeline.decontamination(spark, documents(spark, rows, extra=True), SF).collect()]
    assert sorted(found, key=repr) == sorted([rows[1], rows[3], rows[4], rows[5]], key=repr)


def test_characters_of_the_input_stay(spark):
    rng = random.Random(8)
    shared = " ".join(prose(rng, 80))
    rows = [(1, f"odd � mark {shared} end é"), (2, f"other {shared}")]
    found = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, documents(spark, rows), SF).collect()}
    assert found[1].startswith("odd � mark ") and found[1].rstrip().endswith("end é")
