"""The pipeline's stage of repeated passages: over 50 words, however few bytes, against brute force."""

import random
from collections import Counter

import corpus_pipeline
from helpers_llm import documents


def planted():
    rng = random.Random(21)
    prose = lambda n, least=2, most=6: [rng.choice("abcdefghij") + "".join(rng.choice("klmnopqré") for _ in range(rng.randrange(least, most))) for _ in range(n)]
    out = [None, "", "z" * 500 + " one", "z" * 500 + " two"]
    for n in (50, 51, 52, 59, 63, 75):
        shared = prose(n, 1, 5)
        assert len(" ".join(shared).encode()) < 400
        out += [" ".join([*prose(40), *shared, *prose(30)]), "\n".join([*prose(20), *shared, *prose(45)])]
    twice = prose(51, 1, 2)
    return [*out, " ".join([*prose(9), *twice, *prose(9), *twice]), " ".join(prose(300))]


def test_passages_of_over_50_words_go(spark):
    texts = planted()
    words = [(t or "").split() for t in texts]
    counts = Counter(tuple(w[i : i + 51]) for w in words for i in range(len(w) - 50))
    expected = {}
    for i, w in enumerate(words):
        gone = {k for j in range(len(w) - 50) if counts[tuple(w[j : j + 51])] > 1 for k in range(j, j + 51)}
        expected[i] = [x for k, x in enumerate(w) if k not in gone]
    assert sum(len(w) - len(expected[i]) for i, w in enumerate(words)) == 2 * (51 + 52 + 59 + 63 + 75) + 2 * 51
    expected[2], expected[3] = ["one"], ["two"]  # 400 bytes that repeat go too, however few words they are
    found = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, documents(spark, texts), "").collect()}
    assert {i: (t or "").split() for i, t in found.items()} == expected
    assert found[len(texts) - 1] == texts[-1] and found[0] is None
