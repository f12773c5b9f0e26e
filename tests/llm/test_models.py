"""The learned operators against dense and exact solvers, and the columns of every registered query."""

import random
import zlib

import numpy as np
import pytest
from helpers_llm import documents
from pyspark.sql import functions as F

from gridlark.llm import langid, quality, registry

SF = "/root/testdata/sf0.001"


def newton_svm(x, y, penalty, rounds=100):
    """The squared-hinge SVM by Newton steps on the rows within the margin."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        live = y * (x @ w) < 1
        a = x[live]
        w = np.linalg.solve(np.eye(x.shape[1]) + 2 * penalty * a.T @ a, 2 * penalty * a.T @ y[live])
    return w


def objective(w, x, y, penalty):
    return 0.5 * w @ w + penalty * (np.maximum(0, 1 - y * (x @ w)) ** 2).sum()


@pytest.mark.parametrize("seed", range(4))
def test_svm_is_the_exact_solver_s(seed):
    rng = np.random.default_rng(seed)
    x = np.hstack([rng.normal(size=(120, 6)), np.ones((120, 1))])
    y = np.where(x @ rng.normal(size=7) + 0.4 * rng.normal(size=120) > 0, 1.0, -1.0)
    best = objective(newton_svm(x, y, 1.0), x, y, 1.0)
    # Run to convergence; production stops after EPOCHS rounds.
    assert objective(langid.train_svm(x, y, epochs=300), x, y, 1.0) <= best * 1.001


def test_votes_are_those_of_a_plain_loop():
    rng = np.random.default_rng(1)
    names = ["a", "b", "c", "d"]
    pairs = [(t, a, b) for t, (a, b) in enumerate((a, b) for i, a in enumerate(names) for b in names[i + 1 :])]
    margins = rng.normal(size=(300, len(pairs)))
    best, sure = langid._vote(names, pairs, margins)
    for row, i, p in zip(margins, best, sure, strict=True):
        votes = dict.fromkeys(names, 0.0)
        least = dict.fromkeys(names, 1.0)
        for t, a, b in pairs:
            chance = 1 / (1 + np.exp(-3 * row[t]))
            votes[a] += (row[t] >= 0) + 1e-3 * chance
            votes[b] += (row[t] < 0) + 1e-3 * (1 - chance)
            least[a], least[b] = min(least[a], chance), min(least[b], 1 - chance)
        winner = max(names, key=lambda n: votes[n])
        assert names[i] == winner and abs(p - least[winner]) < 1e-9


def test_languages_of_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    assert langid.identify(docs.where("doc_id < 0"), model).count() == 0
    assert langid.fit(docs.where("doc_id < 0"))["members"] == {}
    again = langid.identify(docs.unionAll(docs), model).groupBy("doc_id").agg(F.count_distinct("lang_pred", "score").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert {(r["n"], r["rows"] % 2) for r in again} == {(1, 0)}


def test_features_are_a_gaussian_kernel():
    rng = np.random.default_rng(3)
    width = len(quality.NAMES)
    directions, phases = quality.fourier_features(width, 8192)
    model = {"mean": np.zeros(width), "scale": np.ones(width), "directions": directions, "phases": phases}
    x = rng.normal(size=(40, width))
    z = quality.expand(x, model)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * width))
    assert np.abs(z @ z.T - kernel).max() < 0.06


def test_scores_are_those_of_a_dense_ridge(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    stats = quality.document_statistics(docs)
    model = quality.fit(stats, labels, features=64)
    rows = {r["doc_id"]: r["stats"] for r in stats.collect()}
    truth = [(r["doc_id"], r["quality"]) for r in labels.collect() if r["quality"] is not None and r["doc_id"] in rows]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    x = np.array([rows[i] for i, _ in truth if fold(i) > 1])
    y = np.array([float(v) for i, v in truth if fold(i) > 1])
    assert np.allclose(model["mean"], x.mean(axis=0)) and np.allclose(model["scale"], np.maximum(x.std(axis=0), 1e-6))
    z = quality.expand(x, model)
    weights = np.linalg.solve(z.T @ z + quality.RIDGE * len(z) * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(model["weights"], weights, atol=1e-6)
    own = np.array([rows[i] for i, _ in truth if fold(i) == 1])
    bins = np.clip((quality.expand(own, model) @ weights - quality.LOW) / (quality.HIGH - quality.LOW) * quality.BINS, 0, quality.BINS - 1).astype(int)
    given = np.array([float(v) for i, v in truth if fold(i) == 1])
    known = sorted(set(bins.tolist()))
    plain = quality.isotonic([given[bins == b].mean() for b in known], [float((bins == b).sum()) for b in known])
    assert np.allclose(model["levels"], plain)


def test_quality_of_repeated_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.score_documents(docs.unionAll(docs), labels).groupBy("doc_id").agg(F.count_distinct("score").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert {(r["n"], r["rows"] % 2) for r in found} == {(1, 0)}


COLUMNS = {
    "op1_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op2_ann": "query_id bigint, rank int, vec_id bigint, score double",
    "op3_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_urlfilter": "page_id bigint, host string, path string, rule string, verdict string",
    "op5_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op6_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op10_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_of_queries(spark, name):
    kinds = dict(registry.QUERIES[name](spark, SF).dtypes)
    expected = dict(c.split() for c in COLUMNS[name].split(", "))
    assert {c: kinds.get(c) for c in expected} == expected


def test_very_long_texts_link(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(10_000)) for _ in range(60_000))
    from gridlark.llm import jaccard, sharding

    found = {r["doc_id"]: r for r in jaccard.classes(documents(spark, [long, long + " end", "short one"]), 4, 85, 100).collect()}
    assert (found[0]["component_id"], found[1]["component_id"], found[2]["component_id"]) == (0, 0, 2) and found[0]["n_shingles"] == 59_997
    assert sharding.shard_documents(documents(spark, [long, long, "x"]), 2).where("size > 100").select("shard").distinct().count() == 1
