"""WARC, neighbours, languages, URLs, quality, shards, components and the pipeline."""

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from helpers_llm import documents
from pyspark.sql import functions as F

from gridlark.llm import ann, graph, langid, quality, registry, sharding, urlfilter, warc
from gridlark.llm.common import new_path

SF = "/root/testdata/sf0.001"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_come_back_chunk_by_chunk(spark):
    rng = random.Random(1)
    body = lambda n: "".join(rng.choice("abcdé\r\n") for _ in range(n))
    rows = [(0, "http://a/", body(100_000)), (1, None, None), (2, "http://b\r\nX: y", ""), (3, "u", "short"), (4, "u", "short"), (None, "u", body(300)), (9, "u", "z" * 100), (5, "u", "z" * 100), (7, "u", "z" * 100), (8, "u", "z" * 99), (6, "u", "z" * 99)]
    records = warc.with_record_types(pages(spark, rows), "page_id", "url", "html")
    folder = new_path(spark, "warc-test")
    files = warc.write_archives(warc.chunked(records, 1000), folder, archive_bytes=5000)
    found = warc.read_archives(files, folder, 700).collect()
    payloads: dict = defaultdict(list)
    for r in sorted(found, key=lambda r: r["chunk_no"]):
        payloads[r["record_id"]].append(r)
    by_id = {i: (html or "").encode() for i, _, html in rows}
    for i, chunks in payloads.items():
        whole = b"".join(bytes(r["chunk"]) for r in chunks)
        last = chunks[-1]
        assert last["is_last"] and all(len(r["chunk"]) <= 700 for r in chunks)
        assert last["digest_so_far"] == hashlib.sha256(whole).hexdigest()
        if last["record_type"] == "response":
            assert whole == by_id[i] and last["header_digest"] == last["digest_so_far"]
        else:
            assert whole == b"" and last["header_digest"] == hashlib.sha256(by_id[i]).hexdigest()
    assert {i: c[-1]["refers_to"] for i, c in payloads.items() if c[-1]["record_type"] == "revisit"} == {9: 5, 7: 5}
    assert sum(r["records"] for r in files.collect()) == len(rows) and files.count() > 1


def test_archives_are_gzip_members(spark, tmp_path):
    files, folder = warc.archive_pages(pages(spark, [(1, "http://a/", "hello")]), folder=f"file://{tmp_path}/w")
    raw = (tmp_path / "w" / files.first()["file"]).read_bytes()
    record = zlib.decompress(raw, 31)
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and record.endswith(b"\r\n\r\nhello\r\n\r\n")


def test_no_pages_no_archives(spark):
    files, folder = warc.archive_pages(pages(spark, [(1, "u", "x")]).where("page_id < 0"))
    assert warc.read_archives(files, folder).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_neighbours_have_high_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 700)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 30)
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(2000, 24)) * rng.uniform(0.2, 3, size=(2000, 1))).astype(np.float32)
    x[100:160] = x[100]
    got = defaultdict(list)
    for r in ann.nearest(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    exact, recall = x.astype(float), []
    for q in range(0, 2000, 20):
        score = (exact * exact[q]).sum(1)
        score[q] = -np.inf
        right = np.lexsort((np.arange(2000), -score))[:20]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(s - score[i]) < 1e-9 for _, i, s in found)
        assert [i for _, i, _ in found] == sorted((i for _, i, _ in found), key=lambda i: (-score[i], i))
        recall.append(len({i for _, i, _ in found} & set(right.tolist())) / 20)
    assert np.mean(recall) >= 0.9


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [0.5, 0.5]), (9, [0.5, 0.5])]
    df = vectors(spark, rows).withColumn("rank", F.lit("clash"))
    found = [tuple(r)[:4] for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect()]
    assert found == [(0, 1, 8, 0.5), (0, 2, 9, 0.5)]
    twice = df.unionAll(df).unionAll(vectors(spark, [(0, [0.0, 1.0]), (9, [0.0, 3.0])]).withColumn("rank", F.lit("")))
    lists = defaultdict(list)
    for r in sorted(ann.nearest(twice, F.col("vec_id") % 20 == 0).collect(), key=lambda r: r["rank"]):
        lists[r["query_row"]].append((r["query_id"], r["rank"], r["vec_id"], r["score"]))
    assert sorted(lists.values()) == [[(0, 1, 8, 0.5), (0, 2, 9, 0.5), (0, 3, 9, 0.0)], [(0, 1, 9, 3.0), (0, 2, 8, 0.5), (0, 3, 9, 0.5)]]
    assert ann.nearest(df.where("vec_id < 0"), F.lit(True)).count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_recall_on_embeddings(spark, sf):
    path = f"/root/testdata/sf{sf}"
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect())
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    query = registry.QUERIES["op2_ann"](spark, path)
    assert query.dtypes[:4] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got = defaultdict(set)
    for r in query.collect():
        got[r["query_id"]].add(r["vec_id"])
    recall = []
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        right = ids[np.lexsort((ids, -score))[:20]]
        recall.append(len(got[ids[q]] & set(right.tolist())) / len(right))
    assert len(got) == len(recall) and np.mean(recall) >= 0.93


def test_few_rows_are_verified():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(8192, 64)) + 0.7 * rng.normal(size=(40, 64))[rng.integers(0, 40, 8192)]
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids, verified, recall = np.arange(8192), [], []
    for q, found, _ in ann.search_block(ids, x, ids[::100], x[::100], 20, 1.0, verified=verified):
        score = x @ x[100 * q]
        score[100 * q] = -np.inf
        recall.append(len(set(found.tolist()) & set(np.argsort(-score)[:20].tolist())) / 20)
    assert np.mean(verified) < 0.07 * 8192 and np.mean(recall) >= 0.9


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    found = langid.identify(docs.drop("lang", "source"), langid.fit(docs)).collect()
    assert len(found) == len(truth) and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in found if r["held_out"]]
    assert sum(right) / len(right) > 0.97


def test_languages_of_odd_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    long = "the whole thing and then the other one " * 100_000
    odd = {r["doc_id"]: r for r in langid.identify(documents(spark, [None, "", "123 !?", "a", long, "the the"], extra=True), model).collect()}
    assert [odd[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and odd[0]["score"] == 0
    assert odd[3]["lang_pred"] in {"en", "de", "fr", "es"} and odd[4]["lang_pred"] == "en"
    empty = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.identify(docs, empty).collect()} == {"und"}


def test_averages_don_t_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(32, 127, 5000).astype(np.uint8)
    offsets = np.array([0, 1, 1, 4, 2500, 2502, 5000])
    weights = rng.normal(size=(langid.WIDTH, 3))
    whole = langid.averages(data, offsets, weights)
    monkeypatch.setattr(langid, "SLICE", 97)
    assert np.allclose(langid.averages(data, offsets, weights), whole)


RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def test_rules(spark):
    urls = [
        ("http://a.net/x", "a.net", "/x", "net/"), ("HTTPS://WWW.Example.NET/en/1?q#f", "www.example.net", "/en/1", "example.net/en/"), ("http://example.net/english", "example.net", "/english", "net/"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None), ("http://b.example.com/de/#x", "b.example.com", "/de/", "example.com/de/"), ("x://a.org/fr/z", "a.org", "/fr/z", "org/fr/"),
        ("http://net", "net", "", None), ("no scheme", "", "", None), (None, "", "", None), ("", "", "", None), ("http://a.net?x/y", "a.net", "", None), ("http://É.NET/://q", "É.net", "/://q", "net/"),
    ]
    df = pages(spark, [(i, u[0], "") for i, u in enumerate(urls)]).withColumn("score", F.lit("clash"))
    found = sorted(urlfilter.judge(df, RULES).collect(), key=lambda r: r["page_id"])
    assert [(r["host"], r["path"], r["rule"]) for r in found] == [u[1:] for u in urls]
    assert all(r["verdict"] == RULES[r["rule"]] for r in found if r["rule"])
    assert all(r["verdict"] in ("allow", "block") for r in found)
    assert urlfilter.judge(df.where("page_id < 0"), RULES).count() == 0
    nothing = urlfilter.judge(df, {"example.invalid/": "block"}).collect()
    assert {r["verdict"] for r in nothing} == {"allow"}


def test_the_model_tells_paths_apart(spark):
    rng = random.Random(2)
    rows = [f"http://good.org/fr/{rng.choice(['histoire', 'nature', 'musique'])}{rng.randrange(99)}" for _ in range(80)]
    rows += [f"http://bad.net/{rng.choice(['casino', 'pills', 'bonus'])}{rng.randrange(99)}" for _ in range(80)]
    rows += ["http://q.com/musique7", "http://q.com/casino-bonus7"]
    found = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages(spark, [(i, u, "") for i, u in enumerate(rows)]), RULES).collect()}
    assert (found[160], found[161]) == ("allow", "block")


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    scored = {r["doc_id"]: r for r in quality.score_documents(docs, labels).collect()}
    right = [r["predicted"] == truth[i] for i, r in scored.items() if r["held_out"] and i in truth]
    assert sum(right) / len(right) > 0.9 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in scored.values())
    kept = {r["doc_id"] for r in quality.keep_documents(docs, labels).collect()}
    assert kept == {i for i, r in scored.items() if r["predicted"]}


def test_quality_of_odd_texts(spark):
    docs = documents(spark, [None, "", "x" * 100_000, "plain words", "plain words"], extra=True)
    labels = spark.createDataFrame([(i, q, 0) for i, q in [(1, 1), (2, 0), (3, None), (3, 1)]], "doc_id long, quality int, toxic int")
    assert quality.score_documents(docs, labels).count() == 5
    assert {r["score"] for r in quality.score_documents(docs, labels.where("doc_id < 0")).collect()} == {0.5}
    assert quality.score_documents(docs.where("doc_id < 0"), labels).count() == 0


def test_isotonic_is_the_least_squares_fit():
    assert quality.isotonic([0.0, 1.0, 0.0, 1.0], [1, 1, 1, 1]) == [0.0, 0.5, 0.5, 1.0]
    assert quality.isotonic([3.0, 2.0, 1.0], [1, 1, 2]) == [1.75, 1.75, 1.75]


def test_normal_equations_are_summed_over_partitions(spark):
    rng = np.random.default_rng(5)
    stats, y = rng.normal(size=(300, len(quality.NAMES))).astype(np.float32), rng.integers(0, 2, 300)
    directions, phases = quality.fourier_features(len(quality.NAMES), 16)
    model = {"mean": np.zeros(len(quality.NAMES)), "scale": np.ones(len(quality.NAMES)), "directions": directions, "phases": phases}
    rows = spark.createDataFrame([(s.tolist(), float(v)) for s, v in zip(stats, y, strict=True)], "stats array<float>, label double").repartition(7)
    z = quality.expand(stats.astype(float), model)
    assert np.allclose(quality.normal_equations(rows, model), z.T @ np.hstack([z, y[:, None]]))


def test_shards_are_near_equal_and_keep_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = sharding.shard_documents(docs, 16).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    loads, slots, of_text = Counter(), defaultdict(list), defaultdict(set)
    for r in found:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        of_text[texts[r["doc_id"]]].add(r["shard"])
    assert max(loads.values()) < 1.01 * min(loads.values()) and len(loads) == 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of_text.values())


def by_heap(sizes, shards):
    """The plain way: group by group, in this order, to the least-loaded shard."""
    heap, out = [(0, s) for s in range(shards)], []
    for size in sizes:
        load, s = heapq.heappop(heap)
        out.append(s)
        heapq.heappush(heap, (load + size, s))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_turns_are_the_heap_s(seed):
    rng = random.Random(seed)
    shards = rng.choice([1, 2, 3, 7, 16])
    classes = {rng.choice([1, 2, 3, rng.randrange(1, 50), rng.randrange(1, 5000)]): rng.choice([1, 2, 5, rng.randrange(1, 400)]) for _ in range(rng.randrange(1, 30))}
    plain = by_heap([s for s in sorted(classes, reverse=True) for _ in range(classes[s])], shards)
    turns, found = sharding.longest_processing_time(list(classes.items()), shards), []
    for size in sorted(classes, reverse=True):
        for i in range(classes[size]):
            first, order = max((t for t in turns[size] if t[0] <= i), key=lambda t: t[0])
            found.append(order[(i - first) % len(order)])
    assert found == plain


def test_placement_is_a_heap_s_over_all_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sizes = Counter()
    for _, t in rows:
        sizes[hashlib.sha256(t.encode()).digest()] += len(t.encode()) + 1
    order = sorted(sizes, key=lambda d: (-sizes[d], d))
    where = dict(zip(order, by_heap([sizes[d] for d in order], 16), strict=True))
    query = registry.QUERIES["op7_sharding"](spark, "/root/testdata/sf0.01")
    assert dict(query.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    assert {r["doc_id"]: r["shard"] for r in query.collect()} == {i: where[hashlib.sha256(t.encode()).digest()] for i, t in rows}


def test_shards_of_odd_rows(spark):
    docs = documents(spark, [None, None, "", "a", "a", (9, "b"), (9, "b"), (None, "c"), "long " * 200_000], extra=True)
    found = sharding.shard_documents(docs, 4).collect()
    assert len(found) == 9 and sorted(r["size"] for r in found) == [1, 1, 1, 2, 2, 2, 2, 2, 1_000_001]
    assert len({r["shard"] for r in found if r["doc_id"] in (0, 1)}) == 1
    assert sharding.shard_documents(docs.where("doc_id < 0"), 4).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)] + [(5, 5), (700, 700)]
    up: dict[int, int] = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    found = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {x: top(x) for x in list(up)} and len(found) == len(up)


def test_pipeline_is_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeated_passages", "decontamination", "tokens"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spark.createDataFrame(stage(spark, docs, sf).toArrow())
        assert i == len(names) - 1 or docs.columns == columns
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))
    empty = spark.createDataFrame([], spark.read.parquet(f"{sf}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.sql(registry.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    places = [found.columns.index(c) for c in columns]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, (tuple(r[p] for p in places) for r in found.fetchall())))
