"""BPE, suffix indexes, repeated passages, Jaccard classes and decontamination against brute force."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex
from helpers_llm import documents

from gridlark.llm import bpe, decontam, dedup, jaccard
from gridlark.llm.bpe_query import vocabulary_path
from gridlark.llm.suffixes import RunLengthIndex

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' order by doc_id").fetchall()]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Automaton(bpe.load_vocabulary(vocabulary_path())))


def test_ids_are_those_of_the_library(encoder, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    rng = random.Random(1)
    odd = ["".join(rng.choice("ab aA  \n1'st.é!") for _ in range(rng.randrange(200))) for _ in range(500)]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x2000, 0x3100), rng.randrange(0x10000, 0x1F700)])) for _ in range(100)) for _ in range(200)]
    odd += [chr(c) + "a" + chr(c) + "1" + chr(c) * 2 + "!" for c in range(1, 0x400)]
    odd += ["", "a" * 5000, "ab" * 3000, "<|endoftext|>", "x<|endoftext|> <|endoftext|>y", "=" * 300 + " " * 77 + "x", "don't we'll 's 'S I'm'"]
    for a in range(0, len(texts) + len(odd), 400):
        part = (texts + odd)[a : a + 400]
        ids, offsets = encoder.encode(part)
        back = encoder.decode(ids, offsets)
        for i, (text, found) in enumerate(zip(part, tokenizer.encode_batch(part, add_special_tokens=False), strict=True)):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == found.ids
            assert back[i] == text == tokenizer.decode(found.ids, skip_special_tokens=False)


def test_automaton_accepts_correct_tokenizations_only(encoder):
    automaton = encoder.automaton
    names = {label: i for i, label in enumerate(automaton.arcs.to_pylist()) if automaton.alive[i]}
    rng = random.Random(2)
    for _ in range(300):
        word = bytes(rng.choice(b"ein therand") for _ in range(rng.randrange(1, 12)))
        right = automaton.encode([word])[0].tolist()

        def spell(at):
            if at == len(word):
                yield []
            for end in range(at + 1, len(word) + 1):
                if (label := names.get(word[at:end])) is not None:
                    for rest in spell(end):
                        yield [label, *rest]

        accepted = [s for s in spell(0) if automaton.has_arc(np.array([-1, *s[:-1]], np.int32), np.array(s, np.int32)).all()]
        assert accepted == [right]


def merged_by_rank(word, ranks):
    """The plain way: the earliest merge first, from the left."""
    out = [bytes([b]) for b in word]
    while len(out) > 1:
        m, i = min((ranks.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(out, out[1:], strict=False)))
        if m == 1 << 30:
            break
        out[i : i + 2] = [out[i] + out[i + 1]]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_automata_of_any_merges(seed, monkeypatch):
    """Random vocabularies, dead merges among them; long words go piece by piece."""
    monkeypatch.setattr(bpe, "LONG_PIECE", 7)
    rng = random.Random(seed)
    labels, merges, ranks = {i: bytes([b]) for i, b in enumerate(b"abc")}, [], {}
    for _ in range(60):
        u, v = rng.choice(list(labels)), rng.choice(list(labels))
        if labels[u] + labels[v] not in labels.values():
            w = len(labels)
            labels[w] = labels[u] + labels[v]
            ranks[labels[u], labels[v]] = len(merges)
            merges.append((u, v, w))
    automaton = bpe.Automaton({"labels": labels, "merges": merges, "special": {}})
    words = [bytes(rng.choice(b"abc") for _ in range(rng.choice([0, 1, 2, 5, 16, 17, 40, 64, 65, 200]))) for _ in range(200)]
    ids, counts = automaton.encode(words)
    ends = np.cumsum(counts).tolist()
    for word, a, b in zip(words, [0, *ends[:-1]], ends, strict=True):
        assert [labels[i] for i in ids[a:b].tolist()] == merged_by_rank(word, ranks)


def test_latin_pattern_is_the_pattern(encoder):
    low = "".join(map(chr, range(0x250)))
    for text in (low, low[::-1], " ".join(low), "'".join(low)):
        assert encoder.split_latin(text) == regex.findall(bpe.PATTERN, text)


def test_encoded_rows(spark):
    found = bpe.encode_texts(documents(spark, [None, "", "the cat", "the cat"], extra=True), vocabulary_path()).collect()
    by = {r["doc_id"]: r for r in found}
    assert by[0]["n_tokens"] == by[1]["n_tokens"] == 0 and by[0]["ids"] == [] and by[0]["ids_sha256"] == hashlib.sha256().hexdigest()
    assert by[2]["ids"] == by[3]["ids"] and by[2]["decoded_sha256"] == hashlib.sha256(b"the cat").hexdigest()
    assert bpe.encode_texts(documents(spark, ["x"]).where("doc_id < 0"), vocabulary_path()).count() == 0


def test_index_marks_what_occurs_again():
    rng = random.Random(3)
    for _ in range(200):
        least = rng.choice([1, 2, 3, 5, 9])
        base = bytes(rng.choice(b"ab\0") for _ in range(40))
        strings = []
        for _ in range(rng.choice([1, 2, 3, 8])):
            at = rng.randrange(30)
            strings.append(base[at : at + rng.randrange(40)] if rng.random() < 0.6 else bytes(rng.choice(b"ab") for _ in range(rng.randrange(30))))
        counts = Counter(s[i : i + least] for s in strings for i in range(len(s) - least + 1))
        expected = [[counts[s[i : i + least]] > 1 for i in range(len(s) - least + 1)] for s in strings]
        assert [x.tolist() for x in RunLengthIndex(strings).repeated(least)] == expected


def repeated_by_force(texts, least):
    raw = [(t or "").encode() for t in texts]
    counts = Counter(b[i : i + least] for b in raw for i in range(len(b) - least + 1))
    out = []
    for b in raw:
        marks = np.zeros(len(b), bool)
        for i in range(len(b) - least + 1):
            if counts[b[i : i + least]] > 1:
                marks[i : i + least] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~marks])
        runs = int((np.diff(np.concatenate([[0], marks.astype(int)])) == 1).sum())
        out.append((len(b), int(marks.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def passages():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, line = prose(110), "one line that stands again and again in the very same text, and in others too.\n"
    out = [None, "", "é" * 500, "x" * 1200, "x" * 399, "y" * 400, "ab" * 450, line * 12, prose(50) + line * 9 + prose(40)]
    out += [prose(rng.randrange(60)) + " " + shared + " " + prose(rng.randrange(60)) for _ in range(40)]
    base = prose(400)
    for _ in range(30):
        words = base.split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = word()
        out.append(" ".join(words))
    return [*out, base, base, prose(3000), prose(300)]


@pytest.mark.parametrize("chunk", [dedup.CHUNK, 5])
def test_repeated_passages(spark, monkeypatch, chunk):
    """With chunk 5 an anchor's contexts are dealt to several blocks."""
    monkeypatch.setattr(dedup, "CHUNK", chunk)
    monkeypatch.setattr(dedup, "BLOCK_BYTES", 20_000)
    texts = passages()
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in dedup.deduplicate(documents(spark, texts, extra=True)).collect()}
    assert [found[i] for i in range(len(texts))] == repeated_by_force(texts, 400)


def test_pieces_of_long_texts_join(monkeypatch):
    monkeypatch.setattr(dedup, "PIECE", 1000)
    rng = random.Random(8)
    data = np.frombuffer(bytes(rng.choice(b"abcd") for _ in range(7000)), np.uint8)
    small = dedup.windows_of(data, dedup.Grams(), 400)
    monkeypatch.setattr(dedup, "PIECE", 1 << 17)
    whole = dedup.windows_of(data, dedup.Grams(), 400)
    expand = lambda w: np.repeat(w[1], np.diff(np.concatenate([w[0], [len(data) - 399]])))
    assert (expand(small) == expand(whole)).all()
    assert all((np.sort(a) == np.sort(b)).all() for a, b in zip(small[2:], whole[2:], strict=True))


def test_cleaned_documents(spark):
    texts = passages()
    found = dedup.clean_documents(documents(spark, texts)).collect()
    expected = repeated_by_force(texts, 400)
    gone = {i for i, (n, removed, _, _) in enumerate(expected) if removed and removed == n}
    assert {r["doc_id"] for r in found} == set(range(len(texts))) - gone
    for r in found:
        assert r["text"] is None or r["n_chars"] == len(r["text"])
        if not expected[r["doc_id"]][1]:
            assert r["text"] == texts[r["doc_id"]]
    assert dedup.clean_documents(documents(spark, ["x"]).where("doc_id < 0")).count() == 0


def classes_by_force(texts, words, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and sets[j] and den * shared >= num * (len(a) + len(sets[j]) - shared):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def near_copies():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    out = [None, "", "  \n ", "one", "One", "two words", "a b c d", "a b c d e", "A B C D E f"]
    for size in (3, 7, 9, 14, 16, 20, 24, 40, 90, 300):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(14):
            words = list(base)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(words))
                if rng.random() < 0.4:
                    words[at] = rng.choice(vocabulary)
                elif rng.random() < 0.5:
                    del words[at:]
                else:
                    words.insert(at, rng.choice(vocabulary))
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("words", "num", "den"), [(4, 85, 100), (5, 4, 5), (2, 3, 5)])
def test_classes(spark, words, num, den):
    texts = near_copies()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(documents(spark, texts, extra=True), words, num, den).collect()}
    assert [found[i] for i in range(len(texts))] == classes_by_force(texts, words, num, den)


def test_light_and_heavy_keys_miss_no_link():
    rng = random.Random(4)
    for num, den in ((85, 100), (4, 5), (1, 2)):
        boundary = jaccard.cost_boundary(num, den)
        assert boundary >= 1
        for _ in range(400):
            n = rng.randrange(1, 2 * boundary + 4)
            a = rng.sample(range(1, 1 << 40), n + 6)
            x = set(a[:n])
            y = set(rng.sample(sorted(x), rng.randrange(max(1, n - 3), n + 1))) | set(a[n : n + rng.randrange(4)])
            if den * len(x & y) < num * len(x | y):
                continue
            p, q = (np.sort(np.array(sorted(s), np.uint64)) for s in (x, y))
            if max(len(p), len(q)) <= boundary:
                assert set(jaccard.light_keys(p, boundary, num, den).tolist()) & set(jaccard.light_keys(q, boundary, num, den).tolist())
            else:
                assert len(p) * den // num > boundary and len(q) * den // num > boundary
                counts = np.array([rng.randrange(4) for _ in range(64)], np.uint8)
                assert set(jaccard.heavy_keys(p, counts, num, den).tolist()) & set(jaccard.heavy_keys(q, counts, num, den).tolist())


def test_empty_table_has_no_classes(spark):
    assert jaccard.classes(documents(spark, ["x"]).where("doc_id < 0")).count() == 0


ITEMS = [
    (0, "If Anna Keller has 12 apples and gives 5 apples to Robert Braun how many apples does Anna Keller have left over"),
    (1, "A train drives 120 km in 2 hours and then it goes on for another 60 km at the very same speed as before"),
    (2, "the quick brown fox jumps over the lazy dog while seven small birds sit on the old wooden fence near here"),
    (3, "too short for one window"), (4, None), (5, ""),
]


def test_contaminated_documents(spark):
    docs = documents(spark, [
        "Some words first. If Maria Stein has 40 apples and gives 7 apples to Walter Voss how many apples does Maria Stein have left over and more words",  # other names and numbers
        "If Maria Stein has 40 apples and gives 7 apples to Walter Voss how many apples does Paul Herz have left over",  # two names for one
        "note: " + ITEMS[2][1].upper() + " end", "the quick brown fox jumps over a lazy cat", ITEMS[1][1].replace("120", "300").replace("60 km", "90 km"),
        "prose before it, too short for one window, and after", None, "", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20",
    ], extra=True)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontam.contaminated(docs, items).collect()}
    assert found == {(0, 0): "reparameterised", (2, 2): "verbatim", (4, 1): "reparameterised", (5, 3): "verbatim"}
    assert decontam.contaminated(docs.where("doc_id < 0"), items).count() == 0 and decontam.contaminated(docs, items.where("item_id < 0")).count() == 0


def test_planted_items_are_found(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()}
    assert found == {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items.collect() if i["text"] in d["text"]}
