"""Language identification by hierarchical discrimination.

Whole texts are averaged over hashed byte bigrams and trigrams. A linear support
vector machine for each pair of families votes on the family; within it, one for
each pair of its languages votes on the language. Classifiers are fitted by dual
coordinate descent on the driver, on a bounded sample of labelled rows: about
`sample` rows, the same share for each language, picked by a hash of id and text.
Rows whose crc32 of the id as text is divisible by 5 are held out. Only the text
and, when learning, lang are read.

Nulls: a null text, like one without any letter, is `und` with score 0. A null
lang is no label. A text of fewer than three bytes is decided by the
classifiers' constants. Equal rows get equal answers. Without labels all is
`und`. Languages that the table of families lacks are a family of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import held_out, small_batches, text_bytes

#: Language codes by family.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr"],
}
BITS = 12
WIDTH = 2 << BITS
SAMPLE = 4000
SLICE = 1 << 20
EPOCHS = 12
PENALTY = 1.0

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bigrams and trigrams that start at each place but the last two."""
    x = _LOWER[data]
    two = x[:-2] | x[1:-1] << np.uint32(8)
    three = two | x[2:] << np.uint32(16)
    shift = np.uint32(32 - BITS)
    return (two * np.uint32(2654435761)) >> shift, ((three * np.uint32(2246822519)) >> shift) + np.uint32(1 << BITS)


def starts(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of at most `most` places that cover all bytes."""
    a, end = int(offsets[0]), int(offsets[-1])
    while a < end:
        yield a, min(end, a + most)
        a += most


def averages(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The mean weight of the grams of each row; long rows are added up piece by piece."""
    first, stop = offsets[:-1], np.maximum(offsets[1:] - 2, offsets[:-1])
    sums = np.zeros((len(first), weights.shape[1]))
    for a, b in starts(offsets, SLICE):
        piece = data[a : b + 2]
        if len(piece) < 3:
            continue
        two, three = grams(piece)
        rows = slice(max(0, int(np.searchsorted(offsets, a, side="right")) - 1), int(np.searchsorted(offsets, b)))
        lo = np.clip(first[rows] - a, 0, len(two))
        hi = np.clip(np.minimum(stop[rows], b) - a, 0, len(two))
        hi = np.maximum(lo, hi)
        for c in range(weights.shape[1]):
            w = np.ascontiguousarray(weights[:, c])
            total = np.zeros(len(two) + 1)
            np.cumsum(w[two] + w[three], out=total[1:])
            sums[rows, c] += total[hi] - total[lo]
    return sums / np.maximum(stop - first, 1)[:, None]


def train_svm(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, penalty: float = PENALTY) -> np.ndarray:
    """A linear SVM (squared hinge), by dual coordinate descent; the last column of x is the constant."""
    rng = np.random.default_rng(7)
    w = np.zeros(x.shape[1])
    alpha = np.zeros(len(y))
    size = np.einsum("ij,ij->i", x, x, dtype=np.float64) + 1 / (2 * penalty)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            slack = y[i] * (x[i] @ w) - 1 + alpha[i] / (2 * penalty)
            new = max(0.0, alpha[i] - slack / size[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def _sample(docs: DataFrame, key: str, text: str, lang: str, sample: int) -> tuple[np.ndarray, list[str]]:
    """Gram frequencies and languages of about `sample` rows."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key)).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    counts = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return np.zeros((0, WIDTH), np.float32), []
    each = max(1, sample // len(counts))
    share = F.create_map(*(F.lit(v) for l, n in sorted(counts.items()) for v in (l, min(1.0, each / n))))
    picked = known.where(F.pmod(F.xxhash64(F.lit("langid"), "k", "t"), F.lit(1 << 30)) < F.element_at(share, F.col("l")) * float(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            langs, at, values = [], [], []
            for i, name in enumerate(batch.column(2).to_pylist()):
                own = data[offsets[i] : offsets[i + 1]]
                if len(own) < 3:
                    continue
                total = np.zeros(WIDTH, np.int64)
                for a, b in starts(np.array([0, len(own)]), SLICE):
                    if len(piece := own[a : b + 2]) >= 3:
                        two, three = grams(piece)
                        total += np.bincount(two, minlength=WIDTH) + np.bincount(three, minlength=WIDTH)
                found = np.flatnonzero(total)
                langs.append(name)
                at.append(found.astype(np.int32))
                values.append((total[found] / (len(own) - 2)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["l", "at", "v"])

    rows = picked.mapInArrow(run, "l string, at array<int>, v array<float>").toArrow()
    x = np.zeros((len(rows), WIDTH), np.float32)
    for i, (at, v) in enumerate(zip(rows.column("at"), rows.column("v"), strict=True)):
        x[i, at.values.to_numpy()] = v.values.to_numpy()
    return x, rows.column("l").to_pylist()


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, families: dict[str, list[str]] | None = None) -> dict:
    """Weights and constants of all classifiers, and what each tells apart."""
    x, langs = _sample(docs, key, text, lang, sample)
    family_of = {code: f for f, codes in (families or FAMILIES).items() for code in codes}
    members: dict[str, list[str]] = {}
    for code in sorted(set(langs)):
        members.setdefault(family_of.get(code, f"own:{code}"), []).append(code)
    codes = np.array(langs, dtype=object)
    kin = np.array([family_of.get(c, f"own:{c}") for c in langs], dtype=object)
    scale = 1 / np.sqrt(x.mean(axis=0, dtype=np.float64) + 1e-6) if len(x) else np.ones(WIDTH)
    scaled = np.hstack([x * scale.astype(np.float32), np.ones((len(x), 1), np.float32)])
    tasks = [("family", a, b, kin) for a, b in combinations(sorted(members), 2)] + [("lang", a, b, codes) for own in members.values() for a, b in combinations(own, 2)]
    weights, constants = np.zeros((WIDTH, len(tasks))), np.zeros(len(tasks))
    for t, (_, a, b, names) in enumerate(tasks):
        rows = np.flatnonzero((names == a) | (names == b))
        w = train_svm(scaled[rows], np.where(names[rows] == a, 1.0, -1.0))
        weights[:, t], constants[t] = w[:-1] * scale, w[-1]
    return {"members": members, "tasks": [(k, a, b) for k, a, b, _ in tasks], "weights": weights, "constants": constants}


def _vote(names: list[str], pairs: list[tuple[int, str, str]], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The winner's index in names and its confidence, by votes, then by summed margins."""
    place = {n: i for i, n in enumerate(names)}
    votes = np.zeros((len(margins), len(names)))
    sure = np.ones((len(margins), len(names)))
    for t, a, b in pairs:
        p = 1 / (1 + np.exp(-np.clip(3 * margins[:, t], -30, 30)))
        votes[:, place[a]] += (margins[:, t] >= 0) + 1e-3 * p
        votes[:, place[b]] += (margins[:, t] < 0) + 1e-3 * (1 - p)
        sure[:, place[a]] = np.minimum(sure[:, place[a]], p)
        sure[:, place[b]] = np.minimum(sure[:, place[b]], 1 - p)
    best = votes.argmax(axis=1)
    return best, sure[np.arange(len(best)), best]


def predict(model: dict, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and confidence of each row."""
    n = len(offsets) - 1
    if not model["members"]:
        return ["und"] * n, np.zeros(n)
    margins = averages(data, offsets, model["weights"]) + model["constants"]
    tasks = list(enumerate(model["tasks"]))
    families = sorted(model["members"])
    family, score = _vote(families, [(t, a, b) for t, (k, a, b) in tasks if k == "family"], margins)
    langs = np.empty(n, dtype=object)
    for f, name in enumerate(families):
        rows = np.flatnonzero(family == f)
        own = model["members"][name]
        best, sure = _vote(own, [(t, a, b) for t, (k, a, b) in tasks if k == "lang" and a in own], margins[rows])
        langs[rows] = np.array(own, dtype=object)[best]
        score[rows] *= sure
    return langs.tolist(), score


def identify(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, lang_pred and score of every whole text."""
    source = docs.select(key, text, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("lettered"), held_out(key).alias("held_out"))
    kind = source.schema[key].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            langs, score = predict(model, data, offsets)
            lettered = batch.column(2).to_pylist()
            names = [x if ok else "und" for x, ok in zip(langs, lettered, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(names, pa.string()), pa.array(np.where(lettered, score, 0.0))], [key, "held_out", "lang_pred", "score"])

    return source.mapInArrow(run, f"`{key}` {kind}, held_out boolean, lang_pred string, score double")
