"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Each whole text becomes a row of document statistics. A Gaussian kernel over the
standardised statistics is approximated by random Fourier features with a fixed
seed. Each partition adds up its part of the normal equations of a ridge
regression on the labels; those sums are added up by matrix row, so that the
driver gets one matrix whatever the number of partitions. Raw scores are then
calibrated by isotonic regression (pool adjacent violators) over a histogram
with a fixed number of bins, on labelled rows that the regression didn't see.

Folds by crc32 of the id as text, modulo 5: 0 is held out, 1 calibrates, the
others fit. Only the labels' quality is learned; ids, languages and sources are
never inputs.

Nulls: a null text is an empty text; both get a score. A null label is no label;
an id that has several labels counts once for each. A null id is scored, never
learned. Without usable labels every score is the prior, 0.5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import byte_slices, held_out, release, small_batches, staged, text_bytes

FEATURES = 256
SEED = 20240611
RIDGE = 1e-4
BINS = 2000
LOW, HIGH = -0.5, 1.5
SLICE_BYTES = 1 << 20

#: Byte classes: 0 other, 1 lower-case, 2 upper-case, 3 digit, 4 blank, 5 line end, 6 sentence marks, 7 other marks, 8 beyond ASCII.
CLASSES = 9
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[32, 9]] = 4
_CLASS[[10, 13]] = 5
_CLASS[[ord(c) for c in ".,;:!?'\"-()"]] = 6
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 7
_CLASS[128:] = 8
NAMES = ["log_bytes", *(f"class_{i}" for i in range(1, CLASSES)), "word_length", "words_per_line", "log_words", "distinct_words", "distinct_lines", "marked_words", "entropy", "upper_words"]


def _length_stats(data: np.ndarray, a: int, b: int, texts: list[str | None], out: list[list[float]], offsets: np.ndarray) -> None:
    for i in range(a, b):
        part = data[offsets[i] : offsets[i + 1]]
        n = len(part)
        counts = np.bincount(part, minlength=256) if n else np.zeros(256, np.int64)
        by = np.bincount(_CLASS, weights=counts, minlength=CLASSES)
        text = texts[i] or ""
        words, lines = text.split(), text.split("\n")
        w = len(words)
        p = counts[counts > 0] / max(n, 1)
        marked = sum(not x[-1].isalnum() and x[-1] not in ".,;:!?" for x in words)
        out.append([
            math.log1p(n), *(by[1:] / max(n, 1)), sum(map(len, words)) / max(w, 1), w / len(lines), math.log1p(w),
            len(set(words)) / max(w, 1), len(set(lines)) / len(lines), marked / max(w, 1), float(-(p * np.log2(p)).sum()) if n else 0.0, sum(x[0].isupper() for x in words) / max(w, 1),
        ])


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and stats (array<float>, in the order of NAMES) of every whole text."""
    source = docs.select(key, text)
    kind = source.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in byte_slices(offsets, SLICE_BYTES):
                rows: list[list[float]] = []
                part = batch.slice(a, b - a)
                own = offsets[a : b + 1]
                _length_stats(data, 0, b - a, part.column(1).to_pylist(), rows, own)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float32()))], [key, "stats"])

    return source.mapInArrow(run, f"`{key}` {kind}, stats array<float>")


def fourier_features(width: int, features: int = FEATURES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Directions and phases; the kernel's width grows with the number of statistics."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(width, features)) / math.sqrt(width), rng.uniform(0, 2 * math.pi, features)


def expand(stats: np.ndarray, model: dict) -> np.ndarray:
    """Fourier features of standardised statistics, with a constant."""
    z = np.clip((stats - model["mean"]) / model["scale"], -6, 6) @ model["directions"] + model["phases"]
    return np.hstack([math.sqrt(2 / z.shape[1]) * np.cos(z), np.ones((len(stats), 1))])


def _stats(batch: pa.RecordBatch, column: str = "stats") -> np.ndarray:
    values = batch.column(batch.schema.get_field_index(column))
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def normal_equations(rows: DataFrame, model: dict) -> np.ndarray:
    """Z'Z and, as its last column, Z'y: summed by partition, then by matrix row."""
    size = model["directions"].shape[1] + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            if len(batch):
                z = expand(_stats(batch), model)
                y = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False).astype(np.float64)
                total += z.T @ np.hstack([z, y[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = row.values.to_numpy()
                sums[i] = sums[i] + values if i in sums else values.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["i", "row"])

    parts = rows.mapInArrow(partial, "i int, row array<double>")
    out = np.zeros((size, size + 1))
    for r in parts.repartition(32, "i").mapInArrow(add, "i int, row array<double>").collect():
        out[r.i] = r.row
    return out


def isotonic(values: list[float], weights: list[float]) -> list[float]:
    """Pool adjacent violators: the non-decreasing sequence nearest to these values by weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return [v for v, _, n in blocks for _ in range(int(n))]


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", features: int = FEATURES) -> dict:
    """The model, from labelled rows that aren't held out."""
    fold = F.crc32(F.col(key).cast("string").cast("binary")) % 5
    known = labels.select(F.col(key).alias("label_key"), F.col(label).cast("double").alias("label")).where("label is not null")
    rows = stats.where(F.col(key).isNotNull()).withColumn("fold", fold).where("fold <> 0")
    rows = staged(rows.join(known, rows[key] == known["label_key"]).select("stats", "label", "fold"), "quality-train")
    width = len(NAMES)
    directions, phases = fourier_features(width, features)
    fitting = rows.where("fold <> 1")
    moments = fitting.select(F.posexplode("stats").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    model = {"mean": np.zeros(width), "scale": np.ones(width), "directions": directions, "phases": phases, "knots": [0.0], "levels": [0.5]}
    if not moments:
        return model | {"weights": np.zeros(features + 1)}
    for r in moments:
        model["mean"][r.i], model["scale"][r.i] = r.m, max(r.s, 1e-6)
    sums = normal_equations(fitting, model)
    n = sums[-1, -2]
    model["weights"] = np.linalg.solve(sums[:, :-1] + RIDGE * n * np.eye(features + 1), sums[:, -1])
    binned = _raw(rows.where("fold = 1"), model, ["label"]).groupBy("bin").agg(F.avg("label").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    if binned:
        model["knots"] = [LOW + (r.bin + 0.5) * (HIGH - LOW) / BINS for r in binned]
        model["levels"] = [min(1.0, max(0.0, v)) for v in isotonic([r.y for r in binned], [float(r.n) for r in binned])]
    return model


def _raw(rows: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The columns kept, raw scores and their bins."""
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            raw = expand(_stats(batch), model) @ model["weights"]
            bins = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int32)
            score = np.interp(raw, model["knots"], model["levels"])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keep), pa.array(bins), pa.array(score)], [*keep, "bin", "score"])

    return rows.select(*keep, "stats").mapInArrow(run, f"{kinds}, bin int, score double")


def score_documents(docs: DataFrame, labels: DataFrame, least: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score and predicted of every document."""
    stats = staged(document_statistics(docs, key, text), "quality-stats")
    model = fit(stats, labels, key)
    scored = _raw(stats, model, [key])
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def keep_documents(docs: DataFrame, labels: DataFrame, least: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that score at least `least`, with all their columns; each text is scored where it is read, and only the rows that the model learns from are written before that."""
    small_batches(docs.sparkSession)
    learned = docs.where(F.col(key).isNotNull() & ~held_out(key))
    model = fit(document_statistics(learned, key, text), labels, key)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(place))
            for a, b in byte_slices(offsets, SLICE_BYTES):
                part = batch.slice(a, b - a)
                rows: list[list[float]] = []
                _length_stats(data, 0, b - a, part.column(place).to_pylist(), rows, offsets[a : b + 1])
                raw = expand(np.array(rows, np.float32).astype(np.float64), model) @ model["weights"]
                yield part.filter(pa.array(np.interp(raw, model["knots"], model["levels"]) >= least))
        release()

    return docs.mapInArrow(run, docs.schema)
