"""Removal of long repeated passages, found by run-length indexes over the whole corpus.

A window of `least` bytes that starts anywhere else too, in the same text or in
another, is repeated; every byte that a repeated window covers is removed.
Texts are bytes and windows never cross texts.

How windows that are equal meet: of the hashes of the GRAM-byte grams of a window the
least is its anchor; equal windows have the same anchor. Windows that start one
after the other and have the same anchor are one stretch of text, a context; so
each window is in one context, whatever the corpus. Contexts are dealt out by
anchor, and each block of whole anchors gets a run-length index (suffixes.py),
whose matching statistics mark the windows that occur again.

What can't be repeated is left out before that, by counting, never by guessing:
* Equal texts are one text with a number; if that is over one, all its windows
  are repeated. Equal contexts are one context with a number likewise.
* An anchor that occurs once has no repeated window.
* Of the grams in what is left, those whose hash is divisible by SAMPLED are
  counted; a window with one that occurs once isn't repeated.
Counts are looked up in bit maps of a fixed size; a wrong bit only means more
work. An anchor with more than CHUNK contexts is dealt to several blocks; windows
not repeated within their block, and one of each that is, then meet by a 128-bit
hash, so that no anchor has to fit into one task.

With `words`, passages of that many words that stand anywhere else too are
removed as well, however few bytes they have and whatever white space is between
the words. Texts are then also indexed as CODE bytes of hash for each word, as
above; equal windows of such bytes are equal words but for one pair in 2^48.

Nulls: a null text is empty. Texts shorter than `least` bytes keep all. A null id
stays null. Repeated rows are equal texts. An empty table gives no rows.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import bit_map, has_bit, map_bits, release, scratch, shared_value, small_batches, split_rows, staged, text_bytes
from gridlark.llm.suffixes import RunLengthIndex

LEAST = 400
GRAM = 64
SAMPLED = 32
CHUNK = 2048
BLOCK_BYTES = 1_000_000
PIECE = 1 << 17
CODE = 6
VOCABULARY = 100_000
_WORD = re.compile(r"\S+")
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, _U), np.full(n, pow(_BASE, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Grams:
    """Hashes of all grams of a piece of text, with tables of powers."""

    def __init__(self):
        self.up, self.down = _powers(PIECE + 4 * LEAST)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if n > len(self.up):
            self.up, self.down = _powers(n + 1)
        sums = np.zeros(n + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * self.up[:n], out=sums[1:])
        h = (sums[GRAM:] - sums[:-GRAM]) * self.down[: n - GRAM + 1]
        h ^= h >> _U(29)
        h *= _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(32)
        return h


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each `width` values in a row."""
    f = np.minimum if least else np.maximum
    n, step, out = len(values) - width + 1, 1, values
    while 2 * step <= width:
        out = f(out[:-step], out[step:])
        step *= 2
    return f(out[:n], out[width - step : width - step + n]) if step < width else out[:n]


def windows_of(data: np.ndarray, grams: Grams, least: int) -> tuple[np.ndarray, ...]:
    """Of one text: starts and anchors of its contexts; anchors of all their places; places and hashes of sampled grams.

    The text is read in pieces that overlap, so that working space is bounded.
    """
    n, wide = len(data), least - GRAM + 1
    if n < least:
        none = np.zeros(0, np.int64)
        return none, none.astype(_U), none.astype(_U), none, none.astype(_U)
    starts, anchors, places, at, sampled = [], [], [], [], []
    last = n - least  # the last window's start
    for a in range(0, last + 1, PIECE):
        b = min(a + PIECE, last + 1)  # windows [a, b)
        before = max(0, a - wide + 1)
        h = grams.hashes(data[before : min(n, b - 1 + least + wide - 1)])
        low = _sliding(h, wide, True)
        own = low[a - before : b - before]
        cut = np.flatnonzero(own[1:] != own[:-1]) + 1
        starts.append(np.concatenate([[0], cut]) + a)
        anchors.append(own[np.concatenate([[0], cut])])
        # Grams that are the least of a window: each is counted in the piece that its place is in.
        pad = np.zeros(wide - 1, _U)
        top = _sliding(np.concatenate([pad, low, pad]), wide, False)
        stop = n - GRAM + 1 if b > last else b
        mine = slice(a - before, stop - before)
        places.append(h[mine][top[mine] == h[mine]])
        found = np.flatnonzero(h[mine] % _U(SAMPLED) == 0)
        at.append(found + a)
        sampled.append(h[mine][found])
    return tuple(np.concatenate(x) for x in (starts, anchors, places, at, sampled))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64) if values.dtype == _U else values.astype(np.int64)


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _codes(own: bytes, known: dict[str, int]) -> np.ndarray:
    """CODE bytes for each word of a text, with a bounded table of words."""
    words = own.decode("utf-8", "surrogateescape").split()
    if len(known) > VOCABULARY:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogateescape"))
    hashes = np.array([known[w] for w in words], _U)
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :CODE]).reshape(-1)


def _prepared(docs: DataFrame, key: str, text: str, least: int, carry: list[str], coded: bool = False) -> DataFrame:
    """Per row: id, the text's name (t1, t2), bytes (coded: its words' codes), what windows_of() finds, and the carried columns as a struct."""
    extra = F.struct(*(F.col(c) for c in carry)) if carry else F.struct(F.lit(True).alias("none"))
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("bytes"), extra.alias("extra"))
    kind = source.schema["extra"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        known: dict[str, int] = {}
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                own = part.column(1) if not coded else pa.array([_codes(x.as_buffer().to_pybytes(), known).tobytes() for x in part.column(1)], pa.binary())
                data, offsets = text_bytes(own)
                names, lists = [], [[], [], [], [], []]
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    names.append(_halves(xxhash.xxh3_128_digest(data[a:b].tobytes())))
                    for column, values in zip(lists, windows_of(data[a:b], grams, least), strict=True):
                        column.append(_signed(values))
                t1, t2 = zip(*names, strict=True)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                arrays = [pa.array(c, pa.list_(k)) for c, k in zip(([x.astype(np.int32) if k == pa.int32() else x for x in c] for c, k in zip(lists, kinds, strict=True)), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), *arrays, own, part.column(2)], ["doc_id", "t1", "t2", "starts", "anchors", "places", "at", "sampled", "bytes", "extra"])
        del grams, known
        release()

    return source.mapInArrow(run, f"doc_id bigint, t1 bigint, t2 bigint, starts array<int>, anchors array<bigint>, places array<bigint>, at array<int>, sampled array<bigint>, bytes binary, extra {kind}")


def _list(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name))[i].values.to_numpy()


def _chosen(batch: pa.RecordBatch, reps: np.ndarray) -> list[int]:
    """Rows that stand for their text, or may do."""
    ids = batch.column(batch.schema.get_field_index("rep")).to_numpy()
    return np.flatnonzero(has_bit(reps, ids)).tolist()


def _named(rows: DataFrame) -> DataFrame:
    """With rep: the hash of id and text by which the row that stands for a text is known."""
    return rows.withColumn("rep", F.xxhash64("doc_id", "t1", "t2"))


def _anchor_counts(rows: DataFrame, reps: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if found := _chosen(batch, reps.value):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_list(batch, "places", i) for i in found]))], ["hash"])

    places = _named(rows).select("rep", "places").mapInArrow(run, "hash bigint")
    return places.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")


def _open_runs(starts: np.ndarray, anchors: np.ndarray, size: int, repeated: np.ndarray, least: int) -> np.ndarray:
    """For each window of a text, the number of its run of equal anchors, or -1 where the anchor occurs once."""
    runs = np.where(has_bit(repeated, anchors), np.arange(len(starts)), -1)
    return np.repeat(runs, np.diff(np.concatenate([starts, [size - least + 1]])))


def _gram_counts(rows: DataFrame, reps: Broadcast, anchors: Broadcast, least: int) -> DataFrame:
    """Sampled grams that occur more than once in windows whose anchor does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in _chosen(batch, reps.value):
                at = _list(batch, "at", i)
                size = batch.column(batch.schema.get_field_index("size"))[i].as_py()
                if size < least or not len(at):
                    continue
                live = _open_runs(_list(batch, "starts", i), _list(batch, "anchors", i), size, anchors.value, least) >= 0
                # A gram at p is in the windows that start in (p + GRAM - least) .. p.
                before = np.concatenate([[0], np.cumsum(live)])
                lo, hi = np.maximum(at + GRAM - least, 0), np.minimum(at + 1, len(live))
                out.append(_list(batch, "sampled", i)[before[np.maximum(hi, lo)] > before[lo]])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], ["hash"])

    grams = _named(rows).select("rep", F.octet_length("bytes").alias("size"), "starts", "anchors", "at", "sampled").mapInArrow(run, "hash bigint")
    return grams.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")


def _contexts_of(batch: pa.RecordBatch, i: int, anchors: np.ndarray, grams: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, anchor) of a row's contexts."""
    size = len(batch.column(batch.schema.get_field_index("bytes"))[i].as_buffer() or b"")
    if size < least:
        return
    names = _list(batch, "anchors", i)
    runs = _open_runs(_list(batch, "starts", i), names, size, anchors, least)
    if not (runs >= 0).any():
        return
    at = _list(batch, "at", i)
    once = at[~has_bit(grams, _list(batch, "sampled", i))]
    barred = np.zeros(len(runs) + 1, np.int64)
    lo, hi = np.maximum(once + GRAM - least, 0), np.minimum(once + 1, len(runs))
    keep = lo < hi
    np.add.at(barred, lo[keep], 1)
    np.add.at(barred, hi[keep], -1)
    runs = np.where(np.cumsum(barred[:-1]) > 0, -1, runs)
    cut = np.flatnonzero(runs[1:] != runs[:-1]) + 1
    edges = np.concatenate([[0], cut, [len(runs)]]).tolist()
    most = least - GRAM + 1
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if runs[a] >= 0:
            for s in range(a, b, most):  # longer only where grams repeat at short distances
                yield s, min(b, s + most) - 1 + least, int(names[runs[a]])


def _contexts(rows: DataFrame, reps: Broadcast, anchors: Broadcast, grams: Broadcast, least: int, wanted: Broadcast | None = None, salts: Broadcast | None = None) -> DataFrame:
    """anchor, the context's name (c1, c2), and the text's name and start; if wanted: anchor, salt, name and bytes of the wanted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            held = 0
            t1, t2 = batch.column(batch.schema.get_field_index("t1")).to_pylist(), batch.column(batch.schema.get_field_index("t2")).to_pylist()
            names = ["anchor", "c1", "c2", "t1", "t2", "start", "size"] if wanted is None else ["anchor", "c1", "c2", "salt", "bytes"]
            kinds = [pa.int64()] * 5 + [pa.int32()] * 2 if wanted is None else [pa.int64()] * 3 + [pa.int32(), pa.binary()]
            for i in _chosen(batch, reps.value):
                text = batch.column(batch.schema.get_field_index("bytes"))[i].as_py()
                found = list(_contexts_of(batch, i, anchors.value, grams.value, least))
                if wanted is not None and found:
                    keys = np.array([xxhash.xxh3_64_intdigest(f"{t1[i]} {t2[i]} {a}") for a, _, _ in found], _U)
                    found = [x for x, ok in zip(found, has_bit(wanted.value, keys).tolist(), strict=True) if ok]
                for a, b, anchor in found:
                    own = text[a:b]
                    c1, c2 = _halves(xxhash.xxh3_128_digest(own))
                    if wanted is None:
                        row = (anchor, c1, c2, t1[i], t2[i], a, b - a)
                    else:
                        row = (anchor, c1, c2, c1 % salts.value.get(anchor, 1), own)
                        held += len(own)
                    for column, v in zip(out, row, strict=False):
                        column.append(v)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names)
                    out, held = [[], [], [], [], [], [], []], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names)

    schema = "anchor bigint, c1 bigint, c2 bigint, t1 bigint, t2 bigint, start int, size int" if wanted is None else "anchor bigint, c1 bigint, c2 bigint, salt int, bytes binary"
    return _named(rows).select("rep", "t1", "t2", "starts", "anchors", "at", "sampled", "bytes").mapInArrow(run, schema)


def _spans(repeated: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs of repeated windows, as the bytes they cover."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]]))).tolist()
    return [(a, b - 1 + least) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _indexed(contexts: DataFrame, salts: Broadcast, least: int) -> DataFrame:
    """Marks of contexts (from, to), and for salted anchors the windows still to be met: name f1, f2 and, if not yet marked, the start."""
    kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 2
    names = ["anchor", "c1", "c2", "from", "to", "f1", "f2"]

    def marks(block: list[tuple[int, int, int, bytes]]) -> Iterator[tuple]:
        index = RunLengthIndex([x[3] for x in block])
        met: set[tuple[int, int, int]] = set()
        for (anchor, c1, c2, own), repeated in zip(block, index.repeated(least), strict=True):
            for a, b in _spans(repeated, least):
                yield anchor, c1, c2, a, b, None, None
            if anchor in salts.value:
                for s, again in enumerate(repeated.tolist()):
                    f1, f2 = _halves(xxhash.xxh3_128_digest(own[s : s + least]))
                    if not again:
                        yield anchor, c1, c2, s, None, f1, f2
                    elif (anchor, f1, f2) not in met:
                        met.add((anchor, f1, f2))
                        yield anchor, c1, c2, None, None, f1, f2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[int, int, int, bytes]] = []
        held = 0
        for batch in batches:
            for anchor, c1, c2, salt, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block and held >= BLOCK_BYTES and (anchor, salt) != group:
                    yield from _emit(marks(block), kinds, names)
                    block, held = [], 0
                group = (anchor, salt)
                block.append((anchor, c1, c2, own))
                held += len(own)
        if block:
            yield from _emit(marks(block), kinds, names)
        del block
        release()

    ordered = contexts.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    return ordered.select("anchor", "c1", "c2", "salt", "bytes").mapInArrow(run, "anchor bigint, c1 bigint, c2 bigint, from int, to int, f1 bigint, f2 bigint")


def _emit(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    block = []
    for row in rows:
        block.append(row)
        if len(block) >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*block, strict=True), kinds, strict=True)], names)
            block = []
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*block, strict=True), kinds, strict=True)], names)


def repeated_spans(rows: DataFrame, least: int, count: int) -> DataFrame:
    """t1, t2 and spans (array of from and to, not merged) of every text of _prepared() that has repeated windows. count: about how many rows there are."""
    spark = rows.sparkSession
    few, many = map_bits(count), map_bits(count, 256)
    with scratch(spark), contextlib.ExitStack() as shares:
        share = lambda value: shares.enter_context(shared_value(spark, value))
        texts = staged(rows.where(F.octet_length("bytes") >= least).groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"), F.first(F.octet_length("bytes")).alias("size")), "dedup-texts")
        reps = share(bit_map(_named(texts).select("rep"), "rep", few))
        anchors = share(bit_map(_anchor_counts(rows, reps), "hash", many))
        grams = share(bit_map(_gram_counts(rows, reps, anchors, least), "hash", many))
        places = staged(_contexts(rows, reps, anchors, grams, least), "dedup-contexts").dropDuplicates(["t1", "t2", "start"])
        groups = staged(places.groupBy("anchor", "c1", "c2").agg(F.count(F.lit(1)).alias("times"), F.first("size").alias("size"), F.min(F.struct("t1", "t2", "start")).alias("place")), "dedup-groups")
        # A context alone is indexed too: its anchor may occur in it twice, and so may its windows.
        sizes = groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts"))
        # At most 65536 anchors have that many contexts.
        chunk = max(CHUNK, groups.count() >> 16)
        salts = share({r["anchor"]: -(-r["contexts"] // chunk) for r in sizes.where(F.col("contexts") > chunk).collect()})
        wanted_places = groups.select("place.*")

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = [xxhash.xxh3_64_intdigest(f"{a} {b} {c}") for a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, _U).view(np.int64))], ["hash"])

        wanted = share(bit_map(wanted_places.mapInArrow(hashed, "hash bigint"), "hash", many))
        marked = staged(_indexed(_contexts(rows, reps, anchors, grams, least, wanted, salts), salts, least), "dedup-marks")
        own = marked.where("to is not null").select("anchor", "c1", "c2", "from", "to")
        open_windows = marked.where("f1 is not null")
        # One block's word for each window is one row; a window that two blocks have is repeated.
        again = staged(open_windows.groupBy("anchor", "f1", "f2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", "f1", "f2"), "dedup-again")
        met = open_windows.where("from is not null").join(again, ["anchor", "f1", "f2"]).select("anchor", "c1", "c2", "from", (F.col("from") + least).alias("to"))
        whole = groups.where("times > 1").select("anchor", "c1", "c2", F.lit(0).alias("from"), F.col("size").alias("to"))
        # Written before it is joined, so that Spark can split a context that many texts have.
        by_context = staged(own.unionAll(met).unionAll(whole).groupBy("anchor", "c1", "c2").agg(F.collect_set(F.struct("from", "to")).alias("spans")), "dedup-by-context")
        met_places = staged(places.select("anchor", "c1", "c2", "t1", "t2", "start").join(by_context, ["anchor", "c1", "c2"]), "dedup-places")
        by_text = met_places.select("t1", "t2", F.explode(F.transform("spans", lambda s: F.struct((s["from"] + F.col("start")).alias("from"), (s["to"] + F.col("start")).alias("to")))).alias("span"))
        copied = texts.where("copies > 1").select("t1", "t2", F.struct(F.lit(0).alias("from"), F.col("size").alias("to")).alias("span"))
        return staged(by_text.unionAll(copied).groupBy("t1", "t2").agg(F.collect_set("span").alias("spans")), "dedup-spans", keep=True)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of what these spans cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_words(rows: DataFrame, words: int, count: int) -> DataFrame:
    """t1, t2 and coded (array of from and to in bytes of its codes) of every text of _prepared() that has repeated windows of so many words."""
    with scratch(rows.sparkSession):
        coded = staged(_prepared(rows, "doc_id", "bytes", words * CODE, ["t1", "t2"], coded=True), "dedup-words")
        spans = repeated_spans(coded.drop("extra"), words * CODE, count).withColumnRenamed("spans", "coded")
        return staged(coded.select("t1", "t2", "extra").join(spans, ["t1", "t2"]).select("extra.t1", "extra.t2", "coded").dropDuplicates(["t1", "t2"]), "dedup-coded", keep=True)


def _byte_spans(own: bytes, coded: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of codes as the bytes from their first word to their last."""
    if not coded:
        return []
    text = own.decode("utf-8", "surrogateescape")
    places = [m.span() for m in _WORD.finditer(text)]
    at = lambda i: len(text[:i].encode("utf-8", "surrogateescape"))
    return [(at(places[-(-a // CODE)][0]), at(places[b // CODE - 1][1])) for a, b in merged(coded)]


def deduplicate(docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text", carry: list[str] | None = None, words: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), text (the same, without characters that a removed passage cut in two), kept_sha256 and extra (a struct of the columns to carry) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    count = docs.count()
    rows = staged(_prepared(docs, key, text, least, carry or []), "dedup-rows")
    with scratch(spark):
        spans = repeated_spans(rows.drop("extra"), least, count).withColumn("coded", F.lit(None).cast("array<struct<from:int,to:int>>"))
        if words:
            spans = spans.drop("coded").join(repeated_words(rows, words, count), ["t1", "t2"], "full")
        spans = staged(spans, "dedup-both", keep=True)
    slim = rows.select("doc_id", "t1", "t2", "bytes", "extra")
    kind = slim.schema["extra"].dataType.simpleString()
    met, others = split_rows(slim, "t1", spark.sparkContext.broadcast(bit_map(spans.select("t1"), "t1", map_bits(count))))
    # Only texts that have spans, or may have, are shuffled.
    nothing = F.lit(0).cast("long")
    whole = others.select(
        "doc_id", F.octet_length("bytes").cast("long").alias("n_bytes"), nothing.alias("n_removed"), nothing.alias("n_spans"), F.col("bytes").alias("kept"), F.col("bytes").cast("string").alias("text"), F.sha2("bytes", 256).alias("kept_sha256"), "extra",
    )
    joined = met.join(spans, ["t1", "t2"], "left").select("doc_id", "bytes", "spans.from", "spans.to", F.col("coded.from").alias("coded_from"), F.col("coded.to").alias("coded_to"), "extra")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                out: list[list] = [[], [], [], [], [], []]
                for own, a, b, c, d in zip(*(part.column(i).to_pylist() for i in range(1, 6)), strict=True):
                    runs = merged([*zip(a or [], b or [], strict=True), *_byte_spans(own, list(zip(c or [], d or [], strict=True)))])
                    edges = [0, *(x for r in runs for x in r), len(own)]
                    pieces = [own[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)]
                    kept = b"".join(pieces)
                    # Piece by piece, so that halves of two characters never make a third one.
                    clean = "".join(x.decode("utf-8", "ignore") for x in pieces) if runs else own.decode("utf-8", "replace")
                    for column, v in zip(out, (len(own), len(own) - len(kept), len(runs), kept, clean, hashlib.sha256(kept).hexdigest()), strict=True):
                        column.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True)), part.column(6)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "text", "kept_sha256", "extra"])

    return whole.unionAll(joined.mapInArrow(cut, f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, text string, kept_sha256 string, extra {kind}"))


def clean_documents(docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text", length: str = "n_chars", words: int = 0) -> DataFrame:
    """The documents without their repeated passages, with the same columns; those that lose all their text go.

    Where a passage begins or ends within a character, what is left of it goes too;
    all else stays as it was. Rows go one by one, whatever their ids. Of rows with
    equal texts of `least` bytes none keeps its text: copies are to be dropped first.
    """
    carry = [c for c in docs.columns if c not in (key, text, length)]
    found = deduplicate(docs.withColumn("_gridlark_had_text", F.col(text).isNotNull()), least, key, text, [*carry, "_gridlark_had_text"], words)
    found = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    out = found.select(F.col("doc_id").alias(key), F.when(F.col("extra._gridlark_had_text"), F.col("text")).alias(text), *(F.col(f"extra.`{c}`").alias(c) for c in carry))
    return out.withColumn(length, F.length(text).cast("long")).select(*docs.columns) if length in docs.columns else out.select(*docs.columns)
