"""Benchmark decontamination by template canonicalisation.

Texts are split at white space. A token loses the marks around it and its case;
numbers, quantities, units after a number, and names become typed placeholders
(<num>, <qty>, <unit>, <name>). A name is a capitalised word. Windows of `window`
tokens (shorter items: all their tokens) are joined by hashes of their readings:
* the literal tokens, whatever they are; so whole copies always meet;
* templates of at most `most_slots` placeholders; with more a window whose values
  differ says too little. A capitalised word that begins a sentence, and any of
  an item, is read both as itself and as <name>, in all combinations;
* the template with all names read as themselves, for texts in another case.

Matched windows of a document's row and an item with the same shift are one
alignment. Each run of windows that follow one another counts if what an item's
value stands against is consistent in it: a value that is kept in one place and
changed in another splits the run there, and of a run with a value changed to two
different ones only the windows without changes count. So re-parameterised and
edited questions are found, and mere lists of numbers are not. A document is
contaminated by an item if such a run has at least `run` tokens (or the whole of
a shorter item), or if such runs cover at least `cover` of the item's tokens.

Before the join, a bit map of a fixed size with the hashes of the benchmark's
windows is broadcast and drops windows that can't match; the join is by hash and
Spark splits a window that many documents share.

Nulls: null texts and null ids of items or documents match nothing. Empty texts
have no windows. Repeated items and documents are matched each; rows with equal
ids count as one document. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import bit_map, byte_slices, has_bit, map_bits, release, small_batches, split_rows, staged, text_bytes

WINDOW = 8
MOST_SLOTS = 4
RUN = 13
COVER = 0.5
CACHE = 400_000
BLOCK_BYTES = 1 << 20
PIECE = 1 << 15
MAP_BITS = 26
_U = np.uint64

#: Units of measure that may follow a number.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal ms s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years km/h mph hz khz mhz ghz w kw kwh v a j kj cal kcal pa bar k °c °f % percent meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres mile miles inch inches foot feet yard yards pound pounds ounce ounces dollar dollars euro euros cent cents usd eur gbp".split())

NAME, NUMBER, QUANTITY, UNIT = (xxhash.xxh64_intdigest(x) for x in ("<name>", "<num>", "<qty>", "<unit>"))
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*\Z")
_QUANTITY = re.compile(r"[+-]?\d[\d.,]*([^\W\d_]+|%|°\w)\Z")
_EDGES = re.compile(r"^[^\w$€£+%°-]+|[^\w%°]+$")
LITERAL, IS_NAME, IS_NUMBER, IS_QUANTITY, IS_UNIT, ENDS = 0, 1, 2, 3, 4, 8


class Canonicaliser:
    """Tokens to numbers, with a bounded table of their hashes, flags and plain forms."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.plain: list[str] = []
        self.hashes, self.flags = np.zeros(1 << 12, _U), np.zeros(1 << 12, np.uint8)

    def _new(self, raw: str) -> int:
        """Hash of the literal token; its possible type, plus ENDS if a sentence ends with it."""
        plain = _EDGES.sub("", raw)
        low = plain.lower()
        kind = LITERAL
        if _NUMBER.match(low):
            kind = IS_NUMBER
        elif (m := _QUANTITY.match(low)) and m[1] in UNITS:
            kind = IS_QUANTITY
        elif low in UNITS:
            kind = IS_UNIT
        elif plain[:1].isupper() and plain[1:2].islower():
            kind = IS_NAME
        out = self.known[raw] = len(self.plain)
        self.plain.append(low)
        if out == len(self.hashes):
            self.hashes, self.flags = np.resize(self.hashes, 2 * out), np.resize(self.flags, 2 * out)
        self.hashes[out] = xxhash.xxh64_intdigest(low)
        self.flags[out] = kind | (ENDS if raw[-1:] in ".!?:" or not plain else 0)
        return out

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the texts' tokens, and where each text begins."""
        if len(self.plain) >= CACHE:
            self.__init__()
        words = [t.split() for t in texts]
        known, own = self.known, self._new
        ids = [known[w] if w in known else own(w) for t in words for w in t]
        return np.array(ids, np.int64), np.cumsum([0, *map(len, words)])


def _combined(values: np.ndarray, at: np.ndarray, powers: np.ndarray) -> np.ndarray:
    total = np.zeros(len(at), _U)
    for k, power in enumerate(powers):
        total += values[at + k] * power
    return total


def _mixed(total: np.ndarray) -> np.ndarray:
    total = (total ^ (total >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return total ^ (total >> _U(32))


class Readings:
    """The readings of the tokens of some texts, as window hashes."""

    def __init__(self, own: Canonicaliser, ids: np.ndarray, starts: np.ndarray, item: bool):
        flags = own.flags[ids]
        kind = flags & 7
        begins = np.zeros(len(ids) + 1, bool)
        begins[starts] = True
        begins = begins[:-1]
        first = begins | np.concatenate([[True], (flags[:-1] & ENDS) > 0])[: len(ids)]
        after_number = np.concatenate([[False], kind[:-1] == IS_NUMBER])[: len(ids)] & ~begins
        numeric = ((kind == IS_NUMBER) | (kind == IS_QUANTITY) | ((kind == IS_UNIT) & after_number))
        self.literal = own.hashes[ids]
        self.cased = np.select([kind == IS_NUMBER, kind == IS_QUANTITY, numeric], [_U(NUMBER), _U(QUANTITY), _U(UNIT)], self.literal)
        name = kind == IS_NAME
        #: Names that are read both ways, and those that are always <name>.
        self.either = name if item else name & first
        self.names = name & ~self.either
        self.template = np.where(self.names, _U(NAME), self.cased)
        self.counts = [np.concatenate([[0], np.cumsum(x)]) for x in (numeric, self.names)]
        self.text = np.cumsum(begins)

    def windows(self, size: int, most_slots: int = MOST_SLOTS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts and hashes of the readings of all windows of so many tokens."""
        n, most = len(self.text) - size + 1, max(0, min(most_slots, size - 1))
        if n <= 0 or size <= 0:
            return
        powers = np.multiply.accumulate(np.full(size, 0x9E3779B97F4A7C15, _U))
        places = np.flatnonzero(self.text[:n] == self.text[size - 1 :])
        for first in range(0, len(places), PIECE):
            at = places[first : first + PIECE]
            numeric, names = (c[at + size] - c[at] for c in self.counts)
            yield at, _mixed(_combined(self.literal, at, powers))
            cased = at[(names > 0) & (numeric > 0) & (numeric <= most)]
            yield cased, _mixed(_combined(self.cased, cased, powers))
            few = numeric + names <= most
            at, slots = at[few], (numeric + names)[few]
            total = _combined(self.template, at, powers)
            for k in range(size):
                more = np.flatnonzero(self.either[at + k] & (slots < most))
                name = (_U(NAME) - self.literal[at[more] + k]) * powers[k]
                at, slots, total = np.concatenate([at, at[more]]), np.concatenate([slots, slots[more] + 1]), np.concatenate([total, total[more] + name])
            yield at[slots > 0], _mixed(total[slots > 0])


def _windows(table: DataFrame, key: str, text: str, sizes: list[int] | None, bits: np.ndarray | None, window: int) -> DataFrame:
    """id, row (hash of the text), tokens, at, size, hash and words of windows. Items: of `window` tokens, or all of a shorter one; documents: of these sizes that the bit map has."""
    source = table.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Canonicaliser()
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for first, last in byte_slices(offsets, BLOCK_BYTES if sizes is not None else 0):
                keys, texts = batch.column(0)[first:last].to_pylist(), batch.column(1)[first:last].to_pylist()
                ids, starts = own.tokens(texts)
                readings = Readings(own, ids, starts, sizes is None)
                out: list[list] = [[], [], [], [], [], [], []]
                for size in [min(window, len(ids))] if sizes is None else sizes:
                    for at, found in readings.windows(size):
                        if bits is not None:
                            good = has_bit(bits, found)
                            at, found = at[good], found[good]
                        rows = np.searchsorted(starts, at, side="right") - 1
                        for p, r, h in zip(at.tolist(), rows.tolist(), found.view(np.int64).tolist(), strict=True):
                            value = (keys[r], xxhash.xxh3_64_intdigest(texts[r]) - (1 << 63), int(starts[r + 1] - starts[r]), int(p - starts[r]), size, h, [own.plain[x] for x in ids[p : p + size].tolist()])
                            for column, v in zip(out, value, strict=True):
                                column.append(v)
                if out[0]:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["id", "row", "tokens", "at", "size", "hash", "words"])
        del own
        release()

    return source.mapInArrow(run, "id bigint, row bigint, tokens int, at int, size int, hash bigint, words array<string>")


def accepted(windows: dict[int, tuple[list[str], list[str]]], size: int) -> tuple[list[int], int, bool]:
    """Places of the windows of an alignment (item's and document's words by place) that count, their longest run, and whether nothing is changed in them."""
    places, longest, same = [], 0, True
    order = sorted(windows)
    cuts = [0, *(i for i in range(1, len(order)) if order[i] != order[i - 1] + 1), len(order)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        mine = order[a:b]
        pairs = {p + k: pair for p in mine for k, pair in enumerate(zip(*windows[p], strict=True))}
        changed: dict[str, set[str]] = {}
        for x, y in pairs.values():
            if x != y:
                changed.setdefault(x, set()).add(y)
        # A token of a run may not be further back than this.
        bound, low = {}, -1
        if any(len(y) > 1 for y in changed.values()):
            for q in sorted(pairs):
                low = q if pairs[q][0] != pairs[q][1] else low
                bound[q] = low
        else:
            last: dict[tuple[str, str], int] = {}
            for q in sorted(pairs):
                x, y = pairs[q]
                if x in changed:
                    other = next(iter(changed[x])) if x == y else x
                    low = max(low, last.get((x, other), -1))
                    last[x, y] = q
                bound[q] = low
        for p in mine:
            if bound[p + size - 1] < p:
                places.append(p)
                same = same and windows[p][0] == windows[p][1]
                longest = max(longest, p + size - max(mine[0], bound[p + size - 1] + 1))
    return places, longest, same


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [accepted({w["item_at"]: (w["item_words"], w["words"]) for w in ws}, size) for size, ws in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
        columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.list_(pa.int32()), pa.int32(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], *columns], ["doc_id", "item_id", "item_row", "item_tokens", "size", "places", "run_tokens", "same"])


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, run: int = RUN, cover: float = COVER) -> DataFrame:
    """doc_id, item_id, n_windows, run_tokens, covered_tokens, item_tokens and kind (verbatim or reparameterised) of every contaminated document and item."""
    known = _windows(items, item_key, item_text, None, None, window).select(F.col("id").alias("item_id"), F.col("row").alias("item_row"), F.col("tokens").alias("item_tokens"), F.col("at").alias("item_at"), "size", "hash", F.col("words").alias("item_words"))
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())
    bits = bit_map(known, "hash", MAP_BITS)
    found = _windows(docs, key, text, sizes, bits, window).select(F.col("id").alias("doc_id"), "row", "at", "size", "hash", "words")
    met = found.join(known, ["hash", "size"]).withColumn("shift", F.col("at") - F.col("item_at"))
    item = ["doc_id", "item_id", "item_row", "item_tokens", "size"]
    aligned = met.groupBy(*item, "row", "shift").agg(F.collect_set(F.struct("item_at", "item_words", "words")).alias("windows"))
    judged = aligned.select(*item, "windows").mapInArrow(_judged, "doc_id bigint, item_id bigint, item_row bigint, item_tokens int, size int, places array<int>, run_tokens int, same boolean")
    by_item = judged.where(F.size("places") > 0).groupBy(*item).agg(
        F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"), F.max("run_tokens").alias("run_tokens"), F.min("same").alias("same"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("size") - 1)))))
    by_item = by_item.withColumn("covered_tokens", covered)
    enough = (F.col("run_tokens") >= F.least(F.lit(run), F.col("item_tokens"))) | (F.col("covered_tokens") >= cover * F.col("item_tokens"))
    return by_item.where(enough).select(
        "doc_id", "item_id", F.size("places").alias("n_windows"), "run_tokens", "covered_tokens", "item_tokens", F.when(F.col("same"), "verbatim").otherwise("reparameterised").alias("kind"),
    )


def without_items(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents table without the rows whose text holds an item; rows are told apart by their texts, not by ids, and null texts stay."""
    name = "_gridlark_text"
    small_batches(docs.sparkSession)
    marked = docs.select("*", F.xxhash64(F.col(text)).alias(name))
    found = staged(contaminated(marked.where(F.col(text).isNotNull()), items, key=name, text=text, **options).select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    met, others = split_rows(marked, name, docs.sparkSession.sparkContext.broadcast(bit_map(found, name, map_bits(docs.count()))))
    return others.unionAll(met.join(found, name, "left_anti").select(*marked.columns)).drop(name)
