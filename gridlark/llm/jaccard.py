"""N-gram Jaccard join: a size-aware heavy-light join, and the classes that its links make.

Texts are lower-cased (A-Z) and split at ASCII white space; a document's set is
its distinct shingles of `words` words (fewer words: the whole sequence). Two sets
link when den * |A and B| >= num * |A or B|. Equal sets are one node.

Candidates, exactly:
* Light sets (up to `boundary` shingles): two linked sets of n and m shingles
  share at least c(n, m) = ceil(num * (n + m) / (num + den)) of them. For each c
  that occurs, a light set gives the hash of each of its subsets of c shingles;
  two light sets that link give a common one.
* Heavy sets: two sets that link share a shingle among the first
  n - ceil(num * n / den) + 1 of each, in any one order of all shingles. These
  prefixes make inverted lists, scanned with bounds on size and position. The
  order puts frequent shingles last, which keeps lists short. Frequencies are
  counted over all distinct sets, in a table of counters whose size grows with
  the number of documents up to MOST_COUNTERS; shingles that share a counter are
  counted together, which changes the order of both alike and no result. Light
  sets that a heavy one may link with are in the lists too.
* The boundary is the largest size at which giving all subsets costs less than
  scanning the lists, at `list_cost` entries a list.

Linking without all pairs: first, each node is compared with one pivot only, the
head of most lists that it is in. Their links make components. Then the lists
that still hold more than one component are scanned for pairs of different
components; pairs within a component can't change the classes. All comparisons
are of whole sets. Classes are connected components, found without collecting
anything.

Nulls: a null text, like one without words, has an empty set (0 shingles), links
with nothing and is its own class. A null id is the name of a class only if all its
members' ids are null; what a row links with is decided by its text. Rows with equal ids are rows of one document: if their texts
differ, each row goes by its own text. Repeated rows are in one class. An empty
table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import bit_map, drop_staged, has_bit, map_bits, release, scratch, shared_value, small_batches, split_rows, staged, tidy
from gridlark.llm.graph import components

#: Counters of shingles: of 32-bit numbers while they are added up, one byte each (a logarithm) when they are shared.
LEAST_COUNTERS, MOST_COUNTERS, COUNTER_BLOCK = 16, 25, 16
FLUSH = 1 << 22
LIST_COST = 8
CACHE = 300_000
ROWS = 512
SIGNATURE_BITS = 2048
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes, with a bounded table of words."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}

    def word(self, w: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(w)
        if len(self.known) >= CACHE:
            self.known.clear()
        if len(w) <= 64:
            self.known[w] = out
        return out

    def shingles(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        get, own = self.known.get, self.word
        h = np.array([get(w) or own(w) for w in words], np.uint64)
        k = min(self.words, len(h))
        n = len(h) - k + 1
        total = np.full(n, len(h) if len(h) < self.words else self.words, np.uint64)
        for i in range(k):
            total = mix(total + h[i : i + n])
        return np.unique(total)


def node_of(shingles: np.ndarray) -> int:
    """The name of a set: a hash that doesn't depend on order."""
    return int(mix(np.array([mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64)).astype(np.int64)[0])


def shared_least(n: int, m: int, num: int, den: int) -> int:
    """How many shingles linked sets of n and m share at least."""
    return -(-num * (n + m) // (num + den))


def subset_sizes(n: int, boundary: int, num: int, den: int) -> list[int]:
    """The sizes of the subsets that a light set of n gives."""
    low, high = -(-num * n // den), min(boundary, n * den // num)
    return sorted({shared_least(n, m, num, den) for m in range(low, high + 1) if shared_least(n, m, num, den) <= min(n, m)})


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def cost_boundary(num: int, den: int, list_cost: int = LIST_COST) -> int:
    """The largest size up to which subsets are cheaper than lists."""
    n = 1
    while sum(math.comb(n + 1, c) for c in subset_sizes(n + 1, (n + 1) * den // num, num, den)) <= prefix_length(n + 1, num, den) * list_cost:
        n += 1
    return n


def light_keys(shingles: np.ndarray, boundary: int, num: int, den: int) -> np.ndarray:
    """Hashes of the subsets of a light set."""
    x = mix(shingles)
    total, n, out = x.sum(dtype=np.uint64), len(x), []
    for c in subset_sizes(n, boundary, num, den):
        left = [np.uint64(0)] if c == n else [np.add.reduce(x[list(away)], dtype=np.uint64) for away in combinations(range(n), n - c)]
        out.append(mix(total - np.array(left, np.uint64) + np.uint64(c)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def heavy_keys(shingles: np.ndarray, counts: np.ndarray, num: int, den: int) -> np.ndarray:
    """The prefix of a set: its first shingles by frequency, then by hash. counts: the shared table of counters."""
    own = counts[(shingles & np.uint64(len(counts) - 1)).astype(np.int64)]
    return shingles[np.argsort(own, kind="stable")[: prefix_length(len(shingles), num, den)]]


def signature(shingles: np.ndarray) -> bytes:
    """For each of SIGNATURE_BITS classes of hashes, whether the set has an odd number of them: where two signatures differ, so do the sets."""
    odd = np.bincount((shingles % np.uint64(SIGNATURE_BITS)).astype(np.int64), minlength=SIGNATURE_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int64)


def _words(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    return pa.array([_signed(v) for v in values], pa.list_(pa.int64()))


def _shingled(docs: DataFrame, key: str, text: str, words: int, carry: list[str]) -> DataFrame:
    """doc_id, n, node, shingles (as bytes) and extra (a struct of the columns to carry) of every row."""
    extra = F.struct(*(F.col(c) for c in carry)) if carry else F.struct(F.lit(True).alias("none"))
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), extra.alias("extra"))
    kind = source.schema["extra"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(words)
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                sets = [own.shingles(x.as_py()) for x in part.column(1)]
                sizes, nodes = pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, nodes, pa.array([s.tobytes() for s in sets], pa.binary()), part.column(2)], ["doc_id", "n", "node", "shingles", "extra"])
        release()

    return source.mapInArrow(run, f"doc_id bigint, n bigint, node bigint, shingles binary, extra {kind}")


def _named(sets: DataFrame) -> DataFrame:
    """hash (by which the row that stands for a node is known), node, n and shingles of the sets that aren't empty."""
    return sets.where("n > 0").select(F.xxhash64("node", "doc_id").alias("hash"), "node", "n", "shingles")


def _chosen(batches: Iterator[pa.RecordBatch], wanted: Broadcast) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The rows of _named() that the map has, a few hundred at a time, with their sets; it may let some others through."""
    for batch in batches:
        keep = batch.filter(pa.array(has_bit(wanted.value, batch.column(0).to_numpy())))
        for a in range(0, len(keep), ROWS):
            part = keep.slice(a, ROWS)
            yield part, [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column(3)]


def counted_shingles(sets: DataFrame, chosen: Broadcast, rows: int) -> np.ndarray:
    """The counters of all shingles of the chosen rows of _named(), as logarithms of one byte, for so many documents."""
    bits = min(MOST_COUNTERS, max(LEAST_COUNTERS, (64 * max(1, rows) - 1).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            place = np.sort(np.concatenate(held))
            blocks = place >> COUNTER_BLOCK
            edges = np.concatenate([[0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, [len(place)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                found = np.bincount(place[a:b] & ((1 << COUNTER_BLOCK) - 1), minlength=1 << COUNTER_BLOCK).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([int(blocks[a])], pa.int32()), pa.array([zlib.compress(found.tobytes(), 1)], pa.binary())], ["block", "counts"])

        for _, found in _chosen(batches, chosen):
            held.append((np.concatenate(found) & np.uint64((1 << bits) - 1)).astype(np.int32))
            if sum(map(len, held)) >= FLUSH:
                yield from flush()
                held = []
        if sum(map(len, held)):
            yield from flush()
        del held
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.frombuffer(zlib.decompress(raw.as_buffer()), np.uint32)
                own[b] = own[b] + found if b in own else found.astype(np.uint64)
        for b, found in own.items():
            level = np.minimum(255, np.round(8 * np.log2(found + 1.0))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["block", "levels"])

    out = np.zeros(1 << bits, np.uint8)
    parts = max(1, min(64, 1 << (bits - COUNTER_BLOCK)))
    with tidy(sets.sparkSession):
        found = sets.mapInArrow(count, "block int, counts binary").repartition(parts, "block").mapInArrow(add, "block int, levels binary").toArrow()
    for b, raw in zip(found.column("block").to_pylist(), found.column("levels").to_pylist(), strict=True):
        out[b << COUNTER_BLOCK : (b + 1) << COUNTER_BLOCK] = np.frombuffer(raw, np.uint8)
    return out


def _keyed(sets: DataFrame, chosen: Broadcast, counts: Broadcast, num: int, den: int, boundary: int) -> DataFrame:
    """node, n, heavy, light and signature of the chosen rows of _named()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for part, found in _chosen(batches, chosen):
            heavy = [heavy_keys(s, counts.value, num, den) if len(s) * den // num > boundary else none for s in found]
            light = [light_keys(s, boundary, num, den) if len(s) <= boundary else none for s in found]
            marks = pa.array([_words(signature(s)) for s in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), _lists(heavy), _lists(light), marks], ["node", "n", "heavy", "light", "signature"])
        release()

    return sets.mapInArrow(run, "node bigint, n bigint, heavy array<bigint>, light array<bigint>, signature array<bigint>")


def _entries(keyed: DataFrame, repeated: Broadcast | None = None) -> DataFrame:
    """The keys of the nodes: only `token`, or node, n, at and token of those that the map of repeated ones has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for column, ordered in ((2, True), (3, False)):
                lists = batch.column(column)
                tokens, counts = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
                if repeated is None:
                    yield pa.RecordBatch.from_arrays([pa.array(tokens)], ["token"])
                    continue
                row = np.repeat(np.arange(len(batch)), counts)
                at = np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts) if ordered else np.zeros(len(tokens), np.int64)
                hit = np.flatnonzero(has_bit(repeated.value, tokens))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[hit])), batch.column(1).take(pa.array(row[hit])), pa.array(at[hit].astype(np.int32)), pa.array(tokens[hit])], ["node", "n", "at", "token"])

    return keyed.select("node", "n", "heavy", "light").mapInArrow(run, "token bigint" if repeated is None else "node bigint, n bigint, at int, token bigint")


def _may_link(n: Column, m: Column, num: int, den: int) -> Column:
    return (F.least(n, m) * den >= F.greatest(n, m) * num)


def _may_share(a: str, b: str, num: int, den: int) -> Column:
    """The bound by size and place in the list: what can still be shared from here on."""
    left = F.least(F.col(f"{a}n") - F.col(f"{a}at"), F.col(f"{b}n") - F.col(f"{b}at"))
    return _may_link(F.col(f"{a}n"), F.col(f"{b}n"), num, den) & (left * (num + den) >= (F.col(f"{a}n") + F.col(f"{b}n")) * num)


def _whole_sets(sets: DataFrame, chosen: Broadcast) -> DataFrame:
    """node and shingles (an array) of the chosen rows of _named()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _chosen(batches, chosen):
            yield pa.RecordBatch.from_arrays([part.column(1), _lists(found)], ["node", "shingles"])

    return sets.mapInArrow(run, "node bigint, shingles array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("a_set"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("b_set"))
    shared = F.size(F.array_intersect("a_set", "b_set"))
    both = pairs.join(a, "a").join(b, "b").withColumn("shared", shared)
    return both.where(F.col("shared") * den >= (F.size("a_set") + F.size("b_set") - F.col("shared")) * num).select("a", "b")


def linked_rows(docs: DataFrame, words: int, num: int, den: int, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, n, component (null for an empty set) and extra (a struct of the columns to carry) of every row; rows of one class, and no others, have equal components."""
    spark = docs.sparkSession
    with scratch(spark):
        boundary = cost_boundary(num, den)
        rows = docs.count()
        bits = map_bits(rows)
        sets = staged(_shingled(docs, key, text, words, carry or []), "jaccard-sets")
        member = sets.select("doc_id", "n", "node", "extra")
        # One row stands for each node; of wholly repeated rows several may, which only repeats entries.
        reps = staged(sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep")), "jaccard-nodes")
        with shared_value(spark, bit_map(reps.select(F.xxhash64("node", "rep").alias("hash")), "hash", bits)) as chosen:
            with shared_value(spark, counted_shingles(_named(sets), chosen, rows)) as counts:
                keyed = staged(_keyed(_named(sets), chosen, counts, num, den, boundary), "jaccard-keys")
        # Keys that occur once are counted out before anything else about them is shuffled.
        with shared_value(spark, bit_map(_entries(keyed).groupBy("token").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "token", bits)) as repeated:
            entries = staged(_entries(keyed, repeated), "jaccard-entries")
        heads = entries.groupBy("token").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.min(F.struct("at", "n", "node")).alias("head")).where("least <> most")
        heads = staged(heads.select("token", "head"), "jaccard-heads")
        lists = staged(entries.join(heads, "token"), "jaccard-lists")
        drop_staged(entries)
        # Each node and the head of most of its lists.
        scanned = lists.select("node", "n", "at", F.col("head.node").alias("h_node"), F.col("head.n").alias("h_n"), F.col("head.at").alias("h_at")).where("node <> h_node").where(_may_share("", "h_", num, den))
        pivots = scanned.groupBy("node", "h_node").agg(F.count(F.lit(1)).alias("times")).groupBy("node").agg(F.max(F.struct("times", "h_node")).alias("best"))

        def linked(pairs: DataFrame) -> DataFrame:
            """Those of the pairs (a, b) that link, from their whole sets; pairs whose signatures differ in too many places aren't compared."""
            x = keyed.select(F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("signature").alias("a_s"))
            y = keyed.select(F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("signature").alias("b_s"))
            differ = F.aggregate(F.zip_with("a_s", "b_s", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda t, c: t + c)
            whole = F.col("a_n") + F.col("b_n")
            # Linked sets share at least num / (num + den) of `whole`; the rest, twice over, is what they may differ in.
            near = differ * (num + den) <= whole * (den - num)
            pairs = staged(pairs.join(x, "a").join(y, "b").where(near).select("a", "b"), "jaccard-pairs")
            wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
            named = wanted.join(reps, "node").select(F.xxhash64("node", "rep").alias("hash"))
            with shared_value(spark, bit_map(named, "hash", bits)) as picked:
                whole_sets = staged(_whole_sets(_named(sets), picked), "jaccard-whole")
            found = staged(_verified(pairs, whole_sets, num, den), "jaccard-links")
            drop_staged(whole_sets)
            drop_staged(pairs)
            return found

        first = linked(pivots.select(F.col("node").alias("a"), F.col("best.h_node").alias("b")))
        label = components(first)
        # Lists that still hold different components.
        named = lists.select("token", "node", "n", "at").join(label, "node", "left").select("token", "node", "n", "at", F.coalesce("component", "node").alias("component"))
        named = staged(named, "jaccard-named")
        drop_staged(lists)
        mixed = staged(named.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("token"), "jaccard-mixed")
        open_lists = staged(named.join(mixed, "token", "left_semi"), "jaccard-open")
        left = open_lists.select("token", F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("at").alias("a_at"), F.col("component").alias("a_component"))
        right = open_lists.select("token", F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("at").alias("b_at"), F.col("component").alias("b_component"))
        pairs = left.join(right, "token").where(F.col("a_component") < F.col("b_component")).where(_may_share("a_", "b_", num, den)).select("a", "b").distinct()
        label = components(first.unionAll(linked(pairs))).select("node", "component")
        named = member.where("n > 0").join(label, "node", "left").select("doc_id", "n", F.coalesce("component", "node").alias("component"), "extra")
        return staged(named.unionAll(member.where("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("component"), "extra")), "jaccard-classes", keep=True)


def classes(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id of the class) of every row."""
    rows = linked_rows(docs, words, num, den, key, text)
    least = staged(rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")), "jaccard-least")
    inside = rows.where("component is not null").join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return inside.unionAll(rows.where("component is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _row_names(rows: DataFrame, columns: list[str]) -> tuple[Column, Column]:
    """Two hashes of a whole row: what tells rows with equal ids apart."""
    whole = F.struct(*(F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in columns))
    return F.xxhash64(whole), F.xxhash64(F.lit("row"), whole)


def without_near_copies(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents table with one row of each class: that with the least id (null last), of equal ids that with the least hash, of equal rows one.

    Rows go one by one, whatever their ids: a row stays although another with
    its id is a near copy, and rows without id go like others. Rows without words
    all stay. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.columns
    names = ["_gridlark_r1", "_gridlark_r2"]
    marked = docs.select("*", *(c.alias(n) for c, n in zip(_row_names(docs, own), names, strict=True)))
    with scratch(spark):
        rows = linked_rows(marked, words, num, den, key, text, names).where("component is not null")
        # The lowest row of each class. Counting comes first, so that a hot class is one row when it is shuffled.
        name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(f"extra.{names[0]}").alias("r1"), F.col(f"extra.{names[1]}").alias("r2"))
        groups = rows.select("component", name.alias("row")).groupBy("component", "row").agg(F.count(F.lit(1)).alias("copies"))
        groups = staged(groups, "near-rows")
        best = staged(groups.groupBy("component").agg(F.min("row").alias("best")), "near-best")
        judged = staged(groups.join(best, "component").select("row.r1", "row.r2", (F.col("row") != F.col("best")).alias("goes"), "copies").where("goes or copies > 1"), "near-judged", keep=True)
    touched = spark.sparkContext.broadcast(bit_map(judged.select("r1"), "r1", map_bits(docs.count())))
    # Only rows that go, or of which copies go, are shuffled; and a few that the map lets through.
    met, others = split_rows(marked, names[0], touched)
    known = judged.select(F.col("r1").alias(names[0]), F.col("r2").alias(names[1]), F.col("goes").alias("_gridlark_goes"))
    met = met.join(known, names, "left").where("_gridlark_goes is null or not _gridlark_goes")
    alone = met.where("_gridlark_goes is null").select(*(F.col(f"`{c}`") for c in own))
    several = met.where("not _gridlark_goes").groupBy(*names).agg(*(F.first(F.struct(F.col(f"`{c}`"))).alias(f"_gridlark_c{i}") for i, c in enumerate(own)))
    once = several.select(*(F.col(f"_gridlark_c{i}").getField(c).alias(c) for i, c in enumerate(own)))
    return others.select(*(F.col(f"`{c}`") for c in own)).unionAll(alone).unionAll(once)
