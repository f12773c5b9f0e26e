"""Byte-level BPE by a deterministic tokenization automaton.

The automaton reads token labels. It starts as one state with a loop for each
base byte. The merges are then applied in order, each by the same gadget. For
merge m = (u, v) -> w: the state that u leads to is cloned without its v arc and
u leads to the clone from now on; every state with a u arc gets a w arc to where
v led. What the finished automaton accepts is exactly the set of correct
tokenizations, one for each byte string.

The automaton is compiled once, on the driver, and shipped as arrays. A state is
that of the last label read, and is stored as its difference to the state that
it was cloned from: the merge at which it was cloned, and its lost arcs, each
with the merge since which it is lacking (`lost`). The labels are a tree over
bytes (`steps`, `spelled`). Reading a word, each place is
reached by exactly one arc, as each beginning of a word has one correct
tokenization; so the words of a batch are encoded together, byte by byte, by
look-ups in these arrays, and nothing is tried twice. Labels that no state has
an arc with are left out of the tree.

Nulls: a null text is an empty text, with no ids. Empty texts give no ids.
Repeated rows are encoded each. Special tokens of the vocabulary that stand in a
text become their id, as the library does.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridlark.llm.common import byte_slices, release, small_batches, text_bytes

#: Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts below U+0250, with the classes written out: letters, numbers and white space there.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Words kept with their ids in each worker; a full pool starts anew.
POOL_WORDS = 1 << 18
BATCH_BYTES = 2_000_000
#: Words of more bytes are read one by one, in pieces.
LONG = 64
LONG_PIECE = 1 << 16


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in public byte-level vocabularies: printable Latin-1 as itself, the others from U+0100 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_vocabulary(path: str) -> dict:
    """Labels (bytes by id), merges (pairs of ids, with the id they make) and special tokens of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = byte_alphabet()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    vocab = spec["model"]["vocab"]
    labels = {i: bytes(back[c] for c in token) for token, i in vocab.items() if token not in special}
    merges = []
    for pair in spec["model"]["merges"]:
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merges.append((vocab[a], vocab[b], vocab[a + b]))
    return {"labels": labels, "merges": merges, "special": special}


class Table:
    """Numbers by key (0 or more), in an open hash table of arrays; -1 for keys that it lacks."""

    def __init__(self, found: dict[int, int]):
        keys, values = np.array(list(found), np.int64), np.array(list(found.values()), np.int32)
        self.bits = max(4, (3 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot, live = self._slot(keys), np.arange(len(keys))
        while len(live):
            free = live[self.keys[slot[live]] < 0]
            self.keys[slot[free]] = keys[free]
            own = self.keys[slot[live]] == keys[live]
            self.values[slot[live[own]]] = values[live[own]]
            live = live[~own]
            slot[live] = (slot[live] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], -1)
        live = np.flatnonzero((found != key) & (found >= 0))
        while len(live):
            slot[live] = (slot[live] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[live]]
            hit = found == key[live]
            out[live[hit]] = self.values[slot[live[hit]]]
            live = live[~hit & (found >= 0)]
        return out


class Automaton:
    """The compiled automaton, as arrays that are built once and shipped. See the module's text."""

    def __init__(self, vocabulary: dict):
        labels: dict[int, bytes] = vocabulary["labels"]
        merges = vocabulary["merges"]
        self.special: dict[str, int] = vocabulary["special"]
        self.top = max([*labels, *self.special.values()], default=-1) + 1
        #: The merge that made a label (-1 for bytes), its parts, and whether any state has an arc with it.
        self.born = np.full(self.top, -1, np.int32)
        self.left, self.right = np.full(self.top, -1, np.int32), np.full(self.top, -1, np.int32)
        self.alive = np.array([len(labels.get(i, b"")) == 1 for i in range(self.top)], bool)
        for m, (u, v, w) in enumerate(merges):
            self.born[w], self.left[w], self.right[w] = m, u, v
        self._glue(merges)
        named = [labels.get(i, b"") for i in range(self.top)]
        for text, i in self.special.items():
            named[i] = text.encode()
        #: What each arc spells, and its bytes.
        self.arcs = pa.array(named, pa.large_binary())
        self.sizes = np.array([len(x) for x in named], np.int64)
        self._trie({i: label for i, label in labels.items() if self.alive[i]})

    def _glue(self, merges: list[tuple[int, int, int]]) -> None:
        """Apply the merge gadgets one after the other: which states lose which arc, and which labels get arcs."""
        born, left, right = self.born.tolist(), self.left.tolist(), self.right.tolist()
        alive = self.alive.tolist()
        lost: dict[int, int] = {}

        def has(token: int, label: int, when: int) -> bool:
            while True:
                if lost.get(token << 20 | label, when) < when:
                    return False
                if born[token] > born[label]:
                    when = min(when, born[token])
                    token = right[token]
                elif born[label] < 0:
                    return True
                elif not alive[label]:
                    return False
                else:
                    when = born[label] + 1
                    label = left[label]

        for m, (u, v, w) in enumerate(merges):
            alive[w] = has(u, v, m)
            if alive[w]:
                lost[u << 20 | v] = m
        self.alive = np.array(alive, bool)
        #: By state's label and lost label: the merge since which the state lacks that arc.
        self.lost = Table(lost)

    def _trie(self, labels: dict[int, bytes]) -> None:
        """The labels as a tree over bytes: where arcs (node << 8 | byte) lead, and each node's label."""
        children: dict[int, int] = {}
        ends = {}
        for i, label in labels.items():
            node = 0
            for byte in label:
                node = children.setdefault(node << 8 | byte, len(children) + 1)
            ends[node] = i
        self.steps = Table(children)
        self.spelled = np.full(len(children) + 1, -1, np.int32)
        for node, i in ends.items():
            self.spelled[node] = i

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Where the tree's arcs lead; -1 where there is none."""
        return self.steps.get(node.astype(np.int64) << 8 | byte)

    def has_arc(self, token: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Does the state after each token have an arc with this label? A token below 0 is the first state.

        The state is looked up as differences: what it lost itself, then what the
        state lost that it was cloned from, back to the label's own time; then the
        same for the label's left part.
        """
        out = token < 0
        live = np.flatnonzero(~out)
        token, label = token[live], label[live]
        when = np.full(len(live), np.iinfo(np.int32).max, np.int32)
        while len(live):
            since = self.lost.get(token.astype(np.int64) << 20 | label)
            stays = (since < 0) | (since >= when)
            age, other = self.born[token], self.born[label]
            younger = age > other
            out[live[stays & ~younger & (other < 0)]] = True
            go = np.flatnonzero(stays & (younger | (other >= 0)))
            live, token, label, when, age, other, younger = (x[go] for x in (live, token, label, when, age, other, younger))
            when = np.where(younger, np.minimum(when, age), other + 1)
            token, label = np.where(younger, self.right[token], token), np.where(younger, label, self.left[label])
        return out

    def paths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each byte of these words the label of the only arc that ends right after it, on the word's path or that of its beginning.

        All words are read at once. A place is reached by one path only, since each
        beginning of a word has one correct tokenization; so nothing is tried twice.
        """
        reach = np.full(len(data), -1, np.int32)
        live = np.arange(len(starts))
        k = 0
        while len(live):
            place = starts[live] + k
            if k and (reach[place - 1] < 0).any():
                raise ValueError("the vocabulary lacks a byte of a word")
            token = reach[place - 1] if k else np.full(len(live), -1, np.int32)
            node, at, stop = np.zeros(len(live), np.int32), place, ends[live]
            while len(at):
                node = self.step(node, data[at])
                go = np.flatnonzero(node >= 0)
                node, at, stop, token = node[go], at[go], stop[go], token[go]
                label = self.spelled[node]
                named = np.flatnonzero(label >= 0)
                hit = named[self.has_arc(token[named], label[named])]
                reach[at[hit]] = label[hit]
                at = at + 1
                go = np.flatnonzero(at < stop)
                node, at, stop, token = node[go], at[go], stop[go], token[go]
            k += 1
            live = live[starts[live] + k < ends[live]]
        return reach

    def _labels_at(self, data: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All labels that start in [first, last): their starts, in order, ends and names."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        start = np.arange(first, last)
        node, at = np.zeros(len(start), np.int32), start
        while len(at):
            node = self.step(node, data[at])
            go = np.flatnonzero(node >= 0)
            node, at, start = node[go], at[go] + 1, start[go]
            named = np.flatnonzero(self.spelled[node] >= 0)
            found.append((start[named], at[named], self.spelled[node[named]]))
            go = np.flatnonzero(at < len(data))
            node, at, start = node[go], at[go], start[go]
        starts, ends, names = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((ends, starts))
        return starts[order], ends[order], names[order]

    def long_path(self, data: np.ndarray) -> np.ndarray:
        """The same as paths() for one long word, place by place; the arcs that a piece of it may need are looked up together."""
        reach = [-1] * (len(data) + 1)
        for first in range(0, len(data), LONG_PIECE):
            last = min(first + LONG_PIECE, len(data))
            starts, ends, names = self._labels_at(data, first, last)
            edges = np.searchsorted(starts, np.arange(first, last + 1))
            inside = np.flatnonzero(ends < last)
            a, b = edges[ends[inside] - first], edges[ends[inside] - first + 1]
            after = np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange(int((b - a).sum()))
            pairs = np.unique(np.repeat(names[inside], b - a).astype(np.int64) << 20 | names[after])
            known = dict(zip(pairs.tolist(), self.has_arc((pairs >> 20).astype(np.int32), (pairs & 0xFFFFF).astype(np.int32)).tolist(), strict=True))
            marks, stops, labels = edges.tolist(), ends.tolist(), names.tolist()
            for at in range(first, last):
                token = reach[at]
                if at and token < 0:
                    raise ValueError("the vocabulary lacks a byte of a word")
                for i in range(marks[at - first], marks[at - first + 1]):
                    label = labels[i]
                    if at and (found := known.get(key := token << 20 | label)) is None:
                        found = known[key] = bool(self.has_arc(np.array([token], np.int32), np.array([label], np.int32))[0])
                    if not at or found:
                        reach[stops[i]] = label
        return np.array(reach[1:], np.int32)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has."""
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        reach = np.full(len(data), -1, np.int32)
        # Words of like lengths are read together.
        for low, high in ((1, 16), (17, LONG)):
            mine = np.flatnonzero((sizes >= low) & (sizes <= high))
            stop = np.cumsum(sizes[mine])
            own = np.repeat(ends[mine] - stop, sizes[mine]) + np.arange(int(sizes[mine].sum()))
            reach[own] = self.paths(data[own], stop - sizes[mine], stop)
        for i in np.flatnonzero(sizes > LONG).tolist():
            reach[starts[i] : ends[i]] = self.long_path(data[starts[i] : ends[i]])
        # Back from each word's end, label by label.
        on = np.zeros(len(data), bool)
        live = np.flatnonzero(sizes > 0)
        at = ends[live] - 1
        while len(at):
            if (reach[at] < 0).any():
                raise ValueError("the vocabulary lacks a byte of a word")
            on[at] = True
            at = at - self.sizes[reach[at]]
            go = at >= starts[live]
            live, at = live[go], at[go]
        total = np.concatenate([[0], np.cumsum(on)])
        return reach[on], total[ends] - total[starts]


class _Pool(dict):
    """Words and their places; a word that isn't in it gets the next one."""

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        return place


class Encoder:
    """Whole texts to ids and back, with a bounded pool of words."""

    def __init__(self, automaton: Automaton):
        import regex

        self.automaton = automaton
        self.split_any = regex.compile(PATTERN).findall
        self.split_latin = re.compile(LATIN_PATTERN).findall
        self.beyond_latin = re.compile("[^\x00-\u024f]").search
        self.decimals = pa.array([b"%d," % i for i in range(automaton.top)], pa.large_binary())
        names = sorted(automaton.special, key=len, reverse=True)
        self.mark = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.clear()

    def clear(self) -> None:
        """Start an empty pool."""
        self.words = _Pool()
        self.ids = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def split(self, text: str) -> list[str]:
        return (self.split_any if self.beyond_latin(text) else self.split_latin)(text)

    def places(self, text: str) -> list[int]:
        """The words of a text, as places in the pool. A special token's place is -1 - its id."""
        special, place = self.automaton.special, self.words.__getitem__
        if self.mark is None or not any(s in text for s in special):
            return list(map(place, self.split(text)))
        out: list[int] = []
        for part in self.mark.split(text):
            if part in special:
                out.append(-1 - special[part])
            else:
                out += map(place, self.split(part))
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these texts, and the n + 1 offsets of each text's."""
        if len(self.words) >= POOL_WORDS or len(self.ids) >= 8 * POOL_WORDS:
            self.clear()
        known = len(self.words)
        places: list[int] = []
        stops = [0]
        for text in texts:
            if text:
                places += self.places(text)
            stops.append(len(places))
        if len(self.words) > known:
            ids, counts = self.automaton.encode([w.encode() for w in islice(self.words, known, None)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
            self.ids = np.concatenate([self.ids, ids])
        at = np.array(places, np.int64)
        own = at < 0
        first = np.where(own, 0, self.ends[np.where(own, 0, at)])
        count = np.where(own, 1, self.ends[np.where(own, -1, at) + 1] - first)
        last = np.cumsum(count)
        total = int(last[-1]) if len(last) else 0
        out = np.concatenate([self.ids, np.zeros(1, np.int32)])[np.minimum(np.repeat(first - (last - count), count) + np.arange(total), len(self.ids))]
        out[last[own] - 1] = -1 - at[own]
        return out, np.concatenate([[0], last])[np.array(stops)]

    def spelled(self, labels: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> Iterator[memoryview]:
        """For each text, the labels that its ids name, one after the other."""
        found = labels.take(pa.array(ids, pa.int32()))
        ends = np.frombuffer(found.buffers()[1], np.int64)[offsets + found.offset].tolist()
        spelled = memoryview(found.buffers()[2] or b"")
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield spelled[a:b]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts that these ids spell: the labels of the automaton's arcs."""
        return [bytes(x).decode("utf-8", "replace") for x in self.spelled(self.automaton.arcs, ids, offsets)]

    def digests(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[list[str], list[str]]:
        """Of each text: SHA-256 of the decimal ids joined by commas, and of the decoded text."""
        hashed = [hashlib.sha256(x[:-1]).hexdigest() for x in self.spelled(self.decimals, ids, offsets)]
        back = [hashlib.sha256(bytes(x).decode("utf-8", "replace").encode()).hexdigest() for x in self.spelled(self.automaton.arcs, ids, offsets)]
        return hashed, back


def encode_texts(docs: DataFrame, vocabulary_path: str, text: str = "text", key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """key, n_tokens, ids (array<int>, if with_ids), ids_sha256 and decoded_sha256 of every whole text.

    The automaton is compiled on the driver and broadcast: arrays of a few MB,
    whose size is that of the vocabulary. Its pool of words goes with its task.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(load_vocabulary(vocabulary_path)))
    source = docs.select(key, text)
    kind = source.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            _, sizes = text_bytes(batch.column(1))
            for a, b in byte_slices(sizes, BATCH_BYTES):
                part = batch.slice(a, b - a)
                ids, offsets = encoder.encode(part.column(1).to_pylist())
                hashed, back = encoder.digests(ids, offsets)
                columns = [part.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(hashed, pa.string()), pa.array(back, pa.string())]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        del encoder
        release()

    return source.mapInArrow(run, out)
