"""Run-length index of a block of strings: which of their windows occur again.

The strings of a block are joined with separators. A suffix array by prefix
doubling gives the Burrows-Wheeler transform; of it only the runs are kept, with
the suffixes at their starts and ends (the sampled run ends) and the length that
each shares with its neighbour outside the run. Within a run these lengths
follow from one another: in text order each is at least the one before less
one. So one pass over the text, from sample to sample, streams the matching
statistics: for each place the longest match that starts anywhere else.
"""

from __future__ import annotations

import numpy as np

#: Symbols of the first key: 9 bits each, in 63 bits.
PACKED = 7
#: Symbols, and pairs of suffixes, that are compared at once.
COMPARED, PAIRS = 32, 1 << 15


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and each one's rank."""
    order = np.argsort(key)
    ordered = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    return order, rank


class RunLengthIndex:
    """See the module's text."""

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        n = int(self.starts[-1])
        text = np.zeros(n, np.int64)
        joined = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
        text[:] = joined
        text += 1
        text[self.starts[1:] - 1] = 0
        self.n, self.sizes = n, sizes
        longest = int(sizes.max(initial=0)) + 1
        key = np.zeros(n, np.int64)
        for k in range(min(PACKED, n)):
            key[: n - k] |= text[k:] << (9 * (PACKED - 1 - k))
        order, rank = _dense(key)
        width = PACKED
        while width < longest:
            after = np.zeros(n, np.int64)
            if width < n:
                after[: n - width] = rank[width:] + 1
            order, rank = _dense(rank * (n + 2) + after)
            width *= 2
        del rank, key
        self._sample(order, text)

    def _sample(self, order: np.ndarray, text: np.ndarray) -> None:
        """Keep of the transform's runs the suffixes at their starts and ends, with what those share with the row beyond.

        The first suffix of each string is a run of its own, so that what follows from a sample stays within its string.
        """
        bwt = text[order - 1]
        change = np.flatnonzero((bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)) + 1
        self.runs = len(change) + 1
        a, b = order[change - 1], order[change]
        shared = self._shared(a, b, text)
        # A suffix at a run's start, with the row before; at a run's end, with the row after.
        self.start_suffix, self.start_shared = b, shared
        self.end_suffix, self.end_shared = a, shared

    def _shared(self, a: np.ndarray, b: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Length of the common prefix of these suffixes, within their strings."""
        padded = np.concatenate([text, np.zeros(COMPARED, np.int64)]).astype(np.int16)
        out = np.zeros(len(a), np.int64)
        ahead = np.arange(COMPARED)
        for first in range(0, len(a), PAIRS):
            live = np.arange(first, min(first + PAIRS, len(a)))
            while len(live):
                x, y = padded[(a[live] + out[live])[:, None] + ahead], padded[(b[live] + out[live])[:, None] + ahead]
                other = (x != y) | (x == 0)
                stop = other.any(axis=1)
                out[live] += np.where(stop, other.argmax(axis=1), COMPARED)
                live = live[~stop]
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each place the length of the longest match that starts anywhere else in the block."""
        reach = np.full(self.n, -1, np.int64)
        np.maximum.at(reach, self.start_suffix, self.start_shared + self.start_suffix)
        np.maximum.at(reach, self.end_suffix, self.end_shared + self.end_suffix)
        return np.maximum.accumulate(reach) - np.arange(self.n)

    def repeated(self, least: int) -> list[np.ndarray]:
        """For each string, which of its windows of `least` bytes occur again in the block."""
        lengths = self.matching_statistics()
        out = []
        for start, size in zip(self.starts[:-1].tolist(), self.sizes.tolist(), strict=True):
            out.append(lengths[start : start + max(0, size - least + 1)] >= least)
        return out
