"""Nearest neighbours by largest inner product: collision counting over sorted projections.

Vectors get one more component, so that all have the length of the longest; the
largest inner product is then the smallest distance. Each of at least 128
directions (random rotations, fixed seed) is one hash: a sorted array of all
projections. A query's windows are centred on its own projections, and in a
sorted array a window is a run of ranks. A vector collides with the query in a
direction if its rank lies within the window; a vector that collides in at least
`threshold` of all directions is a candidate and is verified by its exact inner
product. While there are fewer candidates than MANY for each neighbour asked for
and `share` of the rows, all windows grow by the same factor (virtual rehashing).
At their widest they hold all rows, so there is no cap. Windows begin where
most queries asked before them ended, so that few rounds are needed.

Directions are counted in two parts: rows that collide in too few of the first
ones to be likely to reach the threshold aren't counted in the others. That, like the
hashing, costs recall, not scores; recall is measured in the tests.

Rows and queries are dealt into blocks of bounded size by a hash; each block of
queries meets each block of rows once, where the rows' arrays are sorted for up to
8192 queries, and of each such meeting only the `k` best per query go on. Nothing
about the rows is collected but their number and greatest length.

Nulls and others that take no part: null, empty and zero vectors, vectors with a
null or non-finite component, rows with a null id, and vectors whose number of
components isn't the most frequent one. Equal vectors tie and go by id; a row
with the query's own id is never its neighbour. Rows with equal ids and equal
vectors are one row; of an id with several vectors each is a row, and as a query
each has a list of its own (query_row, a hash of the vector, tells them apart).
Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIRECTIONS = 128
THRESHOLD = 0.75
SHARE = 0.02
MANY = 8
#: The directions counted first, and the part of them in which a row must collide to be counted in the others.
EARLY, EARLY_THRESHOLD = 32, 0.6
FIRST, GROWTH = 1.0, 1.03
#: At most 65535 rows, whose ranks are 16 bits.
BLOCK_ROWS = 8192
BLOCK_QUERIES = 8192
QUERIES_AT_ONCE = 256
SEED = 11


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def directions(width: int, least: int = DIRECTIONS, seed: int = SEED) -> np.ndarray:
    """Columns of random rotations, at least so many."""
    rng = np.random.default_rng(seed)
    return np.hstack([np.linalg.qr(rng.normal(size=(width, width)))[0] for _ in range(-(-least // width))])


def _stack(table: pa.Table, width: int) -> np.ndarray:
    return table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


class SortedProjections:
    """A block of rows, hashed in all directions: a sorted array for each, and each row's rank in it."""

    def __init__(self, rows: np.ndarray, longest: float):
        self.longest = longest
        self.turn = directions(rows.shape[1] + 1)
        rest = np.sqrt(np.maximum(longest**2 - (rows**2).sum(axis=1), 0))
        hashed = np.ascontiguousarray((np.hstack([rows, rest[:, None]]) @ self.turn).T)
        order = np.argsort(hashed, axis=1, kind="stable")
        self.arrays = np.take_along_axis(hashed, order, axis=1)
        ranks = np.empty(order.shape, np.uint16)
        np.put_along_axis(ranks, order, np.broadcast_to(np.arange(len(rows), dtype=np.uint16), order.shape), axis=1)
        #: Ranks in the first directions, by direction, and in the others, by row.
        self.early, self.late = ranks[:EARLY].copy(), np.ascontiguousarray(ranks[EARLY:].T)

    def centres(self, queries: np.ndarray) -> np.ndarray:
        size = np.sqrt((queries**2).sum(axis=1))
        return (queries * (self.longest / size)[:, None]) @ self.turn[:-1]

    def windows(self, centres: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First ranks and numbers of ranks of the windows, by query and direction."""
        lo = np.stack([np.searchsorted(a, c - reach) for a, c in zip(self.arrays, centres.T, strict=True)], axis=1)
        hi = np.stack([np.searchsorted(a, c + reach, side="right") for a, c in zip(self.arrays, centres.T, strict=True)], axis=1)
        return lo.astype(np.uint16), (hi - lo).astype(np.uint16)

    def colliding(self, lo: np.ndarray, wide: np.ndarray, threshold: float) -> np.ndarray:
        """Rows that lie in at least this part of a query's windows; below a window the difference of ranks wraps around to a large number."""
        within = (self.early - lo[:EARLY, None]) < wide[:EARLY, None]
        early = np.add.reduce(within.view(np.uint8), axis=0, dtype=np.uint8)
        likely = np.flatnonzero(early >= math.ceil(EARLY_THRESHOLD * EARLY))
        within = (self.late[likely] - lo[EARLY:]) < wide[EARLY:]
        total = early[likely].astype(np.int32) + np.count_nonzero(within, axis=1)
        return likely[total >= math.ceil(threshold * len(lo))]


def search_block(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, longest: float, share: float = SHARE, threshold: float = THRESHOLD, verified: list[int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, ids, scores) of the k best found in this block, for each query. verified: gets how many rows each query was compared with."""
    n, width = rows.shape
    index = SortedProjections(rows, longest)
    wanted = min(n, MANY * k + math.ceil(share * n))
    base, widest = FIRST * longest * math.sqrt(2 / (width + 1)), 2.5 * longest
    ended: list[float] = []
    for first in range(0, len(queries), QUERIES_AT_ONCE):
        live = np.arange(first, min(first + QUERIES_AT_ONCE, len(queries)))
        centres = index.centres(queries[live])
        reach = np.full(len(live), float(np.quantile(ended, 0.1)) if len(ended) >= 8 else base)
        while len(live):
            lo, wide = index.windows(centres, reach)
            waiting = []
            for at, i in enumerate(live.tolist()):
                found = np.arange(n) if wanted >= n or reach[at] >= widest else index.colliding(lo[at], wide[at], threshold)
                if len(found) < wanted:
                    waiting.append(at)
                    continue
                ended.append(float(reach[at]))
                found = found[ids[found] != query_ids[i]]
                if verified is not None:
                    verified.append(len(found))
                score = (rows[found] * queries[i]).sum(axis=1)
                if len(found) > k:
                    edge = np.partition(score, len(score) - k)[len(score) - k]
                    keep = score >= edge
                    found, score = found[keep], score[keep]
                best = np.lexsort((ids[found], -score))[:k]
                yield i, ids[found][best], score[best]
            live, centres, reach = live[waiting], centres[waiting], reach[waiting] * GROWTH


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score and query_row of the k nearest found of every query among all rows."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    kinds = rows.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("int")).alias("queries"), F.max(squares).alias("longest")).orderBy(F.desc("n"), "width").limit(1).collect()
    out = "query_id bigint, query_row bigint, vec_id bigint, score double"
    if not kinds:
        empty = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double, query_row bigint")
        return empty
    width, longest = kinds[0].width, math.sqrt(kinds[0].longest)
    blocks, query_blocks = -(-kinds[0].n // BLOCK_ROWS), max(1, -(-kinds[0].queries // BLOCK_QUERIES))
    name = F.xxhash64("vector")
    rows = rows.where(F.size("vector") == width).withColumn("row", name).dropDuplicates(["id", "row"])
    deal = F.xxhash64("id", "row")
    data = rows.select("id", "vector", F.pmod(deal, F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("part"))
    asked = rows.where("q").select("id", "vector", "row", F.pmod(deal, F.lit(query_blocks)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        names, kinds = right.column("id").to_numpy(), right.column("row").to_numpy()
        if len(left) and len(right):
            found = list(search_block(left.column("id").to_numpy(), _stack(left, width), names, _stack(right, width), k, longest, share))
        place = np.repeat(np.array([q for q, _, _ in found], np.int64), [len(i) for _, i, _ in found])
        ids = np.concatenate([i for _, i, _ in found]) if found else np.zeros(0, np.int64)
        scores = np.concatenate([s for _, _, s in found]) if found else np.zeros(0)
        return pa.table({"query_id": names[place], "query_row": kinds[place], "vec_id": ids, "score": scores})

    best = data.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(run, out)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_row")
