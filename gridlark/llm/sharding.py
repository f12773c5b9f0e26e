"""Sharding by longest-processing-time scheduling of groups that stay together.

Rows with equal texts are a group. Groups are summed up by text digest before
anything else, so a hot group is one row. All groups, sorted by size, largest
first, ties by digest, go one after the other to the least-loaded shard of a heap.

Groups of one size are a class, and only classes come to the driver: sizes and
how many groups have them. Sizes that differ add up to at least half the square
of their number, so there are at most sqrt(2 * bytes) classes, whatever the
number of groups. In a class each group adds the same to its shard; so from when
the heap's loads lie within one size of each other the shards take turns, and
before that more and more of them do. A class's schedule is thus a few turns:
from its n-th group on these shards in this order, again and again. Groups are
numbered within their class by digest and look their shard up; the placement is
that of the heap over all groups, group by group.

Slots number the rows of a shard without gaps: rows are counted by shard and by
a cell of their digest and id, cells are numbered on, and only within a cell is
there a window.

Nulls: a null text has no bytes (size 1), a null checksum, and all null texts are
one group, apart from the empty text's. A null id is a row like any other. Equal
rows get slots of their own. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlark.llm.common import staged

CELLS = 1024


def longest_processing_time(classes: list[tuple[int, int]], shards: int) -> dict[int, list[tuple[int, list[int]]]]:
    """(size, how many groups) classes to turns by size: (first group, shards in order).

    The same as giving each group, by size, largest first, to the least-loaded
    shard, ties to the first; a class takes as many steps as shards, not as groups.
    """
    heap = [(0, s) for s in range(shards)]
    out: dict[int, list[tuple[int, list[int]]]] = {}
    for size, many in sorted(classes, reverse=True):
        lowest = heap[0][0]
        # A shard takes part from the round on in which the lowest have come up to it.
        waiting = sorted(((load - lowest) // size, (load - lowest) % size, s) for load, s in heap)
        loads = {s: load for load, s in heap}
        turns, active, at, done = [], [], 0, 0
        while done < many:
            begin = waiting[at][0]
            while at < len(waiting) and waiting[at][0] == begin:
                active.append(waiting[at][1:])
                at += 1
            order = [s for _, s in sorted(active)]
            rounds_left = waiting[at][0] - begin if at < len(waiting) else None
            take = many - done if rounds_left is None else min(many - done, rounds_left * len(order))
            turns.append((done, order))
            for i, s in enumerate(order):
                loads[s] += size * (take // len(order) + (i < take % len(order)))
            done += take
        heap = [(load, s) for s, load in loads.items()]
        heapq.heapify(heap)
        out[size] = turns
    return out


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, slot of every row."""
    spark = docs.sparkSession
    raw = F.col(text).cast("binary")
    digest = F.when(F.col(text).isNull(), F.lit(b"")).otherwise(F.unhex(F.sha2(raw, 256)))
    rows = staged(docs.select(
        F.col(key), (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), digest.alias("digest"),
    ), "shard-rows")
    groups = staged(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "shard-groups")
    # By the digest's first byte: a class's cells follow one another in the order of digests.
    groups = groups.withColumn("cell", F.substring(F.hex("digest"), 1, 2))
    counts = staged(groups.groupBy("bytes", "cell").agg(F.count(F.lit(1)).alias("n")), "shard-counts")
    classes = [(r["bytes"], r["n"]) for r in counts.groupBy("bytes").agg(F.sum("n").alias("n")).toLocalIterator()]
    turns = [(size, [(first, order) for first, order in found]) for size, found in longest_processing_time(classes, shards).items()]
    plan = staged(spark.createDataFrame(turns, "bytes long, turns array<struct<first: long, shards: array<int>>>"), "shard-plan")
    before = F.sum("n").over(Window.partitionBy("bytes").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = staged(counts.withColumn("before", F.coalesce(before, F.lit(0))).select("bytes", "cell", "before"), "shard-starts")
    # A class has at most 257 cells, and a cell of a class is numbered by a window of its own.
    nth = F.row_number().over(Window.partitionBy("bytes", "cell").orderBy("digest")) - 1
    numbered = staged(groups.withColumn("nth", nth), "shard-numbered").join(starts, ["bytes", "cell"]).join(plan, "bytes")
    at = F.col("before") + F.col("nth")
    turn = F.element_at(F.filter("turns", lambda t: t["first"] <= at), -1)
    shard = F.element_at(turn["shards"], (F.pmod(at - turn["first"], F.size(turn["shards"])) + 1).cast("int"))
    placed = staged(numbered.select("digest", shard.alias("shard")), "shard-placed")
    found = rows.join(placed, "digest").withColumn("cell", F.pmod(F.xxhash64(key, "digest"), F.lit(CELLS)).cast("int"))
    found = staged(found, "shard-found")
    # Shards times CELLS counts, whatever the input.
    sums = {(r["shard"], r["cell"]): r["n"] for r in found.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    firsts, at_slot, last = [], 0, None
    for s, c in sorted(sums):
        at_slot = 0 if s != last else at_slot
        firsts.append((s, c, at_slot))
        at_slot, last = at_slot + sums[s, c], s
    start_rows = spark.createDataFrame(firsts, "shard int, cell int, start bigint")
    within = Window.partitionBy("shard", "cell").orderBy(key, "digest")
    return (
        found.withColumn("nth", F.row_number().over(within) - 1).join(F.broadcast(start_rows), ["shard", "cell"], "left")
        .select(F.col(key), "size", "text_crc32", "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot"))
    )
