"""Trees as DataFrames: pages by counting prefixes, node boxes, traversal and comparison.

A tree is a table of nodes: node_key, depth, cnt (own rows) and the bounds of
the rows below it. It is made level by level from counts of Z-order prefixes: a
node with at most `page` rows, or at the greatest depth, is a leaf. Counts are
of distinct codes and are added up before each shuffle; rows are touched twice,
to get their code and to get their node.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence
from enum import Enum
from heapq import heappop, heappush

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from gridlark.functions import morton
from gridlark.functions.geometry import BASE_TOLERANCE
from gridlark.functions.morton import ROOT, Grid
from gridlark.operators.filters import domain_of
from gridlark.plans.storage import cut
from gridlark.sources.spec import GeometrySpec

PAGE = 16


class Control(Enum):
    """What a traversal does after a node."""

    TERMINATE = 0
    SKIP_CHILDREN = 1
    CONTINUE = 2


def grid_for(df: DataFrame, spec: GeometrySpec, depth: int | None = None, page: int = PAGE) -> Grid:
    """The domain of a table, cut to a depth that suits its number of rows."""
    domain = domain_of(df, spec)
    if depth is None:
        depth = morton.default_depth(df.count(), page, spec.dims)
    return Grid(list(domain.lo), list(domain.hi), depth)


def with_deep_key(df: DataFrame, spec: GeometrySpec, grid: Grid, loose: bool = True) -> DataFrame:
    """node_key: a point's deepest cell; a box's smallest node, or its loose one."""
    if spec.kind == "point":
        k = morton.point_key(spec.point(), grid)
    else:
        k = morton.loose_key(spec.box(), grid) if loose else morton.box_key(spec.box(), grid)
    return df.withColumn("node_key", k)


def assign_nodes(df: DataFrame, spec: GeometrySpec, grid: Grid, page: int = PAGE, loose: bool = True) -> DataFrame:
    """df with node_key: the node of an adaptive tree that each row belongs to."""
    dims = grid.dims
    rows = with_deep_key(df, spec, grid, loose).withColumnRenamed("node_key", "_deep")
    cells = cut(rows.groupBy("_deep").agg(F.count(F.lit(1)).alias("n"))).withColumn("d", morton.depth_of(F.col("_deep"), dims))
    # Every prefix of every distinct key, with the rows at or below it.
    up = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("d"))))
    prefixes = up.withColumn("prefix", F.call_function("shiftright", F.col("_deep"), (F.col("d") - F.col("level")) * dims))
    small = prefixes.groupBy("prefix", "level").agg(F.sum("n").alias("n")).where((F.col("n") <= page) | (F.col("level") >= grid.depth)).select("prefix")
    # A row stays in the first small node on its way down, or where its own key ends.
    first = prefixes.join(small, "prefix").groupBy("_deep").agg(F.min(F.struct("level", "prefix")).alias("best"))
    placed = cells.select("_deep").join(first, "_deep", "left").select("_deep", F.coalesce(F.col("best.prefix"), F.col("_deep")).alias("node_key"))
    return rows.join(placed, "_deep").drop("_deep")


def node_table(keyed: DataFrame, spec: GeometrySpec, inner: bool = True) -> DataFrame:
    """Nodes of a table with node_key: depth, cnt and bounds; inner nodes too, if asked for, with all rows below in their bounds."""
    dims, b = spec.dims, spec.box()
    bounds = [f for d in range(dims) for f in (F.min(b.lo[d]).alias(f"min{d}"), F.max(b.hi[d]).alias(f"max{d}"))]
    own = keyed.groupBy("node_key").agg(F.count(F.lit(1)).alias("cnt"), *bounds)
    if inner:
        depth = morton.depth_of(F.col("node_key"), dims)
        up = own.withColumn("up", F.explode(F.sequence(F.lit(0), depth)))
        above = up.withColumn("own", F.when(F.col("up") == 0, F.col("cnt")).otherwise(0)).withColumn("node_key", F.call_function("shiftright", F.col("node_key"), F.col("up") * dims))
        names = [f for d in range(dims) for f in (F.min(f"min{d}").alias(f"min{d}"), F.max(f"max{d}").alias(f"max{d}"))]
        own = above.groupBy("node_key").agg(F.sum("own").alias("cnt"), F.sum("cnt").alias("below"), *names)
    return own.withColumn("depth", morton.depth_of(F.col("node_key"), dims))


def compressed(nodes: DataFrame, dims: int) -> DataFrame:
    """A static tree's nodes: inner nodes without rows of their own and with one child go; parent_key skips them."""
    children = nodes.where(F.col("node_key") > ROOT).select(F.shiftright("node_key", dims).alias("node_key")).groupBy("node_key").agg(F.count(F.lit(1)).alias("children"))
    kept = nodes.join(children, "node_key", "left").where((F.coalesce("children", F.lit(0)) != 1) | (F.col("cnt") > 0) | (F.col("node_key") == ROOT)).drop("children")
    kept = cut(kept)
    up = kept.select("node_key", "depth").where("depth > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("depth"))))
    above = up.select(F.col("node_key").alias("child"), F.call_function("shiftright", F.col("node_key"), F.col("k") * dims).alias("node_key"))
    parents = above.join(kept.select("node_key"), "node_key").groupBy(F.col("child").alias("node_key")).agg(F.max("node_key").alias("parent_key"))
    return kept.join(parents, "node_key", "left")


def create(df: DataFrame, spec: GeometrySpec, grid: Grid | None = None, page: int = PAGE, loose: bool = True, static: bool = False) -> tuple[DataFrame, DataFrame, Grid]:
    """(rows with node_key, nodes, grid) of a tree; static: with its chains of single children taken out."""
    grid = grid or grid_for(df, spec, None, page)
    rows = cut(assign_nodes(df, spec, grid, page, loose))
    nodes = node_table(rows, spec)
    return rows, compressed(nodes, grid.dims) if static else nodes, grid


def breadth_first(keyed: DataFrame, spec: GeometrySpec, start: int = ROOT) -> DataFrame:
    """Rows at or below a node, by depth, then by key, then by id."""
    return _below(keyed, spec.dims, start).withColumn("depth", morton.depth_of(F.col("node_key"), spec.dims)).orderBy("depth", "node_key", *spec.key)


def depth_first(keyed: DataFrame, spec: GeometrySpec, depth: int, start: int = ROOT) -> DataFrame:
    """Rows at or below a node, each node before its children."""
    rows = _below(keyed, spec.dims, start).withColumn("depth", morton.depth_of(F.col("node_key"), spec.dims))
    code = F.col("node_key").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("depth") * spec.dims))
    left = F.call_function("shiftleft", code, (F.lit(depth) - F.col("depth")) * spec.dims)
    return rows.withColumn("_left", left).orderBy("_left", "depth", *spec.key).drop("_left")


def _below(keyed: DataFrame, dims: int, start: int) -> DataFrame:
    if start == ROOT:
        return keyed
    up = (morton.depth_of(F.col("node_key"), dims) - (start.bit_length() - 1) // dims) * dims
    return keyed.where((up >= 0) & (F.call_function("shiftright", F.col("node_key"), F.greatest(up, F.lit(0))) == start))


def traverse(nodes: DataFrame, dims: int, visit: Callable[[dict], Control | None], order: str = "breadth", priority: Callable[[dict], float | None] | None = None, start: int = ROOT, most: int = 1_000_000) -> None:
    """Call visit for nodes, as long as it says; a priority of None leaves a node and what is below it out.

    For index pages, not rows: the node table is brought to the driver if it has
    at most `most` nodes.
    """
    if nodes.count() > most:
        raise ValueError("too many nodes for a local traversal")
    by_key = {r["node_key"]: r.asDict() for r in nodes.toLocalIterator()}
    below: dict[int, list[int]] = {}
    for k, node in sorted(by_key.items()):
        up = node["parent_key"] if "parent_key" in node else (k >> dims)
        if k > ROOT and up is not None:
            below.setdefault(up, []).append(k)
    if start not in by_key:
        return
    rank = (lambda n: 0) if priority is None else priority
    first = rank(by_key[start])
    waiting: deque | list = deque() if order != "priority" else []
    if first is not None:
        waiting.append((first, 0, start))
    n = 0
    while waiting:
        if order == "priority":
            _, _, k = heappop(waiting)
        else:
            _, _, k = waiting.popleft() if order == "breadth" else waiting.pop()
        said = visit(by_key[k])
        if said is Control.TERMINATE:
            return
        if said is Control.SKIP_CHILDREN:
            continue
        children = below.get(k, [])
        for c in reversed(children) if order == "depth" else children:
            p = rank(by_key[c])
            if p is None:
                continue
            n += 1
            if order == "priority":
                heappush(waiting, (p, n, c))
            else:
                waiting.append((p, n, c))


def traverse_entities(keyed: DataFrame, nodes: DataFrame, spec: GeometrySpec, visit: Callable[[list, dict], Control | None], order: str = "breadth", priority: Callable[[dict], float | None] | None = None, start: int = ROOT, most: int = 1_000_000) -> None:
    """As traverse(), but visit gets a node's own rows, as a list of their keys in order, and the node (with its bounds).

    Rows come sorted by the place of their node in the traversal, a partition at a
    time, so that the driver holds those of one node and no more; there may be any
    number of them. What visit says only leaves nodes out; it doesn't change the
    order of the others. Rows whose node isn't reached aren't read.
    """
    ranks: dict[int, float | None] = {}

    def rank(node: dict) -> float | None:
        # Asked once for each node, though the traversal is made twice.
        k = node["node_key"]
        if k not in ranks:
            ranks[k] = priority(node)
        return ranks[k]

    asked = None if priority is None else rank
    places: dict[int, int] = {}
    traverse(nodes, spec.dims, lambda node: places.__setitem__(node["node_key"], len(places)), order, asked, start, most)
    if not places:
        return
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(spec.key)]
    keys = [f"_k{i}" for i in range(len(named))]
    at = keyed.sparkSession.createDataFrame(list(places.items()), "node_key long, _place long")
    rows = iter(keyed.select("node_key", *named).join(at, "node_key").select("_place", *keys).orderBy("_place", *keys).toLocalIterator())
    first: Row | None = next(rows, None)
    one = len(keys) == 1
    named_row = Row(*spec.key)

    def handed(node: dict) -> Control | None:
        nonlocal first
        place, own = places[node["node_key"]], []
        while first is not None and first[0] <= place:
            if first[0] == place:
                own.append(first[1] if one else named_row(*first[1:]))
            first = next(rows, None)
        return visit(own, node)

    traverse(nodes, spec.dims, handed, order, asked, start, most)


def is_equal(rows_a: DataFrame, nodes_a: DataFrame, rows_b: DataFrame, nodes_b: DataFrame, spec: GeometrySpec, tolerance: float = BASE_TOLERANCE) -> bool:
    """Same nodes, with the same rows and, to within the tolerance, the same geometry of each row and bounds of each node."""
    keys = ["node_key", *spec.key]
    geometry = spec.point() if spec.kind == "point" else [*spec.box().lo, *spec.box().hi]
    a, b = (rows.select(*keys, *(x.alias(f"{side}{i}") for i, x in enumerate(geometry))) for rows, side in ((rows_a, "a"), (rows_b, "b")))
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        # Not digit for digit.
        apart = F.lit(False)
        for i in range(len(geometry)):
            apart = apart | F.coalesce(F.abs(F.col(f"a{i}") - F.col(f"b{i}")) > tolerance, F.lit(True))
        if not a.join(b, keys, "full").where(apart).isEmpty():
            return False
    names = [f"{s}{d}" for d in range(spec.dims) for s in ("min", "max")]
    left = nodes_a.select("node_key", *(F.col(n).alias(f"a_{n}") for n in names))
    both = left.join(nodes_b.select("node_key", *names), "node_key", "full")
    differs = F.lit(False)
    for n in names:
        differs = differs | F.coalesce(F.abs(F.col(n) - F.col(f"a_{n}")) > tolerance, F.lit(True))
    return both.where(differs).isEmpty()


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Stops if two rows have the same key."""
    if not df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("keys aren't unique")
