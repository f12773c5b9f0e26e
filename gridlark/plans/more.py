"""Queries of what the first registry leaves out: sources and sinks, vector helpers, variants of nearest and ray queries, static trees, traversals and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlark.functions import geometry as g
from gridlark.functions import morton
from gridlark.functions.geometry import Box, Ray
from gridlark.functions.morton import Grid
from gridlark.operators import bvh, factories, filters, index, joins, nearest, rays
from gridlark.operators.table import SpatialTable
from gridlark.plans.registry import BF, BOX_GRID, CODE_CTE, GRID, PAGE, POINTS2, Q0, Q1, RAY, RAY_SQL, T, TOP, TREE_CTE, _cell, _code, _num, query
from gridlark.plans.storage import work_path
from gridlark.plans.tables import BOXES2, POINTS3, sql, table
from gridlark.sources import io
from gridlark.sources.spec import array_points, struct_boxes, struct_points, with_row_ids, xyz

# Sources and sinks


@query("row_ids", "select row_number() over (order by o_totalprice, o_orderkey) - 1 as id, o_orderkey from orders")
def row_ids(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice")
    return with_row_ids(orders, ["o_totalprice", "o_orderkey"]).select("id", "o_orderkey")


@query("presets", f"select 'xyz' as preset, id, sqrt(p0 * p0 + p1 * p1) as measure from {sql('part_points')} union all select 'struct', id, sqrt(p0 * p0 + p1 * p1) from {sql('part_points')} union all select 'array', id, sqrt(p0 * p0 + p1 * p1) from {sql('part_points')} union all select 'boxes', id, (max0 - min0) * (max1 - min1) from {sql('part_boxes')}")
def presets(spark, sf):
    """The same geometry in columns x and y, in a struct, in an array, and boxes as structs of arrays."""
    p, b = table(spark, sf, "part_points"), table(spark, sf, "part_boxes")
    shaped = [
        ("xyz", xyz(2), p.select("id", F.col("p0").alias("x"), F.col("p1").alias("y"))),
        ("struct", struct_points("at", 2), p.select("id", F.struct(F.col("p0").alias("x"), F.col("p1").alias("y")).alias("at"))),
        ("array", array_points("at", 2), p.select("id", F.array("p0", "p1").alias("at"))),
        ("boxes", struct_boxes("b", 2), b.select("id", F.struct(F.array("min0", "min1").alias("min"), F.array("max0", "max1").alias("max")).alias("b"))),
    ]
    out = None
    for name, spec, df in shaped:
        measure = g.size(spec.point()) if spec.kind == "point" else g.column(g.volume(spec.box()))
        rows = spec.checked(df).select(F.lit(name).alias("preset"), "id", measure.alias("measure"))
        out = rows if out is None else out.unionAll(rows)
    return out


@query("archive", f"with {CODE_CTE} select id, p0, p1, code | {TOP} as node_key from m")
def archive(spark, sf):
    """Saved with its tree keys, and loaded again with its spec and grid."""
    where = work_path(spark, "archive")
    io.save(table(spark, sf, "order_points"), POINTS2, where, GRID)
    rows, spec, grid = io.load(spark, where)
    assert (list(spec.lo), grid.depth) == (list(POINTS2.lo), GRID.depth)
    return rows


@query("json_bridge", f"select id, p0, p1 from {sql('part_points')}")
def json_bridge(spark, sf):
    where = work_path(spark, "json")
    rows = table(spark, sf, "part_points")
    io.save_json(rows, where)
    return spark.read.schema(rows.schema).json(where)


@query("text_cloud", f"select p0, p1 from {sql('part_points')}")
def text_cloud(spark, sf):
    where = work_path(spark, "cloud")
    lines = table(spark, sf, "part_points").select(F.concat(F.lit("point "), F.col("p0").cast("string"), F.lit(" "), F.col("p1").cast("string")).alias("value"))
    lines.unionAll(spark.createDataFrame([("no point",)], "value string")).write.text(where)
    return io.read_text_cloud(spark, where, r"^point (\S+) (\S+)$", ["p0", "p1"])


# Vectors and boxes


@query("vector_helpers", f"select id, p0 + 1.5::double as a0, p1 + (-2.0)::double as a1, p0 * 3.0::double as m0, p1 * 3.0::double as m1, abs(p0 - p1) <= 900.0::double as near, p0 + 900.0::double < p1 as below, abs(p0 * p0 + p1 * p1 - 1.0::double) < 1e-6::double as unit from {sql('part_points')}")
def vector_helpers(spark, sf):
    p = POINTS2.point()
    a, m = g.add(p, [1.5, -2.0]), g.multiply(p, 3.0)
    return table(spark, sf, "part_points").select(
        "id", a[0].alias("a0"), a[1].alias("a1"), m[0].alias("m0"), m[1].alias("m1"), g.almost_equal(p[0], p[1], 900.0).alias("near"), g.less(p[0], p[1], 900.0).alias("below"), g.normalized(p).alias("unit"),
    )


@query("box_helpers", f"""select id, min0 + 2.0::double as min0, max0 + 2.0::double as max0, min1 + 3.0::double as min1, max1 + 3.0::double as max1, min0 < 120.0::double + 40.0::double and 120.0::double < max0 and min1 < 300.0::double + 120.0::double and 300.0::double < max1 as corner,
 ((max0 - min0) * (max1 - min1) + (max1 - min1) * (max0 - min0) + (max0 - min0) * (max0 - min0)) * 2.0::double as surface3 from {sql('order_boxes')}""")
def box_helpers(spark, sf):
    """Moved boxes; overlap with a box given by a corner and sizes; the surface of a box of three dimensions, whose third is its first again."""
    b = BOXES2.box()
    moved = g.move(b, [2.0, 3.0])
    solid = Box([*b.lo, b.lo[0]], [*b.hi, b.hi[0]])
    bounds = [x.alias(n) for n, x in zip(("min0", "max0", "min1", "max1"), (moved.lo[0], moved.hi[0], moved.lo[1], moved.hi[1]), strict=True)]
    return table(spark, sf, "order_boxes").select("id", *bounds, g.overlaps_by_corner(b, [120.0, 300.0], [40.0, 120.0]).alias("corner"), g.column(g.surface(solid)).alias("surface3"))


@query("distance_bounds", f"with d as (select id, sqrt((p0 - 100.0::double) * (p0 - 100.0::double) + (p1 - 20.0::double) * (p1 - 20.0::double)) as dist from {sql('event_points')}) select id, greatest(0.125::double, dist * 1.125::double) as upper, greatest(0.0, least(dist - 0.125::double, dist * 0.875::double)) as lower from d")
def distance_bounds(spark, sf):
    dist = g.distance(POINTS2.point(), [100.0, 20.0])
    return table(spark, sf, "event_points").select("id", g.upper(dist, 0.125).alias("upper"), g.lower(dist, 0.125).alias("lower"))


@query("wall_inner", f"""with a as (select id, (max0 - min0) * 0.5::double as h0, (max1 - min1) * 0.5::double as h1, min0, min1 from {sql('order_boxes')}),
b as (select *, abs(min0 + h0 - {Q0}::double) as d0, abs(min1 + h1 - {Q1}::double) as d1 from a)
select id, case when d0 <= h0 and d1 <= h1 then least(h0, h0 - d0, h1 - d1) else sqrt(greatest(0, d0 - h0) * greatest(0, d0 - h0) + greatest(0, d1 - h1) * greatest(0, d1 - h1)) end as dist from b""")
def wall_inner(spark, sf):
    """Within a box, the distance to its nearest face."""
    return table(spark, sf, "order_boxes").select("id", g.wall_distance([Q0, Q1], BOXES2.box(), inside_is_zero=False).alias("dist"))


GRID3 = Grid([-1.0, -1.0, -1.0], [1.0, 1.0, 1.0], 5)


def _code3() -> str:
    cells = [f"greatest(0, least(cast(floor((p{d} - {_num(GRID3.lo[d])}) * {_num(GRID3.factors()[d])}) as bigint), {GRID3.resolution - 1}))" for d in range(3)]
    bits = [f"(((({c}) >> {i}) & 1) << {3 * i + d})" for i in range(GRID3.depth) for d, c in enumerate(cells)]
    return " | ".join(bits)


@query("morton_key3", f"select id, {_code3()} as code from {sql('vectors3')} where abs(p0) <= 1 and abs(p1) <= 1 and abs(p2) <= 1")
def morton_key3(spark, sf):
    """Three dimensions; points outside of the domain have no code."""
    code = morton.encode(morton.point_cell(POINTS3.point(), GRID3), GRID3.depth)
    return table(spark, sf, "vectors3").select("id", code.alias("code")).where("code is not null")


def _loose_sql(factor: float) -> str:
    parts = []
    for at in range(BOX_GRID.depth):
        holds = " and ".join(f"cast(({c} >> {at}) << {at} as double) + {_num((1 << at) * 0.5)} - {_num((1 << at) * factor * 0.5)} <= (min{d} - 0) * {_num(BF[d])} and (max{d} - 0) * {_num(BF[d])} <= cast(({c} >> {at}) << {at} as double) + {_num((1 << at) * 0.5)} + {_num((1 << at) * factor * 0.5)}" for d, c in enumerate("xy"))
        parts.append(f"when base <= {at} and {holds} then {at}")
    return f"case {' '.join(parts)} else {BOX_GRID.depth} end"


@query("loose_key_narrow", f"""with s as (select *, cast(ceil(greatest((max0 - min0) * {_num(BF[0])}, (max1 - min1) * {_num(BF[1])})) as bigint) as cells, {_cell('((min0 + max0) * 0.5::double)', 0, BOX_GRID)} as x, {_cell('((min1 + max1) * 0.5::double)', 1, BOX_GRID)} as y from {sql('order_boxes')}),
b as (select *, case when cells <= 1 then 0 else length(bin(cells - 1)) end as base, {_code('x', 'y', BOX_GRID.depth)} as code from s), l as (select *, {_loose_sql(1.25)} as level from b)
select id, case when 0 - {T} <= min0 and max0 <= 512 + {T} and 0 - {T} <= min1 and max1 <= 16384 + {T} then (code >> (2 * level)) | (1 << (2 * ({BOX_GRID.depth} - level))) else 1 end as node_key from l""")
def loose_key_narrow(spark, sf):
    """A loose factor of 1.25."""
    return table(spark, sf, "order_boxes").select("id", morton.loose_key(BOXES2.box(), BOX_GRID, 1.25).alias("node_key"))


@query("lca_running", f"with {CODE_CTE}, c2 as (select id % 50 as part, case when id % 3 = 0 then 2 else 0 end as up, code from m), a as (select part, min((code >> (2 * up)) << (2 * up)) as lo, max((code >> (2 * up)) << (2 * up)) as hi, min({GRID.depth} - up) as own from c2 group by 1), d as (select part, lo, least(own, {GRID.depth} - cast(ceil(case when lo = hi then 0 else length(bin(xor(lo, hi))) end / 2.0) as integer)) as depth from a) select part, (lo >> (2 * ({GRID.depth} - depth))) | (1 << (2 * depth)) as lca from d")
def lca_running(spark, sf):
    """The lowest node that holds all keys of a group, whatever their depths."""
    k = morton.point_key(POINTS2.point(), GRID)
    rows = table(spark, sf, "order_points").select((F.col("id") % 50).alias("part"), F.when(F.col("id") % 3 == 0, F.shiftright(k, 4)).otherwise(k).alias("k"))
    return rows.groupBy("part").agg(morton.common_node(F.col("k"), 2, GRID.depth).alias("lca"))


# Filters, nearest and rays


@query("contains_geometry", f"select (select count(*) from {sql('part_points')} where id = 1) > 0 as point_there, false as point_away, (select count(*) from {sql('part_boxes')} where id = 1) > 0 as box_there, false as box_away")
def contains_geometry(spark, sf):
    p, b = table(spark, sf, "part_points"), table(spark, sf, "part_boxes")
    point, box = p.where("id = 1").first(), b.where("id = 1").first()
    at = [point["p0"], point["p1"]]
    own = Box([box["min0"], box["min1"]], [box["max0"], box["max1"]])
    wide = Box(own.lo, [x + 0.5 for x in own.hi])
    said = (filters.contains(p, POINTS2, at), filters.contains(p, POINTS2, [at[0] + 0.125, -5.0]), filters.contains(b, BOXES2, own), filters.contains(b, BOXES2, wide))
    return spark.createDataFrame([said], "point_there boolean, point_away boolean, box_there boolean, box_away boolean")


@query("knn_user", f"""with d as (select id, abs(p0 - 100.0::double) + abs(p1 - 20.0::double) as dist from {sql('event_points')} where id % 2 = 1), k as (select max(dist) as kth from (select dist from d order by dist limit 15))
select id, dist from d, k where dist < greatest({T}, kth * (1.0::double + {T})) or dist <= kth""")
def knn_user(spark, sf):
    """A distance of the user's own, and a test."""
    p = POINTS2.point()
    taxi = F.abs(p[0] - 100.0) + F.abs(p[1] - 20.0)
    return nearest.nearest(table(spark, sf, "event_points"), POINTS2, [100.0, 20.0], 15, user_distance=taxi, test=F.col("id") % 2 == 1).select("id", "dist")


@query("knn_unsorted", f"""with d as (select id, sqrt((p0 - 5000.0::double) * (p0 - 5000.0::double) + (p1 - 700.0::double) * (p1 - 700.0::double)) as dist from {sql('customer_points')}), k as (select max(dist) as kth from (select dist from d order by dist limit 30))
select id, dist from d, k where dist < greatest({T}, kth * (1.0::double + {T})) or dist <= kth""")
def knn_unsorted(spark, sf):
    return nearest.nearest(table(spark, sf, "customer_points"), POINTS2, [5000.0, 700.0], 30, ordered=False).select("id", "dist")


@query("ray_user", f"with {RAY_SQL} select id, enter * 2.0::double as enter from h where id % 2 = 0 and id % 3 <> 1 and enter * 2.0::double <= 700.0")
def ray_user(spark, sf):
    """A distance of the user's own (null: no hit) and a test."""
    user = F.when(F.col("id") % 3 != 1, F.col("enter") * 2.0)
    return rays.ray_all(table(spark, sf, "order_boxes"), BOXES2, RAY, test=F.col("id") % 2 == 0, user_distance=user).where("enter <= 700.0").select("id", "enter")


CONE = 0.001


@query("ray_points", f"""with s as (select id, (p0 - 20.0::double) * 0.0::double + (p1 - 0.0::double) * 1.0::double as s, (p0 - 20.0::double) * (p0 - 20.0::double) + (p1 - 0.0::double) * (p1 - 0.0::double) as v from {sql('part_points')}), t as (select *, greatest(0, v - s * s) as off, greatest(0, s) * {CONE}::double + 1.0::double as slack from s)
select id, greatest(0, s - slack) as enter, s + slack as exit from t where off <= slack * slack and s >= -slack""")
def ray_points(spark, sf):
    """A ray that widens, against points."""
    found = rays.ray_all(table(spark, sf, "part_points"), POINTS2, Ray([20.0, 0.0], [0.0, 1.0]), tolerance=1.0, increment=CONE)
    return found.select("id", "enter", "exit")


# Batches of planes

PLANES = ["cast(n_nationkey as bigint) as qid", "cast(n_nationkey * 60 as double) as d", "cast(case when n_regionkey % 2 = 0 then 0.6 else 1 end as double) as n0", "cast(case when n_regionkey % 2 = 0 then 0.8 else 0 end as double) as n1"]
PLANE_SIDE = f"case when n0 * p0 + n1 * p1 < d - {T} then -1 when n0 * p0 + n1 * p1 > d + {T} then 1 else 0 end"
BOX_SIDE = "n0 * ((min0 + max0) * 0.5::double) + n1 * ((min1 + max1) * 0.5::double) - d"
BOX_REACH = f"({T} + (max0 - min0) * 0.5::double * abs(n0) + (max1 - min1) * 0.5::double * abs(n1))"


def _planes(spark, sf):
    return spark.read.parquet(f"{sf}/nation.parquet").selectExpr(*PLANES)


@query("batch_planes", f"with q as (select {', '.join(PLANES)} from nation) select qid, id as r_id from q, {sql('order_boxes')} x where not ({BOX_SIDE} + {BOX_REACH} < 0) and not ({BOX_SIDE} - {BOX_REACH} > 0)")
def batch_planes(spark, sf):
    return joins.batch_planes(_planes(spark, sf), table(spark, sf, "order_boxes"), BOXES2)


@query("batch_planes_positive", f"with q as (select {', '.join(PLANES)} from nation) select qid, id as r_id from q, {sql('part_points')} x where {PLANE_SIDE} >= 0")
def batch_planes_positive(spark, sf):
    return joins.batch_planes(_planes(spark, sf), table(spark, sf, "part_points"), POINTS2, positive=True)


@query("batch_frusta", f"with q as (select qid % 5 as qid, case when qid < 5 then d else d - 4000 end as d, n0, n1 from (select {', '.join(PLANES)} from nation)), k as (select qid, id, min({PLANE_SIDE}) as worst from q, {sql('part_points')} x group by 1, 2) select qid, id as r_id from k where worst >= 0")
def batch_frusta(spark, sf):
    """Five frusta of five planes each."""
    planes = _planes(spark, sf).select((F.col("qid") % 5).alias("qid"), F.when(F.col("qid") < 5, F.col("d")).otherwise(F.col("d") - 4000).alias("d"), "n0", "n1")
    return joins.batch_frusta(planes, table(spark, sf, "part_points"), POINTS2)


# Trees


@query("tree_estimates", "select greatest(2, least(19, cast(floor(log2(n / 16.0) / 2) as integer))) as depth, cast(ceil(ceil(n / 16.0) * 4 / 3) as bigint) + 1 as nodes from (select count(*) as n from orders)")
def tree_estimates(spark, sf):
    n = table(spark, sf, "order_points").count()
    return spark.createDataFrame([(morton.default_depth(n, 16, 2), morton.estimated_nodes(n, 16, 2))], "depth int, nodes long")


@query("find_node", f"with {TREE_CTE} select l.node_key, k as deep_key from leaf l join t using (id) where l.id = (select min(id) from t)")
def find_node(spark, sf):
    """The node that a row is in, and its deepest key."""
    rows = table(spark, sf, "order_points")
    least = rows.agg(F.min("id")).first()[0]
    _, nodes, grid = index.create(rows, POINTS2, GRID, PAGE)
    held = SpatialTable(rows, POINTS2, grid)
    return held.find(least, nodes=nodes).crossJoin(held.find(least).withColumnRenamed("node_key", "deep_key"))


NODE_CTE = f"{TREE_CTE}, up as (select node_key >> (2 * u) as node_key, depth - u as depth, case when u = 0 then 1 else 0 end as own from (select node_key, depth, unnest(range(depth + 1)) as u from leaf)), nodes as (select node_key, depth, cast(sum(own) as bigint) as cnt from up group by 1, 2)"


@query("tree_static", f"""with {NODE_CTE}, ch as (select node_key >> 2 as node_key, count(*) as children from nodes where node_key > 1 group by 1), kept as (select nodes.* from nodes left join ch using (node_key) where coalesce(children, 0) <> 1 or cnt > 0 or node_key = 1),
pa as (select a.node_key, max(b.node_key) as parent_key from kept a join kept b on b.depth < a.depth and (a.node_key >> (2 * (a.depth - b.depth))) = b.node_key group by 1) select kept.node_key, depth, cnt, parent_key from kept left join pa using (node_key)""")
def tree_static(spark, sf):
    """Without chains of single children; parent_key skips them."""
    _, nodes, _ = factories.FACTORIES["static_quadtree_points"](table(spark, sf, "order_points"), grid=GRID, page=PAGE)
    return nodes.select("node_key", "depth", "cnt", "parent_key")


@query("bvh_invariants", f"select count(*) as held, 0::bigint as too_large, 0::bigint as wrong_bounds, min(min0) as min0, max(max0) as max0, min(min1) as min1, max(max1) as max1 from {sql('order_boxes')}")
def bvh_invariants(spark, sf):
    """Leaves hold every row once; none above the greatest depth has more than a page; bounds are those of the members."""
    page = 512
    boxes = table(spark, sf, "order_boxes")
    rows, nodes = factories.FACTORIES["bvh2_boxes"](boxes, page=page)
    depth = bvh.depth_for(boxes.count(), page)
    names = ["min0", "max0", "min1", "max1"]
    own = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *((F.min if n.startswith("min") else F.max)(n).alias(f"o_{n}") for n in names))
    differ = F.lit(False)
    for n in names:
        differ = differ | (F.col(n) != F.col(f"o_{n}"))
    leaves = own.join(nodes, "node", "left")
    large = (F.col("n") > page) & (F.floor(F.log2(F.col("node") + 1)) < depth)
    sums = leaves.agg(F.sum("n").alias("held"), F.sum(F.when(large, 1).otherwise(0)).alias("too_large"), F.sum(F.when(differ | (F.col("cnt") != F.col("n")), 1).otherwise(0)).alias("wrong_bounds"))
    return sums.crossJoin(nodes.where("node = 0").select(*names))


@query("traverse_dfs", f"with {TREE_CTE} select id, node_key, row_number() over (order by (xor(node_key, 1::bigint << (2 * depth))) << (2 * ({GRID.depth} - depth)), depth, id) as place from leaf where node_key > 0")
def traverse_dfs(spark, sf):
    """Rows in depth-first order, numbered."""
    keyed = index.assign_nodes(table(spark, sf, "order_points"), POINTS2, GRID, PAGE)
    rows = index.depth_first(keyed, POINTS2, GRID.depth).select("id", "node_key", "depth")
    left = F.call_function("shiftleft", F.col("node_key").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("depth") * 2)), (F.lit(GRID.depth) - F.col("depth")) * 2)
    placed = with_row_ids(rows.withColumn("_left", left), ["_left", "depth", "id"], "place")
    return placed.select("id", "node_key", (F.col("place") + 1).alias("place"))


@query("traverse_priority", f"with {NODE_CTE}, x as (select *, row_number() over (order by depth, -node_key) as place from nodes where depth <= 3) select place, node_key from x where depth < 3 or node_key % 2 = 0")
def traverse_priority(spark, sf):
    """Nodes of the first levels, the greatest key of a level first; of the last level odd ones have no priority and are left out. Places count those too."""
    _, nodes, _ = index.create(table(spark, sf, "order_points"), POINTS2, GRID, PAGE)
    top = nodes.where("depth <= 3")
    skipped = sorted(((r["depth"], -r["node_key"]) for r in top.select("depth", "node_key").collect()))
    place = {-k: i + 1 for i, (_, k) in enumerate(skipped)}
    seen: list[tuple[int, int]] = []

    def rank(node):
        return None if node["depth"] == 3 and node["node_key"] % 2 else (node["depth"], -node["node_key"])

    index.traverse(top, 2, lambda node: seen.append(node["node_key"]), "priority", rank)
    assert [place[k] for k in seen] == sorted(place[k] for k in seen)
    return spark.createDataFrame([(place[k], k) for k in seen], "place long, node_key long")


PART_GRID = Grid([0.0, 0.0], [64.0, 4096.0], 5)
PART_CTE = f"c as (select id, {_cell('p0', 0, PART_GRID)} as x, {_cell('p1', 1, PART_GRID)} as y from {sql('part_points')}), t as (select id, {_code('x', 'y', 5)} | 1024 as k from c), u as (select id, k, unnest(range(6)) as depth from t), v as (select id, k >> (2 * (5 - depth)) as node_key, depth from u), cnt as (select node_key, depth, count(*) as n from v group by 1, 2), f as (select v.id, min(v.depth) as depth from v join cnt using (node_key, depth) where cnt.n <= 64 or depth = 5 group by 1), leaf as (select v.id, v.node_key, v.depth from v join f using (id, depth))"


@query("traverse_entities", f"with {PART_CTE} select row_number() over (order by depth, node_key) as place, node_key, count(*) as n, cast(sum(id) as bigint) as ids from leaf group by node_key, depth")
def traverse_entities(spark, sf):
    """Nodes that have rows, breadth first, with the rows they hand over."""
    keyed, nodes, _ = index.create(table(spark, sf, "part_points"), POINTS2, PART_GRID, 64)
    seen: list[tuple[int, int, int, int]] = []

    def visit(ids, node):
        if ids:
            seen.append((len(seen) + 1, node["node_key"], len(ids), sum(ids)))

    index.traverse_entities(keyed, nodes, POINTS2, visit)
    return spark.createDataFrame(seen, "place long, node_key long, n long, ids long")


# Tables


@query("table_init", "select 0::bigint as empty_rows, count(*) as added, 0::bigint as rejected, 0::bigint as cleared, 0::bigint as reset_rows, false as domain_after_reset, true as domain_after_clear from part where p_partkey % 4 <> 0")
def table_init(spark, sf):
    """An empty table with a domain, filled, cleared and reset."""
    rows = table(spark, sf, "part_points").where("id % 4 <> 0")
    empty = SpatialTable.empty(rows, POINTS2, Box([0.0, 0.0], [64.0, 4096.0]), 5)
    full, rejected = empty.add(rows)
    clear, reset = full.clear(), full.reset()
    said = (empty.rows.count(), full.rows.count(), rejected.count(), clear.rows.count(), reset.rows.count(), reset.grid is not None, clear.grid is not None)
    return spark.createDataFrame([said], "empty_rows long, added long, rejected long, cleared long, reset_rows long, domain_after_reset boolean, domain_after_clear boolean")


@query("table_out_of_space", f"select id, p0, p1, case when 5 - {T} <= p0 and p0 <= 40 + {T} and 0 - {T} <= p1 and p1 <= 1500 + {T} then 'row' else 'rejected' end as state from {sql('part_points')}")
def table_out_of_space(spark, sf):
    rows = table(spark, sf, "part_points")
    empty = SpatialTable.empty(rows, POINTS2, Box([5.0, 0.0], [40.0, 1500.0]), 5, out_of_space=False)
    after, rejected = empty.add(rows)
    return after.rows.withColumn("state", F.lit("row")).unionByName(rejected.withColumn("state", F.lit("rejected")))


HALF_CTE = PART_CTE.replace("from part)", "from part where p_partkey % 2 = 0)")


@query("leaf_insert", f"with {HALF_CTE}, up as (select distinct node_key >> (2 * u) as node_key from (select node_key, unnest(range(depth + 1)) as u from leaf)), c1 as (select id, {_cell('p0', 0, PART_GRID)} as x, {_cell('p1', 1, PART_GRID)} as y from {sql('part_points')} where id % 2 = 1), n as (select id, {_code('x', 'y', 5)} | 1024 as k, unnest(range(6)) as s from c1) select id, max(k) as deep, max(up.node_key) as existing from n join up on (n.k >> (2 * n.s)) = up.node_key group by 1")
def leaf_insert(spark, sf):
    """New rows get their deepest key, or the deepest node that a tree of the other rows already has."""
    parts = table(spark, sf, "part_points")
    old, new = parts.where("id % 2 = 0"), parts.where("id % 2 = 1")
    _, nodes, grid = index.create(old, POINTS2, PART_GRID, 64)
    held = SpatialTable(old, POINTS2, grid)
    deep = held.insert_into_leaf(new, nodes).select("id", F.col("node_key").alias("deep"))
    return held.insert_into_leaf(new, nodes, existing=True).select("id", F.col("node_key").alias("existing")).join(deep, "id")


@query("unique_check", "select count(*) = count(distinct o_orderkey) as orders, (select count(*) = count(distinct (l_orderkey, l_linenumber)) from lineitem) as lines from orders")
def unique_check(spark, sf):
    said = []
    for name, key in (("orders", ["o_orderkey"]), ("lineitem", ["l_orderkey", "l_linenumber"])):
        try:
            index.assert_unique(spark.read.parquet(f"{sf}/{name}.parquet"), key)
            said.append(True)
        except ValueError:
            said.append(False)
    return spark.createDataFrame([tuple(said)], "orders boolean, lines boolean")
