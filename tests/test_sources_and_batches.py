"""Contiguous ids over many rows, batches of planes and rays in three dimensions, contiguous erase, factories, and traversals, against brute force."""

import math
import random

import pytest
from helpers import box_table, point_table
from pyspark.sql import functions as F

from gridlark.functions import geometry as g
from gridlark.functions import morton
from gridlark.functions.geometry import Box, Plane
from gridlark.functions.morton import Grid
from gridlark.operators import factories, filters, index, joins, rays
from gridlark.operators.table import SpatialTable
from gridlark.sources.spec import CONTIGUOUS, boxes, points, with_row_ids


def test_ids_are_contiguous_over_many_rows(spark):
    n = 400_000
    df = spark.range(n).select(F.xxhash64("id").alias("x"), (F.col("id") % 7).alias("y"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        found = with_row_ids(df, ["y", "x"])
        sums = found.agg(F.count_distinct("id").alias("n"), F.min("id").alias("a"), F.max("id").alias("z"), F.sum("id").alias("s")).first()
        assert tuple(sums) == (n, 0, n - 1, n * (n - 1) // 2)
        sample = found.where("id % 1000 = 0").orderBy("id").select("y", "x").collect()
        assert [tuple(r) for r in sample] == sorted(tuple(r) for r in sample)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("step", [2, 9973, 4096 * 4096 + 5])
def test_contiguous_ids_close_up_over_far_ids(spark, step):
    rng = random.Random(step)
    ids = [i * step for i in range(300)]
    gone = sorted(rng.sample(ids, 90))
    rows = spark.createDataFrame([(i, float(i % 11)) for i in ids], "id long, p0 double")
    held = SpatialTable(rows, points(1, ids=CONTIGUOUS))
    after, missing = held.erase(spark.createDataFrame([(i,) for i in [*gone, -5]], "id long"))
    assert sorted(r["id"] for r in after.rows.collect()) == sorted(i - sum(x < i for x in gone) for i in ids if i not in set(gone))
    assert [r["id"] for r in missing.collect()] == [-5]


def random_boxes(rng, n, dims):
    out = []
    for i in range(n):
        lo = [rng.uniform(0, 100) for _ in range(dims)]
        out.append((i, tuple(lo), tuple(x + rng.choice([0.0, 0.5, 4.0, 60.0]) * rng.random() for x in lo)))
    return out


@pytest.mark.parametrize("dims", [2, 3])
def test_batches_are_single_queries(spark, dims):
    rng = random.Random(dims)
    df, spec = box_table(spark, random_boxes(rng, 200, dims)), boxes(dims)
    normals = []
    for _ in range(6):
        v = [rng.gauss(0, 1) for _ in range(dims)]
        n = math.sqrt(sum(x * x for x in v))
        normals.append([x / n for x in v])
    planes = [(i % 3, rng.uniform(-20, 60), *v) for i, v in enumerate(normals)]
    names = ", ".join(["qid long", "d double", *(f"n{d} double" for d in range(dims))])
    table = spark.createDataFrame(planes, names)
    one = spark.createDataFrame([(i, *p[1:]) for i, p in enumerate(planes)], names)
    for positive, single in ((False, filters.plane_search), (True, filters.plane_positive)):
        got = {(r["qid"], r["r_id"]) for r in joins.batch_planes(one, df, spec, positive).collect()}
        assert got == {(i, r["id"]) for i, p in enumerate(planes) for r in single(df, spec, Plane(p[1], list(p[2:]))).collect()}
    got = {(r["qid"], r["r_id"]) for r in joins.batch_frusta(table, df, spec).collect()}
    expected = {(q, r["id"]) for q in range(3) for r in filters.frustum_culling(df, spec, [Plane(p[1], list(p[2:])) for p in planes if p[0] == q]).collect()}
    assert got == expected
    asked = [(i, *(rng.uniform(-20, 100) for _ in range(dims)), *normals[i % 6]) for i in range(12)] + [(99, *([0.0] * dims), *([2.0] * dims))]
    cast = spark.createDataFrame(asked, ", ".join(["qid long", *(f"o{d} double" for d in range(dims)), *(f"d{d} double" for d in range(dims))]))
    for increment in (0.0, 0.02):
        found = rays.batch_rays(cast, df, spec, dims, increment=increment).collect()
        got = {(r["qid"], r["r_id"]) for r in found}
        expected = {(a[0], r["id"]) for a in asked[:-1] for r in rays.ray_all(df, spec, g.Ray(list(a[1 : 1 + dims]), list(a[1 + dims :])), increment=increment).collect()}
        assert got == expected and len(found) == len(got)


def test_overlaps_of_boxes_of_all_sizes(spark):
    rng = random.Random(17)
    rows = [*random_boxes(rng, 150, 2), (500, (0, 0), (100, 100)), (501, (-1e6, 3), (1e6, 3.25)), (502, (50, 50), (50, 50))]
    df = box_table(spark, rows)
    t = g.BASE_TOLERANCE
    expected = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and all(a[1][d] + t < b[2][d] and b[1][d] + t < a[2][d] for d in range(2)))
    assert sorted((r["l_id"], r["r_id"]) for r in joins.collide(df, boxes(2)).collect()) == expected
    assert joins.collide(df.where("id < 0"), boxes(2)).count() == 0


def test_narrow_loose_keys(spark):
    rng = random.Random(3)
    grid = Grid([0.0, 0.0], [16.0, 16.0], 4)
    rows = [(i, (x, y), (x + w, y + h)) for i in range(200) for x, y, w, h in [(rng.uniform(0, 13), rng.uniform(0, 13), rng.choice([0, 0.3, 1.1, 2.9]), rng.choice([0, 0.4, 2.0]))]]
    df = box_table(spark, rows)
    for factor in (1.0, 1.25, 1.75):
        found = {r["id"]: r["k"] for r in df.select("id", morton.loose_key(boxes(2).box(), grid, factor).alias("k")).collect()}
        for i, lo, hi in rows:
            cell = [int((a + b) * 0.5) for a, b in zip(lo, hi, strict=True)]
            span = math.ceil(max(b - a for a, b in zip(lo, hi, strict=True)))
            level = 0 if span <= 1 else (span - 1).bit_length()
            while level < 4 and not all(((c >> level) << level) + (1 << level) * (1 - factor) / 2 <= a and b <= ((c >> level) << level) + (1 << level) * (1 + factor) / 2 for c, a, b in zip(cell, lo, hi, strict=True)):
                level += 1
            code = sum(((c >> b) & 1) << (2 * b + d) for d, c in enumerate(cell) for b in range(4))
            assert found[i] == (code >> (2 * level)) | 1 << (2 * (4 - level))
    with pytest.raises(ValueError):
        morton.loose_key(boxes(2).box(), grid, 3.0)


def test_factories_by_name(spark):
    df = point_table(spark, [(x * 0.5, y * 0.5, 1.0) for x in range(6) for y in range(6)])
    rows, nodes, grid = factories.octree_points(df, page=4)
    assert grid.dims == 3 and rows.count() == 36 and nodes.where("node_key = 1").first()["below"] == 36
    leaves, tree = factories.bvh3_points(df, page=4)
    assert leaves.count() == 36 and tree.where("node = 0").first()["below"] == 36
    held = factories.quadtree_points_table(df, domain=Box([0.0, 0.0], [4.0, 4.0]), depth=3)
    assert held.spec.dims == 2 and held.find(7).count() == 1


def test_entities_by_priority(spark):
    df = point_table(spark, [(x + 0.5, y + 0.5) for x in range(4) for y in range(4)])
    spec, grid = points(2), Grid([0.0, 0.0], [4.0, 4.0], 2)
    keyed, nodes, _ = index.create(df, spec, grid, 1)
    seen = []

    def rank(node):  # nearest first; nodes beyond x = 2 are left out
        return None if node["min0"] > 2 else math.hypot(node["min0"], node["min1"])

    def visit(ids, node):
        if ids:
            seen.append((node["min0"], node["min1"], ids))
        return index.Control.TERMINATE if len(seen) == 5 else None

    index.traverse_entities(keyed, nodes, spec, visit, "priority", rank)
    assert len(seen) == 5 and all(x < 2 for x, _, _ in seen) and seen[0][2] == [0]
    assert [math.hypot(x, y) for x, y, _ in seen] == sorted(math.hypot(x, y) for x, y, _ in seen)


@pytest.mark.parametrize("order", ["breadth", "depth"])
def test_more_entities_than_nodes_that_may_be_brought(spark, order):
    """Only nodes are limited, not the rows that they hand over; children of skipped nodes don't shift those of others."""
    df = point_table(spark, [(x % 4 + 0.5, x // 4 % 4 + 0.5) for x in range(200)])
    spec, grid = points(2), Grid([0.0, 0.0], [4.0, 4.0], 2)
    keyed, nodes, _ = index.create(df, spec, grid, 20)
    seen = {}

    def visit(ids, node):
        seen[node["node_key"]] = ids
        return index.Control.SKIP_CHILDREN if node["node_key"] == 5 else None

    index.traverse_entities(keyed, nodes, spec, visit, order, most=30)
    held = {}
    for r in keyed.orderBy("id").collect():
        held.setdefault(r["node_key"], []).append(r["id"])
    assert {k: ids for k, ids in seen.items() if ids} == {k: ids for k, ids in held.items() if k >> 2 != 5}
    assert sum(map(len, seen.values())) == 148
