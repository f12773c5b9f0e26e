"""The ray queries over every part, against brute force; a box that a ray only touches is no hit."""

import math

import pytest
from gridlark.operators import rays
from gridlark.plans import registry
from gridlark.plans.tables import BOXES2

SF = "/root/testdata/sf0.001"


def hits(ray, box, wide):
    enter, leave = 0.0, math.inf
    for d in range(2):
        lo, hi, o, v = box[f"min{d}"] - wide, box[f"max{d}"] + wide, ray[f"o{d}"], ray[f"d{d}"]
        if not v:
            if not lo <= o <= hi:
                return False
            continue
        a, b = sorted(((lo - o) / v, (hi - o) / v))
        enter, leave = max(enter, a), min(leave, b)
    return enter + 1e-9 < leave


def test_every_part_is_a_ray(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_size").collect()
    turn = {0: (1.0, 0.0), 1: (0.6, 0.8), 2: (0.8, -0.6)}
    rays = [{"qid": p["p_partkey"], "o0": 0.0, "o1": p["p_partkey"] % 1500 * 1.0, "d0": turn[p["p_size"] % 3][0], "d1": turn[p["p_size"] % 3][1]} for p in parts]
    boxes = registry.table(spark, SF, "order_boxes").collect()
    got = {(r["qid"], r["r_id"]) for r in registry.QUERIES["batch_rays"](spark, SF).collect()}
    sure, may = ({(r["qid"], b["id"]) for r in rays for b in boxes if hits(r, b, wide)} for wide in (0.0, 0.02))
    assert sure <= got <= may and len(got) > 2000
    first = {(r["qid"], r["r_id"]) for r in registry.QUERIES["batch_rays_first"](spark, SF).collect()}
    assert first <= got and {q for q, _ in first} == {q for q, _ in got}


@pytest.mark.parametrize("first", [False, True])
def test_no_pieces_by_way_of_the_driver(spark, first):
    """Spark takes the pieces for a few rows, and sent them to all tasks."""
    name = "batch_rays_first" if first else "batch_rays"
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("first", [False, True])
def test_equal_rays_and_a_long_domain(spark, first):
    """Each of many equal rays has its hits, also where nearly all rows lie far from the rays."""
    boxes = [(i, i % 50 * 1.0, i % 50 + 2.0, i * 7.0, i * 7.0 + 3.0) for i in range(3000)]
    df = spark.createDataFrame(boxes, "id long, min0 double, max0 double, min1 double, max1 double")
    turn = [(1.0, 0.0, None), (0.6, 0.8, None), (0.8, -0.6, 20.0)]
    many = [(i, 0.0, i // 3 % 4 * 40.0 + 0.71, *turn[i % 3]) for i in range(240)]
    got = {(r["qid"], r["r_id"]) for r in rays.batch_rays(spark.createDataFrame(many, "qid long, o0 double, o1 double, d0 double, d1 double, max_dist double"), df, BOXES2, 2, first=first).collect()}
    want = set()
    for q, o0, o1, d0, d1, most in many:
        found = []
        for i, a0, z0, a1, z1 in boxes:
            enter, leave = a0 / d0, z0 / d0
            if d1:
                x, y = sorted(((a1 - o1) / d1, (z1 - o1) / d1))
                enter, leave = max(enter, x), min(leave, y)
            elif not a1 - 1e-14 <= o1 <= z1 + 1e-14:
                continue
            if max(0.0, enter) < leave and max(0.0, enter) <= (most or 1e9):
                found.append((i, max(0.0, enter), leave))
        bound = min((x for _, _, x in found), default=0.0) + 1e-9
        want |= {(q, i) for i, enter, _ in found if not first or enter <= bound}
    assert got == want and len(want) > 100
