import random

import numpy as np
import pytest
from helpers import FIVE, SET_ONE, box_table, pairs, point_table
from pyspark.sql import functions as F

from gridlark.operators import joins
from gridlark.sources.spec import boxes, points

B2, P2 = boxes(2), points(2)


def overlapping(rows):
    out = []
    for i, (a, lo, hi) in enumerate(rows):
        for b, lo2, hi2 in rows[i + 1 :]:
            if all(x + 2.3e-14 < v and y + 2.3e-14 < u for x, u, y, v in zip(lo, hi, lo2, hi2, strict=True)):
                out.append((min(a, b), max(a, b)))
    return sorted(out)


@pytest.mark.parametrize("sizes", [None, [1.0, 1.0], [0.3, 5.0]])
def test_self_collision(spark, sizes):
    assert pairs(joins.collide(box_table(spark, FIVE), B2, sizes=sizes)) == [(1, 4), (2, 4)]


def test_seven_boxes(spark):
    rows = [*FIVE, (5, (0, 0), (0.9, 0.9)), (6, (0.1, 0.1), (0.9, 0.9))]
    assert pairs(joins.collide(box_table(spark, rows), B2)) == [(0, 5), (0, 6), (1, 4), (2, 4), (5, 6)]


def test_two_tables(spark):
    left = box_table(spark, FIVE[:4])
    right = box_table(spark, [(0, (2, 0), (3, 1)), (1, (3, 1), (4, 2)), (2, (3, 2), (4, 3)), (3, (2, 3), (4, 4)), (4, (2.5, 2.5), (3.5, 3.5))])
    assert pairs(joins.collide_two(left, B2, right, B2)) == [(2, 4), (3, 3), (3, 4)]


def test_pair_test(spark):
    assert pairs(joins.collide(box_table(spark, FIVE), B2, pair_test=F.col("l_id") == 1)) == [(1, 4)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_boxes_of_all_sizes(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        lo = [rng.uniform(-8, 8) for _ in range(3)]
        wide = rng.choice([0.0, 0.01, 0.5, 2.0, 16.0])
        rows.append((i, lo, [x + rng.random() * wide for x in lo]))
    assert pairs(joins.collide(box_table(spark, rows), boxes(3))) == overlapping(rows)


def test_points_collide_by_their_first_coordinate(spark):
    df = point_table(spark, [(1, 1), (1, 1), (1, 1.001), (1.001, 1)])
    assert pairs(joins.collide(df, P2, 0.01)) == [(0, 1), (0, 2), (1, 2)]
    found = joins.within_distance(df, P2, df, P2, 0.01).where("l_id < r_id")
    assert pairs(found) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def test_nearest_join_has_all_ties(spark):
    df = point_table(spark, SET_ONE)
    asked = point_table(spark, [(3.5, 5.5), (2, 2), (-1, -1), (100, 100)])
    for k, expected in ((1, {0: {17, 18}, 1: {1}, 2: {0}, 3: {31}}), (5, None)):
        got: dict[int, set] = {}
        for r in joins.knn_join(asked, P2, df, P2, k).collect():
            got.setdefault(r["l_id"], set()).add(r["r_id"])
        if expected is None:
            x = np.array(SET_ONE, float)
            expected = {}
            for q, p in enumerate([(3.5, 5.5), (2, 2), (-1, -1), (100, 100)]):
                d = np.sqrt(((x - np.array(p)) ** 2).sum(1))
                expected[q] = set(np.flatnonzero(d <= np.sort(d)[k - 1] * (1 + 1e-13)).tolist())
        assert got == expected


def test_empty_sides(spark):
    df = box_table(spark, FIVE)
    none = df.where("id < 0")
    assert pairs(joins.collide(none, B2)) == [] and pairs(joins.collide_two(df, B2, none, B2)) == []
