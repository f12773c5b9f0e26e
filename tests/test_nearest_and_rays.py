import math

import pytest
from helpers import FIVE, SET_ONE, box_table, ids, point_table
from pyspark.sql import functions as F

from gridlark.functions.geometry import Ray
from gridlark.operators import nearest, rays
from gridlark.sources.spec import boxes, points

B2, P2 = boxes(2), points(2)


@pytest.mark.parametrize(
    ("point", "k", "limit", "expected"),
    [
        ((3.5, 5.5), 3, None, [14, 17, 18]), ((3.5, 5.5), 4, None, [14, 16, 17, 18]), ((3.5, 5.5), 4, 0.0, [17, 18]), ((3.5, 5.5), 5, 1.0, [14, 16, 17, 18]), ((3.5, 5.5), 100, None, list(range(32))),
        ((2, 2), 1, None, [1]), ((2, 2), 2, None, [1, 11]), ((2, 2), 3, None, [1, 11, 12]), ((-1, -1), 1, None, [0]), ((-1, -1), 5, None, [0, 1, 5, 6, 11]), ((2, 2), 0, None, []),
    ],
)
def test_nearest_points(spark, point, k, limit, expected):
    assert ids(nearest.nearest(point_table(spark, SET_ONE), P2, point, k, limit)) == expected


def test_nearest_without_tolerance_keeps_the_best(spark):
    assert ids(nearest.nearest(point_table(spark, SET_ONE), P2, (3.5, 5.5), 2, tolerance=0.0)) == [17, 18]


def test_nearest_boxes_are_candidates(spark):
    rows = [(0, (0.20, 0), (2.31, 2.31)), (1, (1, 0), (1.01, 1.41)), (2, (0.40, 0), (0.89, 0.89)), (3, (2.10, 0), (3.66, 3.66)), (4, (-2.21, 0), (-0.20, 2.21)), (5, (-2.5, 0), (-0.9, 2.47))]
    found = nearest.nearest(box_table(spark, rows), B2, (0.0, 0.0), 1)
    assert ids(found) == [0, 2, 4]


def test_user_distance(spark):
    df = point_table(spark, SET_ONE)
    assert ids(nearest.nearest(df, P2, (0, 0), 1, user_distance=F.when(F.col("id") != 0, F.col("p0")))) == [5, 7]


def order(df):
    return [r["id"] for r in df.collect()]


def test_rays_through_five_boxes(spark):
    ray = rays.ray([1.5, 2.5], [3.0, 1.0])
    df = box_table(spark, FIVE)
    assert order(rays.ray_first(df, B2, ray, tolerance=0.01)) == [2, 4]
    assert order(rays.ray_all(df, B2, ray, tolerance=0.01)) == [4, 2, 3]


def test_first_is_farthest_first(spark):
    df = box_table(spark, [(0, (1, -1), (4, 1)), (1, (2, -1), (5, 1)), (2, (3, -1), (6, 1))])
    assert order(rays.ray_first(df, B2, Ray([0.0, 0.0], [1.0, 0.0]))) == [2, 1, 0]


def test_direction_must_have_unit_length(spark):
    assert order(rays.ray_all(box_table(spark, FIVE), B2, Ray([0.0, 0.5], [2.0, 0.0]))) == []


def test_ray_hits_points(spark):
    df = point_table(spark, [(1, 0), (2, 0.05), (3, 1), (-1, 0)])
    assert order(rays.ray_all(df, P2, Ray([0.0, 0.0], [1.0, 0.0]), tolerance=0.1)) == [0, 1]


def test_batch_of_rays_like_one_by_one(spark):
    df = box_table(spark, FIVE)
    given = [(0, 1.5, 2.5, 3 / math.sqrt(10), 1 / math.sqrt(10)), (1, -1.0, 0.5, 1.0, 0.0), (2, 2.5, 9.0, 0.0, -1.0), (3, 50.0, 50.0, 1.0, 0.0)]
    many = spark.createDataFrame(given, "qid long, o0 double, o1 double, d0 double, d1 double")
    for first, one in ((False, rays.ray_all), (True, rays.ray_first)):
        expected = sorted((q, i) for q, a, b, c, d in given for i in order(one(df, B2, Ray([a, b], [c, d]), tolerance=0.01)))
        got = sorted((r["qid"], r["r_id"]) for r in rays.batch_rays(many, df, B2, 2, first=first, tolerance=0.01).collect())
        assert got == expected
