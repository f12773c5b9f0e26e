import math

from helpers import FIVE, box_table, ids, point_table
from pyspark.sql import functions as F

from gridlark.functions.geometry import Box, Plane
from gridlark.operators import filters
from gridlark.operators.filters import Logic, RangeMode
from gridlark.sources.spec import STABLE, boxes, points

B2, P2 = boxes(2), points(2)
S2, S3 = math.sqrt(2), math.sqrt(3)


def test_range_of_boxes(spark):
    df = box_table(spark, FIVE)
    box = Box([1.0, 1.0], [3.1, 3.1])
    assert ids(filters.range_search(df, B2, box)) == [1, 2, 4]
    assert ids(filters.range_search(df, B2, box, RangeMode.OVERLAP)) == [1, 2, 3, 4]


def test_range_is_pushed_to_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    box_table(spark, FIVE).write.parquet(str(tmp_path / "boxes"))
    found = filters.range_search(spark.read.parquet(str(tmp_path / "boxes")), B2, Box([1.0, 1.0], [3.1, 3.1])).select("id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(min0,1.0)" in plan and "LessThanOrEqual(max1,3.1)" in plan


def test_pick(spark):
    assert ids(filters.pick(box_table(spark, FIVE), B2, [2.5, 2.5])) == [2, 4]
    assert ids(filters.pick(point_table(spark, [(0, 0), (1, 1)]), P2, [1.0, 1.0])) == [1]


def test_border_of_a_box_is_lost_far_from_zero(spark):
    df = box_table(spark, [(0, (0, 0), (1, 1)), (1, (300, 300), (400, 400))])
    assert ids(filters.pick(df, B2, [1.0, 1.0])) == [0]
    assert ids(filters.pick(df, B2, [300.0, 300.0])) == []


def test_ranges_of_points_on_a_line(spark):
    df, spec = point_table(spark, [(0,), (1,), (2,), (3,)]), points(1)
    for lo, hi, expected in ((1, 2, [1, 2]), (1.1, 3.1, [2, 3]), (1.5, 2.25, [2]), (0, 0, []), (1.5, 1.75, [])):
        assert ids(filters.range_search(df, spec, Box([float(lo)], [float(hi)]))) == expected


def test_whole_domain_skips_the_test(spark):
    df = point_table(spark, [(0, 0), (1, 1)])
    domain = filters.domain_of(df, P2)
    wide = Box([-1.0, -1.0], [2.0, 2.0])
    assert ids(filters.range_search(df, P2, wide, test=F.col("id") > 0, domain=domain)) == [0, 1]
    assert ids(filters.range_search(df, points(2, ids=STABLE), wide, test=F.col("id") > 0, domain=domain)) == [1]


def test_frustum_of_boxes(spark):
    planes = [Plane(2 * S2, [1 / S2, 1 / S2]), Plane(-2.0, [0.0, -1.0])]
    # The second plane keeps what lies below y = 2.
    df = box_table(spark, FIVE)
    assert ids(filters.frustum_culling(df, B2, planes, 0.01)) == [1, 2, 4]
    assert ids(filters.frustum_culling(df, B2, [], 0.01)) == []
    # The test is asked only of boxes on a plane.
    above = [Plane(-10.0, [1.0, 0.0])]
    assert ids(filters.frustum_culling(df, B2, above, test=F.lit(False))) == [0, 1, 2, 3, 4]


def test_points_on_planes(spark):
    df = point_table(spark, [(0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 3, 3), (4, 4, 4), (0, 0, 4), (0, 4, 0), (4, 0, 0), (1.5, 1.5, 1), (1, 1.5, 1.5)])
    spec = points(3)
    assert ids(filters.plane_search(df, spec, Plane(2.6, [1 / S3] * 3), 0.3)) == [5, 6, 7, 8, 9]
    assert ids(filters.range_search(df, spec, Box([0.0] * 3, [2.0] * 3))) == [0, 1, 2, 8, 9]


def test_compound(spark):
    df = point_table(spark, [(0, 0), (8, 8), (2, 1), (3.5, 3), (4.5, 3), (5.5, 4), (6.5, 5.5), (4.5, 5.5), (4, 4)])
    conditions = [
        filters.in_frustum(P2, [Plane(4 * S2, [1 / S2, 1 / S2])], [True]), filters.within(P2, Box([3.0, 2.0], [7.0, 6.0])),
        filters.intersecting(P2, Plane(5.0, [1.0, 0.0]), 1.0), filters.satisfying(F.col("id") > 5),
    ]
    assert ids(filters.query(df, conditions)) == [7, 8]
    assert ids(filters.query(df, conditions, Logic.OR)) == [1, 3, 4, 5, 6, 7, 8]
    assert ids(filters.query(df, [])) == list(range(9)) and ids(filters.query(df, [], Logic.OR)) == []


def test_null_geometry_never_matches(spark):
    df = spark.createDataFrame([(0, None, 1.0), (1, 1.0, 1.0)], "id long, p0 double, p1 double")
    assert ids(filters.range_search(df, P2, Box([0.0, 0.0], [2.0, 2.0]))) == [1]


def test_contains(spark):
    df = box_table(spark, FIVE)
    assert filters.contains(df, B2, Box([1.2, 1.2], [2.8, 2.8])) and not filters.contains(df, B2, Box([1.2, 1.2], [2.8, 2.9]))
    assert filters.contains_id(df, B2, 3) and not filters.contains_id(df, B2, 7)
