"""Small tables and results as sets."""


def box_table(spark, rows):
    """rows: id, lower corner, upper corner."""
    dims = len(rows[0][1])
    names = ", ".join(["id long", *(f"min{d} double" for d in range(dims)), *(f"max{d} double" for d in range(dims))])
    return spark.createDataFrame([(i, *map(float, lo), *map(float, hi)) for i, lo, hi in rows], names)


def point_table(spark, rows):
    """rows: points; ids are their places."""
    dims = len(rows[0])
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rows)], ", ".join(["id long", *(f"p{d} double" for d in range(dims))]))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def pairs(df):
    return sorted((r["l_id"], r["r_id"]) for r in df.collect())


FIVE = [(0, (0, 0), (1, 1)), (1, (1, 1), (2, 2)), (2, (2, 2), (3, 3)), (3, (3, 3), (4, 4)), (4, (1.2, 1.2), (2.8, 2.8))]
SET_ONE = [
    (0, 0), (3, 3), (5, 3), (5.2, 3), (7, 1), (0, 5), (1, 5), (0, 7), (1, 7), (3, 7), (3, 7), (2.2, 4.5), (2.5, 4.5), (3.4, 4.5), (3.6, 4.6), (2.4, 5.5), (2.5, 5.5), (3.5, 5.5), (3.5, 5.5), (5, 5), (5, 5),
    (7, 5), (7, 5), (6.5, 6.5), (6.5, 6.5), (7.5, 6.5), (7.5, 6.5), (6.5, 7.5), (6.5, 7.5), (7.5, 7.5), (7.5, 7.5), (8, 8),
]
