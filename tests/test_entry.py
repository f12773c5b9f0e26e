import __spark_entry__ as entry
import duckdb
import pytest

from gridlark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


def same(spark, duck, query, sql):
    df = query(spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.sql(sql)
    names = found.columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted(names) == columns and got == expected


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    same(spark, duck, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_entry(spark):
    assert entry.entry(spark).columns == ["l_id", "r_id"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
