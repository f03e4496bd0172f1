"""Every query with SQL gives the same rows in DuckDB; the others give rows."""

import decimal

import duckdb
import pytest

from tidewake import cases, catalog  # noqa: F401

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def comparable(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(comparable(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert got
    if name in catalog.ORACLES:
        cur = duck.sql(catalog.ORACLES[name])
        assert sorted(cur.columns) == sorted(df.columns)
        assert got == rows(cur.columns, cur.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
