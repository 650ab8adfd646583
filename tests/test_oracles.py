"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import datetime
import decimal
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, (decimal.Decimal, float)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name[:-8]} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n not in getattr(entry.text_queries, "ORACLES", {})))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    columns = sorted(df.columns)
    places = [list(rel.columns).index(c) for c in columns]
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=str)
    assert got == sorted((tuple(plain(r[i]) for i in places) for r in rel.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).columns
