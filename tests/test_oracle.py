"""Every registered query against its SQL on another engine."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()
# the queries of the optional folder have their own tests
QUERIES = entry._own_queries()
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as from '{SF}/{table}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = duck.sql(SQL[name])
    assert sorted(expected.columns) == columns
    places = [expected.columns.index(c) for c in columns]
    got = sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr)
    want = sorted((tuple(row[i] for i in places) for row in expected.fetchall()), key=repr)
    assert len(want) > 0
    assert got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["history_id", "part_no", "markdown"]
    assert df.count() > 0
