"""Every registered query against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of
from vacansift.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = con.execute(entry.oracle_sql()[name])
    got = rows_of(df.columns, df.collect())
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
