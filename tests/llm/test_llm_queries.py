"""Registered corpus queries against their SQL, at the smallest scale."""

import os

import duckdb
import pytest

from check import TABLES, rows_of
from vacansift.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    cursor = con.execute(SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_a_row_per_document(spark, name):
    ids = {r[0] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
    rows = QUERIES[name](spark, FOLDER).collect()
    assert len(rows) == len(ids) and {r["doc_id"] for r in rows} == ids
