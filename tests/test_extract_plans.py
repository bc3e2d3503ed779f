import os

import pytest
from pyspark.sql import functions as F

from vacansift.catalog import extraction_queries as X
from vacansift.catalog import relations as R
from vacansift.functions.text import collapse_whitespace, strip_whitespace
from vacansift.sources import boards

FOLDER = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("rule", [boards.psc, boards.careerpoint])
def test_titles_are_looked_for_once(spark, rule):
    """A plain filter on a computed title would be pushed down and repeat the search."""
    pages = spark.createDataFrame([(1, "")], "page_id int, html string")
    assert optimized(rule(pages, R.AS_OF)).count("regexp_extract_all(") == 1


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_pages_shuffle_narrow_columns(spark):
    plan = optimized(X.fuzu_pages(spark, FOLDER))
    assert "Leading company" in plan and "Leading company" not in plan[plan.index("RepartitionByExpression") :]


def test_white_space_short_cuts(spark):
    texts = ["a b", " a", "a ", "a  b", "a b", " a", "a ", "é", " ", "", "a\n", "\ta b\t", "é  é", None, "~", "!\x1c!"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace("t", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    runs = F.trim(F.regexp_replace("t", r"(?U)[\s\x1c-\x1f]+", " "))
    bad = df.where(~strip_whitespace(F.col("t")).eqNullSafe(plain) | ~collapse_whitespace(F.col("t")).eqNullSafe(runs))
    assert bad.collect() == []
