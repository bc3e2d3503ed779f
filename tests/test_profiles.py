import pytest
from pyspark.sql import functions as F

from vacansift.functions import profiles

TERMS = [("a", "sql"), ("a", "java"), ("b", "java"), ("b", ""), ("c", None), ("b", "data entry"), ("c", "\U0001f600 ok"), ("c", "c#")]
TEXTS = [
    (1, "java and sql"), (2, "javascript"), (3, "big data entry"), (4, None), (5, ""), (6, "so \U0001f600\U0001f600 okay"), (7, "c"),
]


@pytest.mark.parametrize("limit", [128, 0])
def test_both_ways_find_the_same_terms(spark, monkeypatch, limit):
    monkeypatch.setattr(profiles, "SEARCHED_TERMS", limit)
    terms = spark.createDataFrame(TERMS, "profile string, term string")
    texts = spark.createDataFrame(TEXTS, "k int, body string")
    want = {(k, p, t) for k, body in TEXTS for p, t in TERMS if t and body and t in body}
    assert {tuple(r) for r in profiles.match(texts, terms, "body").select("k", "profile", "term").collect()} == want
    sets = {r["k"]: r["terms"] for r in profiles.term_sets(texts, terms, "body").collect()}
    assert sets == {k: sorted({t for i, _, t in want if i == k}) for k, *_ in want}


def test_few_terms_leave_texts_in_place(spark, capsys):
    """Texts are neither spread into pieces nor shuffled for a short list of terms."""
    terms = spark.createDataFrame(TERMS, "profile string, term string")
    texts = spark.range(100).select(F.col("id").alias("k"), F.lit("java").alias("body"))
    profiles.term_sets(texts, terms, "body").explain()
    plan = capsys.readouterr().out
    above = plan[: plan.index("Range")]
    assert "SortMergeJoin" not in plan and "Generate" not in plan and "hashpartitioning(k" not in above


def test_no_terms_match_nothing(spark):
    terms = spark.createDataFrame([("a", ""), ("b", None)], "profile string, term string")
    texts = spark.createDataFrame(TEXTS, "k int, body string")
    assert profiles.match(texts, terms, "body").isEmpty() and profiles.term_sets(texts, terms, "body").isEmpty()
