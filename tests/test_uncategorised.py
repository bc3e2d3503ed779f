"""Pages without a category number."""

import datetime as dt

from vacansift.operators import collect
from vacansift.plans import ingest


def test_listings_without_a_category_number_come_last(spark):
    rows = [("b", "u1", 1, 1), ("b", "u2", None, 1), ("b", "u1", None, 1), ("b", "u3", None, 2), ("b", "u1", None, 3), ("b", "u9", None, 4)]
    crawl = spark.createDataFrame(rows, "source string, source_url string, category_ord int, page int")
    assert {tuple(r) for r in collect.paged(crawl).collect()} == {("b", "u1", 1, 1), ("b", "u2", None, 1), ("b", "u3", None, 2)}


def test_board_listings_keep_pages_without_a_category_number(spark, monkeypatch):
    schema = "source string, source_url string, category_ord int, page int, page_id int, pos int"
    cards = spark.createDataFrame([("b", "u1", 1, 1, 1, 0), ("b", "u2", None, 1, 2, 0), ("b", "u2", None, 1, 2, 1)], schema)
    monkeypatch.setattr(ingest.boards, "extract", lambda pages, as_of: pages)
    found = ingest.board_listings(cards, dt.date(2026, 1, 1)).collect()
    assert {(r["source_url"], r["category_ord"], r["pos"]) for r in found} == {("u1", 1, 0), ("u2", None, 0)}
