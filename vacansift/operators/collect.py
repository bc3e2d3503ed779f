"""Bringing listings of several boards together.

Duplicates are resolved with ``min_by`` aggregates rather than windows: they
combine on the map side, so a URL that holds a large share of all rows never
has to be gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacansift import rules
from vacansift.schemas import BACKFILLED
from vacansift.session import written


def union_boards(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union in collection order; absent columns become NULL."""
    numbered = [df.withColumn("board_ord", F.lit(i)) for i, df in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def with_category(listings: DataFrame) -> DataFrame:
    """Category of a listing: its hint, or the default when NULL or empty."""
    hint = F.nullif(F.col("category_hint"), F.lit(""))
    return listings.withColumn("category", F.coalesce(hint, F.lit(rules.CATEGORY_DEFAULT)))


def known_url() -> Column:
    return F.col("source_url").isNotNull() & (F.col("source_url") != "")


def first_seen(
    listings: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """The first row per key in the given order, whole."""
    others = [c for c in listings.columns if c not in keys]
    winner = F.min_by(F.struct(*others), F.struct(*order)).alias("row")
    return listings.groupBy(*keys).agg(winner).select(*keys, "row.*")


def first_seen_backfilled(
    listings: DataFrame, order: Sequence[str], fields: Sequence[str] = BACKFILLED
) -> DataFrame:
    """First row per URL; its missing fields come from the next row that has them."""
    others = [c for c in listings.columns if c != "source_url"]
    rank = F.struct(*order)
    fills = [
        F.min_by(c, F.when(present(c), rank)).alias(f"fill_{c}") for c in fields
    ]
    rows = listings.groupBy("source_url").agg(
        F.min_by(F.struct(*others), rank).alias("row"),
        F.count(F.lit(1)).alias("copies"),
        *fills,
    )
    flat = rows.select("source_url", "row.*", "copies", *[f"fill_{c}" for c in fields])
    filled = {
        c: F.when(present(c) | (F.col("copies") == 1), F.col(c)).otherwise(F.col(f"fill_{c}"))
        for c in fields
    }
    return flat.withColumns(filled).drop("copies", *[f"fill_{c}" for c in fields])


def present(field: str) -> Column:
    """A stored field counts as missing when NULL (employment type: also '')."""
    if field == "employment_type":
        return F.col(field).isNotNull() & (F.col(field) != "")
    return F.col(field).isNotNull()


def new_only(listings: DataFrame, store: DataFrame) -> DataFrame:
    """Listings whose URL is not stored yet (only the key of the store is read)."""
    return listings.join(store.select("source_url"), "source_url", "left_anti")


def source_counts(listings: DataFrame) -> DataFrame:
    return listings.groupBy("source").agg(F.count(F.lit(1)).alias("fetched"))


def paged(crawl: DataFrame, place: Sequence[str] = ("page",)) -> DataFrame:
    """Listings an overlap-stopped crawl collects, with the page they came from.

    Every category of a board is read page by page, from page 1, until a page has no URL the board has not shown yet; pages after the stop
    are never read, so their URLs do not count as seen for later categories. Boards, categories and pages are those of the data.
    Listings without a category number are a category of their own, the last one. ``place`` may name more columns behind the page: of
    several listings of a URL on that page the first in their order is shown.

    The crawl is reduced once to the first page of each (source, URL, category) and written. Categories then follow one another, since
    each needs the URLs kept before it: every step reads its own category's rows and the narrow rows kept so far, so the work of
    all steps together grows with the crawl. Only the list of category numbers comes to the driver.
    """
    key = ["source", "source_url"]
    first = F.min(F.when(F.col("page").isNotNull(), F.struct(*place))).alias("first")
    firsts = written(crawl.groupBy(*key, "category_ord").agg(first).select(*key, "category_ord", "first.*"), "first-pages")
    found = {r[0] for r in firsts.select("category_ord").distinct().collect()}
    categories = sorted(found, key=lambda c: (c is None, c))
    kept: DataFrame | None = None
    for category in categories:
        fresh = firsts.where(F.col("category_ord").isNull() if category is None else F.col("category_ord") == category)
        if kept is not None:
            fresh = fresh.join(kept.select(*key), key, "left_anti")
        # A page that is its own number in the list of pages with fresh URLs comes before the stop.
        in_order = Window.partitionBy("source").orderBy("page")
        read = (
            fresh.select("source", "page").distinct()
            .withColumn("place", F.row_number().over(in_order))
            .where("page = place")
            .select("source", "page")
        )
        step = written(fresh.join(read, ["source", "page"]).select(*firsts.columns), "kept-pages")
        kept = step if kept is None else kept.unionByName(step)
    return firsts.limit(0) if kept is None else kept
