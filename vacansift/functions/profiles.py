"""Matching many profiles whose terms are rows of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PIECE = 4
#: Up to this many distinct terms every text is searched for each of them; with more, pieces of terms choose the texts first.
SEARCHED_TERMS = 128
_LISTED = "listed_terms"


def _pieces(text: Column, size: int) -> Column:
    """The distinct substrings of one length, in one pass over the text."""
    cut = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))
    return F.when(F.length(text) >= size, cut).otherwise(F.array().cast("array<string>"))


def match(texts: DataFrame, terms: DataFrame, column: str, key: str = "k") -> DataFrame:
    """One row per (text row, profile, term) where the text contains the term, which may lie across words.

    ``terms``: profile, term. ``key`` tells text rows apart. Empty terms and terms that are null match nothing.
    """
    return _hits(texts, _distinct(terms), column, key).join(terms, "term")


def term_sets(texts: DataFrame, terms: DataFrame, column: str, key: str = "k") -> DataFrame:
    """Key and sorted distinct ``terms`` of every text that has any. Texts with the same set can be counted before profiles are joined."""
    distinct = _distinct(terms)
    if _few(distinct):
        found = _searched(texts, distinct, column)
        return found.select(key, _LISTED).where(F.size(_LISTED) > 0).withColumnRenamed(_LISTED, "terms")
    return _hits(texts, distinct, column, key).groupBy(key).agg(F.array_sort(F.collect_set("term")).alias("terms"))


def _distinct(terms: DataFrame) -> DataFrame:
    return terms.select("term").where("term <> ''").distinct()


def _few(distinct: DataFrame) -> bool:
    return distinct.limit(SEARCHED_TERMS + 1).count() <= SEARCHED_TERMS


def _searched(texts: DataFrame, distinct: DataFrame, column: str) -> DataFrame:
    """Texts with the terms they hold. The list of terms is one short row, so texts are not moved."""
    listed = distinct.agg(F.array_sort(F.collect_list("term")).alias("all_terms"))
    held = F.filter("all_terms", lambda t: F.contains(F.col(column), t))
    return texts.join(F.broadcast(listed)).withColumn(_LISTED, held).select(*[c for c in texts.columns if c != column], _LISTED)


def _hits(texts: DataFrame, distinct: DataFrame, column: str, key: str) -> DataFrame:
    """One row per text row and term it contains.

    With many terms a term is looked for by its rarest piece of four characters (shorter
    terms whole): pieces of texts meet pieces of terms in an equality join on narrow rows, and only texts with a term's piece are
    searched for the term. How rare a piece is, is counted over the terms, so that one piece does not stand for many of them. At most
    four term lengths come to the driver.
    """
    others = [c for c in texts.columns if c != column]
    if _few(distinct):
        return _searched(texts, distinct, column).select(*others, F.explode(_LISTED).alias("term"))
    size = F.least(F.length("term"), F.lit(_PIECE))
    sizes = sorted(r[0] for r in distinct.select(size).distinct().collect())
    pieces = F.concat(*[F.when(size == n, _pieces(F.col("term"), n)).otherwise(F.array().cast("array<string>")) for n in sizes])
    spread = distinct.select("term", F.explode(pieces).alias("piece"))
    common = spread.groupBy("piece").agg(F.count(F.lit(1)).alias("uses"))
    anchors = spread.join(common, "piece").groupBy("term").agg(F.min_by("piece", F.struct("uses", "piece")).alias("piece"))
    parts = F.concat(*[_pieces(F.col(column), n) for n in sizes])
    likely = texts.select(key, F.explode(parts).alias("piece")).join(anchors, "piece").select(key, "term").distinct()
    return texts.join(likely, key).where(F.contains(F.col(column), F.col("term"))).select(*others, "term")
