"""Benchmark decontamination by winnowed word fingerprints.

Words are hashed, hashes of ``GRAM`` consecutive words are combined by doubling, and of every ``WINDOW - GRAM + 1`` consecutive gram hashes
the smallest is kept. Any span of ``WINDOW`` words that a document shares with an item therefore has a kept gram on both sides, at the
same place of the span. Kept grams of documents meet those of items in one hash join; each hit is extended over the words around it, and
spans of ``WINDOW`` equal words count. Items of fewer words are one window of their own length, whose only gram is the whole item.

Everything is built-in expressions. Document texts are never shuffled: the join sees them in the task that reads them, and what leaves it
are the hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacansift.functions.text import once
from vacansift.llm.shared import ascii_lower, saved, text_or_empty

WINDOW = 13
GRAM = 8
_GAP = WINDOW - GRAM  # a kept gram starts at most this far into its window
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of item grams up to which they are broadcast; beyond it the join shuffles.
BROADCAST_GRAMS = 500_000


def words(text: Column) -> Column:
    """Words in their own case."""
    return F.array_remove(F.split(text, _SEPARATORS), "")


def _shifted(values: Column, by: int) -> Column:
    return F.slice(values, F.lit(by + 1), F.greatest(F.size(values) - by, F.lit(0)))


def _joined(left: Column, right: Column, by: int) -> Column:
    return F.zip_with(left, _shifted(right, by), lambda a, b: F.xxhash64(a, b))


def _smaller(values: Column, by: int) -> Column:
    return F.zip_with(values, _shifted(values, by), lambda a, b: F.least(a, b))


def _gram_list(all_words: Column, short: list[int], whole: bool) -> Column:
    """Array of (size, at, hash), ``at`` from 1: kept grams of a word list.

    ``short`` are the lengths of short items to make whole grams of. ``whole``: the list is an item, so one of fewer than WINDOW words has
    only the gram of its own length. ``once`` binds each array, so that none is computed again per element.
    """
    n = F.size(all_words)

    def gram(size: int, at: Column, value: Column) -> Column:
        return F.struct(F.lit(size).alias("size"), at.alias("at"), value.alias("hash"))

    def long_grams(h8: Column) -> Column:
        def kept(m6: Column) -> Column:
            return F.filter(
                F.sequence(F.lit(1), n - (GRAM - 1)),
                lambda p: F.get(h8, p - 1)
                == F.array_max(F.slice(m6, F.greatest(p - _GAP, F.lit(1)), F.least(p, F.lit(_GAP + 1)))),
            )

        def windows(m4: Column) -> Column:
            return F.slice(_smaller(m4, 2), F.lit(1), n - (WINDOW - 1))

        places = once(_smaller(h8, 1), lambda m2: once(_smaller(m2, 2), lambda m4: once(windows(m4), kept)))
        return F.transform(places, lambda p: gram(WINDOW, p, F.get(h8, p - 1)))

    def short_grams(size: int, levels: dict[int, Column]) -> Column:
        value, covered = None, 0
        for step in (8, 4, 2, 1):
            if size & step:
                value = levels[step] if value is None else _joined(value, levels[step], covered)
                covered += step
        made = F.transform(
            F.slice(value, F.lit(1), F.greatest(n - (size - 1), F.lit(0))), lambda h, i: gram(size, i + 1, h)
        )
        return F.when(n == size, made) if whole else made

    def all_grams(h1: Column, h2: Column, h4: Column, h8: Column) -> Column:
        none = F.array().cast("array<struct<size:int,at:int,hash:bigint>>")
        parts = [F.when(n >= WINDOW, once(F.slice(h8, F.lit(1), n - (GRAM - 1)), long_grams))]
        parts += [short_grams(size, {1: h1, 2: h2, 4: h4, 8: h8}) for size in short]
        return F.concat(*[F.coalesce(part, none) for part in parts])

    # Full lower-casing only makes hashes meet more often; words are compared exactly later.
    hashes = F.transform(all_words, lambda w: F.xxhash64(F.lower(w)))
    return once(
        hashes,
        lambda h1: once(
            _joined(h1, h1, 1),
            lambda h2: once(
                _joined(h2, h2, 2), lambda h4: once(_joined(h4, h4, 4), lambda h8: all_grams(h1, h2, h4, h8))
            ),
        ),
    )


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per input row: doc_id, key (hash of the text), n_words, n_hit, item_ids (sorted as strings).

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored. A word is hit when a window of an item that
    covers it occurs in the document. Null and empty texts have no words; items without words match nothing. Rows are told apart by id
    and text, so repeated rows get equal answers; a null id is an id like any other. Empty tables: no items give no hits, no documents no rows.
    """
    lists = items.select("item_id", words(text_or_empty()).alias("words"))
    short = sorted(
        r[0] for r in lists.select(F.size("words").alias("n")).where(f"n BETWEEN 1 AND {WINDOW - 1}").distinct().collect()
    )
    item_grams = (
        lists.select(
            "item_id", F.col("words").alias("item_words"), F.explode(_gram_list(F.col("words"), short, True)).alias("g")
        )
        .select(
            "item_id",
            F.col("g.size").alias("item_size"),
            F.col("g.hash").alias("item_hash"),
            F.least(F.col("g.at"), F.lit(_GAP + 1)).alias("item_at"),
            _around(F.col("item_words"), F.col("g.at"), F.col("g.size")).alias("item_words"),
        )
        .dropDuplicates()
    )
    if item_grams.count() <= BROADCAST_GRAMS:
        item_grams = F.broadcast(item_grams)
    keyed = docs.select("doc_id", text_or_empty().alias("text")).withColumn("key", F.xxhash64("text"))
    found = (
        keyed.select("doc_id", "key", words(F.col("text")).alias("words"))
        .select("doc_id", "key", "words", F.explode(_gram_list(F.col("words"), short, False)).alias("g"))
        .join(item_grams, (F.col("g.hash") == F.col("item_hash")) & (F.col("g.size") == F.col("item_size")))
        .select(
            "doc_id", "key", "item_id", F.col("g.size").alias("size"), F.col("g.at").alias("at"),
            F.least(F.col("g.at"), F.lit(_GAP + 1)).alias("doc_at"), "item_at", "item_words",
            _around(F.col("words"), F.col("g.at"), F.col("g.size")).alias("doc_words"),
        )
    )
    starts = saved(_extended(found), "contaminated-windows")  # read twice below
    covered = (
        starts.select("doc_id", "key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("at"))
        .distinct()
        .groupBy("doc_id", "key")
        .agg(F.count("*").alias("n_hit"))
    )
    met = starts.groupBy("doc_id", "key").agg(F.collect_set("item_id").alias("ids"))
    counts = keyed.select("doc_id", "key", F.regexp_count("text", F.lit(_WORD)).cast("long").alias("n_words"))
    same = ["doc_id", "key"]
    return (
        _left(_left(counts, covered, same), met, same)
        .select(
            "doc_id",
            "key",
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.array_sort(F.transform(F.coalesce("ids", F.array().cast("array<bigint>")), lambda i: i.cast("string"))).alias("item_ids"),
        )
    )


def _left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join that takes null for a value."""
    other = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(other, on, "left").drop(*[f"_{k}" for k in keys])


def _around(all_words: Column, at: Column, size: Column) -> Column:
    """The words of all windows that hold the gram at ``at``; the gram is then at ``least(at, _GAP + 1)``."""
    long = size == WINDOW
    return F.slice(
        all_words,
        F.when(long, F.greatest(at - _GAP, F.lit(1))).otherwise(at),
        F.when(long, F.least(at - 1, F.lit(_GAP)) + WINDOW).otherwise(size),
    )


def _extended(found: DataFrame) -> DataFrame:
    """Starts (in the document, from 1) of the windows that are equal word for word around a hit."""
    spot = F.when(F.col("size") == WINDOW, F.col("doc_at")).otherwise(F.lit(1))
    item_spot = F.when(F.col("size") == WINDOW, F.col("item_at")).otherwise(F.lit(1))
    lower = F.transform("doc_words", ascii_lower)
    item_lower = F.transform("item_words", ascii_lower)
    rows = (
        found.withColumn("a", lower)
        .withColumn("b", item_lower)
        .withColumn("da", spot)
        .withColumn("db", item_spot)
        # Windows start 0 to `most` words before the gram, within both sides.
        .withColumn("most", F.least(F.col("da"), F.col("db")) - 1)
        .withColumn(
            "backs",
            F.when(
                F.size("a") + F.size("b") > 0,
                F.filter(
                    F.sequence(F.lit(0), F.col("most")),
                    lambda back: (F.col("da") - back + F.col("size") - 1 <= F.size("a"))
                    & (F.col("db") - back + F.col("size") - 1 <= F.size("b"))
                    & (F.slice("a", F.col("da") - back, F.col("size")) == F.slice("b", F.col("db") - back, F.col("size"))),
                ),
            ),
        )
    )
    return (
        rows.select("doc_id", "key", "item_id", "size", "at", F.explode("backs").alias("back"))
        .select("doc_id", "key", "item_id", "size", (F.col("at") - F.col("back")).alias("start"))
        .distinct()
    )
