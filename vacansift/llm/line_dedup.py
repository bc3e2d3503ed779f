"""Repeated runs of lines, found with a suffix array over line ids.

All lines of the corpus form one sequence of line ids, cut at document ends. Suffixes are ranked by prefix doubling: rank by one line, then by
two, four and so on, each time by sorting the distinct pairs of a suffix's rank and the rank that many lines further on. Suffixes whose
prefix occurs once drop out, so every round works on repeated text only. Rounds stop when the ranks cover ``run_lines`` lines: suffixes of equal
rank are then the intervals of the suffix array whose longest common prefix is at least that long. Every suffix of an interval but the
first in the corpus starts a later copy; copies that overlap or touch make up the maximal repeated runs, which are deleted.

With ``run_words`` a shorter run counts too if it has that many words, so that a passage on one line is found whatever its neighbours are, also
in a document of one line. Ranks then grow by a line each round, and the intervals of every round are looked at.

A rank is the place of a pair in a range-partitioned sort, so no task sees all pairs. Groups are only ever aggregated or joined with one
row per rank.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacansift.llm.shared import saved, text_or_empty, unused

#: Words that make a run of fewer lines than asked for count as well.
LONG_WORDS = 50
_SPACE = " \t\n\x0b\f\r"
# A line owns the blank lines after it, the first line also those before it.
_LINE_STARTS = r"(?<=\n)(?=[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D])"


def lines(text: Column) -> Column:
    """Lines of a text with their line ends; joined they are the text. A text without any visible character has none."""
    return F.when(F.trim(text, F.lit(_SPACE)) != "", F.split(text, _LINE_STARTS)).otherwise(F.array().cast("array<string>"))


def _ranked(keys: DataFrame, name: str) -> DataFrame:
    """Keys that occur more than once, with a ``rank`` in the order of the keys."""
    columns = keys.columns
    repeated = keys.groupBy(*columns).count().where("count > 1").select(*columns)
    return saved(repeated.orderBy(*columns).withColumn("rank", F.monotonically_increasing_id()), name)


def _later(active: DataFrame, place: list[str], length: int) -> DataFrame:
    """Places of the lines of every run of ``length`` lines that has an equal one before it."""
    suffix = F.struct(*place, "at")
    heads = active.groupBy("rank").agg(F.min(suffix).alias("head"))
    return (
        active.join(heads, "rank")
        .where(suffix > F.col("head"))
        .select(*place, F.explode(F.sequence("at", F.col("at") + (length - 1))).alias("at"))
    )


def later_copies(docs: DataFrame, run_lines: int = 2, run_words: int | None = LONG_WORDS) -> DataFrame:
    """Numbers (from 0) of the lines to delete, per document: doc_id, key (hash of the text), deleted (sorted array)."""
    place = ["doc_id", "key"]
    listed = docs.select("doc_id", text_or_empty().alias("text")).select(
        "doc_id", F.xxhash64("text").alias("key"), F.posexplode(lines(F.col("text"))).alias("at", "line")
    )
    content = F.trim("line", F.lit(_SPACE))
    # ``own`` are the words of a line, ``words`` those of all lines that a rank covers.
    own = F.lit(0) if run_words is None else F.size(F.split(content, r"[\x20\x09-\x0D]+"))
    ids = saved(
        listed.select(
            *place,
            "at",
            F.xxhash64(content).alias("id_a"),
            F.xxhash64(F.concat(F.lit("\n"), content)).alias("id_b"),
            own.alias("own"),
        ),
        "line-ids",
    )
    first = _ranked(ids.select("id_a", "id_b"), "line-ranks")
    active = ids.join(first, ["id_a", "id_b"]).select(*place, "at", "rank", "own", F.col("own").alias("words"))
    active = active.repartition(*place).distinct()
    copies = []
    covered = 1
    while covered < run_lines:
        if run_words is not None:
            copies.append(_later(active.where(F.col("words") >= run_words), place, covered))
        step = min(covered, run_lines - covered) if run_words is None else 1
        ahead = Window.partitionBy(*place).orderBy("at").rangeBetween(step, step)
        following = {"next": F.first("rank").over(ahead), "words": F.col("own") + F.first("words").over(ahead)}
        pairs = saved(active.withColumns(following).where("next IS NOT NULL"), "line-pairs")
        named = _ranked(pairs.select(F.col("rank").alias("this"), "next"), "pair-ranks")
        active = (
            pairs.withColumnRenamed("rank", "this").join(named, ["this", "next"]).select(*place, "at", "rank", "own", "words")
        )
        covered += step
    copies.append(_later(active, place, run_lines))
    return reduce(DataFrame.unionByName, copies).groupBy(*place).agg(F.array_sort(F.collect_set("at")).alias("deleted"))


def dedup(docs: DataFrame, run_lines: int = 2, run_words: int | None = LONG_WORDS) -> DataFrame:
    """All input columns, ``text`` without later copies of runs of at least ``run_lines`` lines, and n_lines, n_removed.

    Runs of fewer lines count as well if they have at least ``run_words`` words, stretches without white space; with None only lines are counted.
    Lines are compared without the white space around them, blank lines go with the line before them, and documents are ordered by doc_id
    (null first), then by a hash of their text. The first copy of a run stays, in whichever document it stands; copies within a document count
    as well. Rows that repeat id and text are one document: they get the same result and are not copies of each other. A null text stays
    null, an empty one empty; an empty table gives no rows. Input columns with the names of results are replaced.
    """
    columns = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    doc, key, deleted, own_parts = unused(docs.columns, "doc", "key", "deleted", "parts")
    copies = later_copies(docs, run_lines, run_words).select(
        F.col("doc_id").alias(doc), F.col("key").alias(key), F.col("deleted").alias(deleted)
    )
    joined = docs.select(*columns, "text").join(
        copies,
        F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64(text_or_empty()) == F.col(key)),
        "left",
    )
    parts = lines(F.col("text"))
    n = F.size(own_parts)
    # Between two deleted lines lies a kept stretch, which may be empty.
    stretches = F.zip_with(
        F.concat(F.array(F.lit(-1)), deleted),
        F.concat(deleted, F.array(n)),
        lambda a, b: F.struct((a + 2).alias("start"), (b - a - 1).alias("length")),
    )
    kept = F.array_join(F.flatten(F.transform(stretches, lambda s: F.slice(own_parts, s["start"], s["length"]))), "")
    return joined.withColumn(own_parts, parts).select(
        *columns,
        F.when(F.col(deleted).isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.size(own_parts).cast("long").alias("n_lines"),
        F.when(F.col(deleted).isNull(), 0).otherwise(F.size(deleted)).cast("long").alias("n_removed"),
    )
