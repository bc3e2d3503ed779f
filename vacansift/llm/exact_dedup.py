"""Exact duplicates by a heavy-hitter split.

A Misra-Gries summary (Spark's ``approx_top_k``, a frequent-items sketch of fixed size that is merged across tasks) names the digests that
may be frequent. Their groups are counted exactly, with partial aggregation before the shuffle, and the winners, at most ``heavy_items``
of them, are broadcast: rows of a winner get their answer in the task that reads them. All other digests are grouped by an ordinary shuffle,
in which no group can be large, since a digest with a large share of the rows is always among the candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacansift.llm.shared import saved, text_or_empty

# Runs of white space that are not already one blank. Replacing these by a blank is replacing every run by one.
_UNEVEN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: str = "text"):
    """The text with each run of white space as one blank; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), _UNEVEN, " ")


def exact_groups(docs: DataFrame, heavy_items: int = 256, tracked_items: int = 8192) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest (binary SHA-256 of the normalised text).

    The row with the smallest doc_id of a group stays; null ids come last, and of rows that repeat an id and a text one stays. A null text
    is an empty one. Other columns of ``docs`` are ignored; an empty table gives no rows.

    ``heavy_items`` bounds the broadcast. ``tracked_items`` is the size of the summary: a digest with more than about ``1 / (0.75 *
    tracked_items)`` of all rows is surely found, which also bounds the largest group left to the shuffle.
    """
    digests = saved(
        docs.select(
            "doc_id",
            F.unhex(F.sha2(normalised(), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ).withColumn("short", F.xxhash64("digest")),
        "digests",
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row"))
    candidates = digests.agg(
        F.expr(f"approx_top_k(short, {heavy_items}, {tracked_items})").alias("top")
    ).select(F.explode("top.item").alias("short"))
    winners = (
        digests.join(F.broadcast(candidates), "short")
        .groupBy("digest")
        .agg(first.alias("heavy_first"), F.count("*").alias("heavy_size"))
        .where("heavy_size > 1")
        .orderBy(F.desc("heavy_size"), "digest")
        .limit(heavy_items)
    )
    split = digests.join(F.broadcast(winners), "digest", "left")
    heavy = split.where("heavy_size IS NOT NULL").select(
        "doc_id", "digest", "row", F.col("heavy_first").alias("first"), F.col("heavy_size").alias("size")
    )
    group = Window.partitionBy("digest")
    light = split.where("heavy_size IS NULL").select(
        "doc_id", "digest", "row", first.over(group).alias("first"), F.count("*").over(group).alias("size")
    )
    return heavy.unionByName(light).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        "digest",
    )
