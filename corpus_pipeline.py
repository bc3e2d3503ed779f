"""From documents to training ids: quality, repeated lines, near copies, contamination, SentencePiece.

``STAGES`` lists the stages in order. Each takes (spark, docs, folder), where ``docs`` is all that the stage before it kept, and returns a
DataFrame, which is written and read again before the next one. All but the last return the columns of ``documents``. Further columns of the input
pass through; a table without rows gives one without rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacansift.llm import decontaminate, jaccard_join, line_dedup, pieces, quality
from vacansift.llm.queries_exact import is_contaminated
from vacansift.llm.queries_models import remainder
from vacansift.llm.queries_pieces import model_path
from vacansift.llm.shared import saved, table, text_or_empty, unused
from vacansift.operators import collect


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more; it learns from the labels that are not held out."""
    net = quality.train(docs, table(spark, folder, "labels").where(remainder(3) != 1))
    return quality.score(docs, net).where("score >= 0.5").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without later copies of runs of two lines or of a line of 50 words. A document that consists of nothing else goes; ``n_chars`` follows the text."""
    cut = line_dedup.dedup(docs).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each component of linked documents: that with the smallest id (null last), then the smallest hash of the text.

    Rows that repeat an id and a text, null ids and blank texts included, are one document, of which the first row stays. A text without
    words links with nothing. Rows of one id with different texts are different documents.
    """
    *place, row = unused([*docs.columns, "component"], "missing", "id", "digest", "row_number")
    found = jaccard_join.members(docs).select(*_named(F.col("key"), place), "component")
    linked = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(*place)).alias("first"))
    chosen = linked.select("first.*").unionByName(found.where("component IS NULL").select(*place)).distinct()
    rows = docs.select("*", *_named(F.xxhash64(text_or_empty()), place), F.monotonically_increasing_id().alias(row))
    return collect.first_seen(rows, place, [row]).join(chosen, place, "left_semi").select(*docs.columns)


def _named(key: Column, names: list[str]) -> list[Column]:
    """Columns that tell documents apart, without nulls: whether the id is missing, the id and a hash of the text."""
    doc_id = F.col("doc_id").cast("long")
    return [c.alias(n) for c, n in zip((doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), key), names, strict=True)]


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stands in windows shared with benchmark items."""
    found = decontaminate.contamination(docs, table(spark, folder, "benchmark")).where(is_contaminated())
    doc, key = unused(docs.columns, "doc", "digest")
    bad = found.select(F.col("doc_id").alias(doc), F.col("key").alias(key))
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64(text_or_empty()) == F.col(key))
    return docs.join(bad, same, "left_anti").select(*docs.columns)


def to_ids(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Ids of every text, and digests of the ids and of what they decode to."""
    rows = pieces.round_trip(docs.select("doc_id", "source", "lang", "text"), pieces.read_model(model_path()))
    return rows.select(
        "doc_id",
        "source",
        "lang",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(pieces.joined_ids(), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("pieces", to_ids),
]

#: Classifier, near-duplicate components and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, folder), f"stage-{name}")
    return docs
