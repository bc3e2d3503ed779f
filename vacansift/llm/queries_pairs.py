"""Registered queries on shared word runs: the similarity join and repeated passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vacansift.llm import jaccard_join, substring_dedup
from vacansift.llm.registry import query
from vacansift.llm.shared import table


@query("op7_substring_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return substring_dedup.dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op9_jaccard_join")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.join(table(spark, folder, "documents"))
