"""Registered query: token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacansift.llm import token_counts
from vacansift.llm.queries_pieces import model_path
from vacansift.llm.registry import query
from vacansift.llm.shared import table

#: Tokens that a document may have before it counts as over the limit.
LIMIT = 2048


@query("op12_token_counts")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    definition = token_counts.read(model_path("word_bpe_49k.json"))
    rows = token_counts.count_tokens(table(spark, folder, "documents"), definition)
    return rows.withColumn("over_limit", F.col("n_tokens") > LIMIT)
