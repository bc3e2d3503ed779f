"""Registered queries of the operators that learn: language, secrets, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacansift.llm import language_id, quality, secrets
from vacansift.llm.registry import query
from vacansift.llm.shared import table


def remainder(modulus: int):
    """crc32 of the id as text, modulo: how rows are split into those to learn from and those held out. Null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def held_out(modulus: int, rest: int):
    """Whether a row is never learned from. Rows without an id are held out."""
    return F.coalesce(remainder(modulus) == rest, F.lit(True)).alias("held_out")


@query("op3_language_id")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    prototypes = language_id.learn(docs.where(remainder(5) != 0))
    return language_id.predict(docs, prototypes).select(
        "doc_id", held_out(5, 0), "lang_pred", "score"
    )


def _listed(spans):
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


@query("op4_secrets")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return secrets.find(docs, secrets.train(docs)).select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


@query("op8_quality")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    net = quality.train(docs, table(spark, folder, "labels").where(remainder(3) != 1))
    return quality.score(docs.select("doc_id", "text"), net).select(
        "doc_id",
        held_out(3, 1),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
