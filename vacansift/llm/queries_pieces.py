"""Registered query: SentencePiece encoding and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacansift.llm import pieces
from vacansift.llm.registry import query
from vacansift.llm.shared import table


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public vocabulary lies on the driver; tasks get what was read from it."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op10_pieces")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = pieces.read_model(model_path())
    rows = pieces.round_trip(table(spark, folder, "documents").select("doc_id", "text"), vocabulary)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(pieces.joined_ids(), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
