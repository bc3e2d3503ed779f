"""Connected components of a links table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacansift.llm.shared import saved


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: link each larger neighbour with the smallest of the neighbourhood. Small star: the same among the smaller ones."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    kept = joined.where("v > u") if large else joined
    out = kept.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node has two parents, or a parent and a child."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    both = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return both.where("up > 1 OR (up = 1 AND down = 1)").count() > 0


def components(links: DataFrame) -> DataFrame:
    """``node``, ``label``: the smallest node reachable, for every node of ``links`` (columns a, b; longs) but the labels themselves.

    Every round is written, so lineage stays short; the number of rounds grows with the logarithm of the longest path. Nothing but a
    count per round comes to the driver.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = saved(edges, "edges")
    while _unfinished(edges):
        edges = saved(_stars(_stars(edges, True), False), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
