"""Stored tables as sources; filters on them reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def by_url(store: DataFrame, url: str) -> DataFrame:
    """The stored posting with a URL (an equality the scan can push down)."""
    return store.where(F.col("source_url") == url)


def exists(store: DataFrame, url: str) -> bool:
    return not by_url(store.select("source_url"), url).isEmpty()


def surrogate_id(url: Column) -> Column:
    """Numeric id of a posting, the same in every run. Tens of billions of URLs will share some ids: the URL stays the key."""
    return F.xxhash64(url)
