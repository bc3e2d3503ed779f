"""Repeated scans as a stream over landed listing files.

Every micro-batch is one scan against the store so far. The store is a base
snapshot plus one set of changed rows per batch, so a batch writes only what it
changed; the newest version per URL is the current row. Batches overwrite their
own folder, so a replayed batch leaves the same result. The store, not
streaming state, remembers URLs: no watermark is needed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vacansift import rules
from vacansift.operators import collect
from vacansift.plans import scan
from vacansift.schemas import LISTING, STORE
from vacansift.session import read_if_written

_CHANGED = T.StructType([*STORE.fields, T.StructField("epoch", T.LongType())])


def current(
    spark: SparkSession,
    root: str,
    base: DataFrame,
    before: int | None = None,
    urls: DataFrame | None = None,
) -> DataFrame:
    """The store after all batches, or after those before a given one.

    With ``urls`` only their rows: versions of other postings are left out
    before the wide rows are grouped. Reading starts from the last compaction, if there is one.
    """
    through = _compacted_through(spark, root)
    if through is not None and (before is None or before > through):
        base = spark.read.schema(STORE).parquet(f"{root}/base-{through}")
    else:
        through = -1
    versions = base.select(*STORE.names).withColumn("epoch", F.lit(-1).cast("long"))
    if before is None or before > 0:
        changed = spark.read.schema(_CHANGED).parquet(f"{root}/changes").where(F.col("epoch") > through)
        if before is not None:
            changed = changed.where(F.col("epoch") < before)
        versions = versions.unionByName(changed)
    if urls is not None:
        versions = versions.join(urls, "source_url", "left_semi")
    others = [c for c in STORE.names if c != "source_url"]
    newest = versions.groupBy("source_url").agg(
        F.max_by(F.struct(*others), F.col("epoch")).alias("row")
    )
    rows = newest.select("source_url", "row.*").select(*STORE.names)
    sent = read_if_written(spark, "source_url string", f"{root}/delivered")
    if sent is None:
        return rows
    sent = sent.distinct().withColumn("delivered", F.lit(True))
    marked = F.when(F.col("delivered"), F.lit(True)).otherwise(F.col("telegram_sent"))
    return rows.join(sent, "source_url", "left").withColumn("telegram_sent", marked).select(*STORE.names)


def _compacted_through(spark: SparkSession, root: str) -> int | None:
    done = read_if_written(spark, "through long", f"{root}/compactions")
    return None if done is None else done.agg(F.max("through")).first()[0]


def mark_delivered(root: str, urls: DataFrame) -> None:
    """Record postings whose alert went out: later batches find them as sent. Recording one again changes nothing."""
    urls.select("source_url").where("source_url IS NOT NULL").write.mode("append").parquet(f"{root}/delivered")


def compact(spark: SparkSession, root: str, base: DataFrame) -> None:
    """Write the store after all finished batches as a new base, so that later batches read no older change folders.

    Call it between runs. The entry in ``compactions`` comes last: a compaction that breaks off is not used, and may be repeated.
    """
    through = spark.read.schema(_CHANGED).parquet(f"{root}/changes").agg(F.max("epoch")).first()[0]
    if through is None or through == _compacted_through(spark, root):
        return
    rows = current(spark, root, base, before=through + 1)
    rows.write.mode("overwrite").parquet(f"{root}/base-{through}")
    spark.range(1).select(F.lit(through).cast("long").alias("through")).write.mode("append").parquet(f"{root}/compactions")


def alerts(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/alerts")


def run_available(
    spark: SparkSession,
    landing: str,
    root: str,
    base: DataFrame,
    details: DataFrame,
    as_of: dt.date,
    profile: rules.Profile = rules.DEFAULT_PROFILE,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Process all listing files that landed since the last run, then stop."""

    def one_scan(listings: DataFrame, epoch: int) -> None:
        session = listings.sparkSession
        # A scan changes only URLs it lists: the rest of the store is not moved.
        urls = listings.where(collect.known_url()).select("source_url").distinct()
        store = current(session, root, base, before=epoch, urls=urls)
        judged = scan.judge(listings, store, details, as_of, profile)
        # Written once: the merge and its aggregates read it back.
        staged = f"{root}/judged/epoch={epoch}"
        judged.write.mode("overwrite").parquet(staged)
        judged = session.read.schema(judged.schema).parquet(staged)
        merged = scan.merged(judged, store, as_of)
        changed = merged.where(F.col("is_new") | F.col("touched"))
        outcome = f"{root}/changes/epoch={epoch}"
        changed.write.mode("overwrite").parquet(outcome)
        changed = session.read.schema(changed.schema).parquet(outcome)
        scan.alerts(changed).write.mode("overwrite").parquet(f"{root}/alerts/epoch={epoch}")

    return (
        spark.readStream.schema(LISTING)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(landing)
        .writeStream.foreachBatch(one_scan)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
