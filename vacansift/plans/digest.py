"""One digest: report first, then flag exactly the reported rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacansift.operators import changelog, reports
from vacansift.operators import store as stores
from vacansift.session import read_if_written


def run(store: DataFrame, as_of: dt.date | Column, heading: str, path: str) -> DataFrame:
    """Write the report, then return the store with its rows marked as digested.

    A failed write raises before anything is marked. Rows that were only
    counted are marked as well.
    """
    reports.digest_lines(store, heading).write.mode("errorifexists").parquet(path)
    return mark_reported(store, as_of)


def mark_reported(store: DataFrame, as_of: dt.date | Column) -> DataFrame:
    """The reported rows are exactly those waiting, so no join is needed."""
    waiting = F.col("digested") == F.lit(False)
    return store.withColumns(
        {
            "updated_at": F.when(waiting, stores.moment(as_of)).otherwise(F.col("updated_at")),
            "digested": F.when(waiting, F.lit(True)).otherwise(F.col("digested")),
        }
    )


def run_logged(spark: SparkSession, log: changelog.Log, epoch: int, as_of: dt.date | Column, heading: str, root: str) -> None:
    """Report on a logged store and mark what was reported, as one commit.

    The keys of the waiting rows are written first, then a marker that names them, the report (``root/report``) and the marks, which are appended to the
    log under ``epoch``. A run that broke off is run again under its epoch: behind the marker it takes the keys that are written, so the report and
    the marks are those of the same rows, whatever was added in between.
    """
    keys, marker, report = (f"{root.rstrip('/')}/{part}/epoch={int(epoch)}" for part in ("keys", "marker", "report"))
    named = read_if_written(spark, "epoch long", marker)
    if named is None or named.isEmpty():
        waiting = reports.waiting_for_digest(changelog.current(spark, log))
        waiting.select("source_url").write.mode("overwrite").parquet(keys)
        spark.range(1).select(F.lit(epoch).cast("long").alias("epoch")).write.mode("overwrite").parquet(marker)
    urls = spark.read.schema("source_url string").parquet(keys)
    before = changelog.overlaid(spark.table(log.base), changelog.newest(spark, log, before=epoch))
    reported = before.join(urls, "source_url", "left_semi")
    reports.digest_lines(reported, heading).write.mode("overwrite").parquet(report)
    marks = stores.marked_changes(changelog.versions(spark, log, before=epoch), urls, "digested", as_of)
    changelog.append(marks, log, epoch)
