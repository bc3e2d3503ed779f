"""Incremental scans over derived listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacansift import rules
from vacansift.catalog import relations as R
from vacansift.catalog.registry import query
from vacansift.catalog.store_queries import SCAN_SQL
from vacansift.operators import store as stores
from vacansift.schemas import LISTING
from vacansift.session import new_folder
from vacansift.sources import details as detail_pages
from vacansift.streaming import incremental

_COLUMNS = (
    "source_url, source, title, score, tier, category, zone_rank, eligibility, employment_type, "
    "posted_date, deadline_date, reasons, blockers, description"
)


@query("incremental_scan", f"WITH {SCAN_SQL} SELECT {_COLUMNS} FROM merged")
def incremental_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Listings land board group by board group; each landing is scanned alone.

    The final store equals that of one scan over all listings.
    """
    root = new_folder(spark, "incremental")
    landing, base_path, pages_path = f"{root}/landing", f"{root}/base", f"{root}/details"
    stores.write_snapshot(R.store(spark, folder), base_path)
    base = stores.read_snapshot(spark, base_path)
    detail_pages.parse(R.details(spark, folder)).write.parquet(pages_path)
    pages = spark.read.parquet(pages_path)
    listed = R.postings(spark, folder).select(*LISTING.names)
    half = len(rules.BOARDS) // 2
    for group in (rules.BOARDS[:half], rules.BOARDS[half:]):
        listed.where(F.col("source").isin(*group)).write.mode("append").parquet(landing)
        incremental.run_available(spark, landing, root, base, pages, R.AS_OF).awaitTermination()
    return incremental.current(spark, root, base).select(*_COLUMNS.split(", "))
