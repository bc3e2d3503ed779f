"""Digest and status reports over the derived store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacansift.catalog import relations as R
from vacansift.catalog.registry import query, sql_stamp, stamp
from vacansift.operators import outbox, reports
from vacansift.sources.tables import table

HEADING = "POSTING DIGEST"
_WAITING = f"""{R.FULL_STORE_SQL}, waiting AS (
  SELECT *, CASE WHEN category = 'FORM4' THEN '🎓 [Form 4] ' || title ELSE title END AS shown
  FROM store WHERE digested = false)"""


@query(
    "digest_rows",
    f"""WITH {_WAITING} SELECT source_url, shown AS title, company, location, score, tier, category,
      {sql_stamp('fetched_at')} FROM waiting""",
)
def digest_rows(spark: SparkSession, folder: str) -> DataFrame:
    return reports.digest_rows(R.full_store(spark, folder)).select(
        "source_url", "title", "company", "location", "score", "tier", "category", stamp("fetched_at")
    )


_COUNTS = (
    "count(*) AS total, count(*) FILTER (WHERE tier = 'strong') AS strong, "
    "count(*) FILTER (WHERE tier = 'consider') AS consider, count(*) FILTER (WHERE tier = 'poor') AS poor"
)


@query("digest_counts", f"WITH {_WAITING} SELECT {_COUNTS} FROM waiting")
def digest_counts(spark: SparkSession, folder: str) -> DataFrame:
    return reports.digest_counts(R.full_store(spark, folder))


_RULER = "=" * 50
_BLOCK = (
    "chr(10) || coalesce(score::VARCHAR, 'None') || '% — ' || shown || chr(10) || 'Company: ' || company || chr(10) "
    "|| 'Location: ' || location || chr(10) || 'Apply: ' || source_url"
)


@query(
    "digest_lines",
    f"""WITH {_WAITING}, n AS (SELECT {_COUNTS} FROM waiting)
    SELECT 0::INT AS part, NULL::INT AS score, NULL::VARCHAR AS source_url, '{HEADING}' || chr(10) || chr(10) || total ||
      ' new jobs since the last digest.' || chr(10) || chr(10) || '🟢 Strong matches: ' || strong || chr(10) ||
      '🟡 Worth considering: ' || consider || chr(10) || '🔴 Poor matches: ' || poor || chr(10) AS block FROM n
    UNION ALL SELECT 1, NULL, NULL, chr(10) || '{_RULER}' || chr(10) || '🟢 STRONG MATCHES' || chr(10) || '{_RULER}' FROM n WHERE strong > 0
    UNION ALL SELECT 3, NULL, NULL, chr(10) || '{_RULER}' || chr(10) || '🟡 WORTH CONSIDERING' || chr(10) || '{_RULER}' FROM n WHERE consider > 0
    UNION ALL SELECT CASE tier WHEN 'strong' THEN 2 ELSE 4 END, coalesce(score, 0), source_url, {_BLOCK}
      FROM waiting WHERE tier IN ('strong', 'consider')""",
)
def digest_lines(spark: SparkSession, folder: str) -> DataFrame:
    return reports.digest_lines(R.full_store(spark, folder), HEADING).select(
        "part", "score", "source_url", "block"
    )


@query(
    "status_report",
    f"""WITH {R.FULL_STORE_SQL} SELECT count(*) AS total_jobs, count(*) FILTER (WHERE telegram_sent) AS alerts_sent,
      count(*) FILTER (WHERE tier = 'strong') AS strong_jobs,
      count(*) FILTER (WHERE tier = 'strong' AND NOT telegram_sent) AS strong_unsent,
      count(*) FILTER (WHERE digested = false) AS digest_queue, round(avg(score), 4) AS average_score FROM store""",
)
def status_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.status_report(R.full_store(spark, folder))


@query(
    "strong_by_state",
    f"WITH {R.FULL_STORE_SQL} SELECT score, telegram_sent, count(*) AS jobs FROM store WHERE tier = 'strong' GROUP BY ALL",
)
def strong_by_state(spark: SparkSession, folder: str) -> DataFrame:
    return reports.strong_by_state(R.full_store(spark, folder))


@query(
    "send_rate",
    f"""WITH {R.DELIVERIES_SQL}, last AS (SELECT source_url, channel,
      arg_max(outcome, (moment, event_id)) FILTER (WHERE outcome <> 'pending') AS status FROM deliveries GROUP BY ALL)
    SELECT channel, count(*) AS notifications, count(*) FILTER (WHERE status = 'sent') AS sent,
      round(count(*) FILTER (WHERE status = 'sent') * 100.0 / count(*), 4)::DOUBLE AS success_rate FROM last GROUP BY channel""",
)
def send_rate(spark: SparkSession, folder: str) -> DataFrame:
    rate = reports.send_rate(outbox.fold(R.deliveries(spark, folder)))
    return rate.withColumn("success_rate", F.col("success_rate").cast("double"))


_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)


@query(
    "table_counts",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _TABLES),
)
def table_counts(spark: SparkSession, folder: str) -> DataFrame:
    return reports.table_counts({t: table(spark, folder, t) for t in _TABLES})


@query(
    "recent_20",
    f"""WITH {R.FULL_STORE_SQL} SELECT source_url, title, score, {sql_stamp('fetched_at')} FROM
      (SELECT * FROM store ORDER BY fetched_at DESC, source_url LIMIT 20)""",
)
def recent_20(spark: SparkSession, folder: str) -> DataFrame:
    return reports.recent(R.full_store(spark, folder)).select(
        "source_url", "title", "score", stamp("fetched_at")
    )


@query(
    "nearest_first",
    f"""WITH {R.FULL_STORE_SQL} SELECT source_url, zone_rank, score, CASE zone_rank WHEN 0 THEN '📍 Malindi & Kilifi'
      WHEN 1 THEN '🌴 Coast' WHEN 2 THEN '🏙 Nairobi area' WHEN 3 THEN 'Eldoret' WHEN 4 THEN 'Narok & Mara'
      WHEN 9 THEN 'Elsewhere in Kenya' END AS zone_label FROM store""",
)
def nearest_first(spark: SparkSession, folder: str) -> DataFrame:
    return reports.nearest_first(R.full_store(spark, folder)).select(
        "source_url", "zone_rank", "score", "zone_label"
    )


@query(
    "company_digest",
    f"""WITH {R.FULL_STORE_SQL} SELECT c.c_mktsegment AS segment, s.tier, count(*) AS jobs, round(avg(s.score), 4) AS average_score
    FROM store s JOIN customer c ON s.company = c.c_name WHERE s.digested = false GROUP BY ALL""",
)
def company_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Waiting postings per customer segment and tier."""
    customers = table(spark, folder, "customer").select(
        F.col("c_name").alias("company"), F.col("c_mktsegment").alias("segment")
    )
    waiting = reports.waiting_for_digest(R.full_store(spark, folder)).select("company", "tier", "score")
    return waiting.join(customers, "company").groupBy("segment", "tier").agg(
        F.count(F.lit(1)).alias("jobs"), F.round(F.avg("score"), 4).alias("average_score")
    )
