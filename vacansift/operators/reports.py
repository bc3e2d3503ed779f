"""Digest, alert and status reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacansift import rules
from vacansift.functions import dates, places
from vacansift.functions.text import html_escape


def waiting_for_digest(store: DataFrame) -> DataFrame:
    """Postings not digested yet (an unknown flag does not count as waiting)."""
    prefixed = F.when(
        F.col("category") == rules.CATEGORY_SCHOOL,
        F.concat(F.lit(rules.SCHOOL_TITLE_PREFIX), F.col("title")),
    ).otherwise(F.col("title"))
    return store.where(F.col("digested") == F.lit(False)).select(
        "source_url",
        prefixed.alias("title"),
        "company",
        "location",
        "score",
        "tier",
        "category",
        "fetched_at",
    )


def digest_rows(store: DataFrame) -> DataFrame:
    """Digest rows, best score first, newest first; missing values lead."""
    return waiting_for_digest(store).orderBy(
        F.desc_nulls_first("score"), F.desc_nulls_first("fetched_at"), F.asc("source_url")
    )


def digest_counts(store: DataFrame) -> DataFrame:
    """Total and per-tier counts; other tiers count only in the total."""
    return waiting_for_digest(store).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("tier") == t).alias(t) for t in rules.DIGEST_COUNTS],
    )


def digest_lines(store: DataFrame, heading: str) -> DataFrame:
    """The digest as ordered text blocks; poor matches are only counted."""
    waiting = waiting_for_digest(store)
    counted = digest_counts(store).where(F.col("total") > 0)
    empty = F.lit(None)

    def text_of(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("None"))

    summary = F.concat_ws(
        "\n",
        F.lit(heading),
        F.lit(""),
        F.concat(F.col("total").cast("string"), F.lit(" new jobs since the last digest.")),
        F.lit(""),
        *[
            F.concat(F.lit(label), F.col(t).cast("string"))
            for t, label in rules.DIGEST_COUNTS.items()
        ],
        F.lit(""),
    )
    blocks = [(F.lit(0), F.lit(True), summary)]
    for i, (tier, title) in enumerate(rules.DIGEST_HEADINGS.items(), start=1):
        banner = "\n".join(["", rules.DIGEST_RULER, title, rules.DIGEST_RULER])
        blocks.append((F.lit(2 * i - 1), F.col(tier) > 0, F.lit(banner)))
    headers = counted.select(
        F.explode(
            F.array(*[F.struct(p.alias("part"), c.alias("shown"), b.alias("block")) for p, c, b in blocks])
        ).alias("h")
    ).where("h.shown")

    tiers = list(rules.DIGEST_HEADINGS)
    part = F.coalesce(*[F.when(F.col("tier") == t, 2 * i) for i, t in enumerate(tiers, start=1)])
    block = F.concat_ws(
        "\n",
        F.lit(""),
        F.concat(text_of(F.col("score")), F.lit("% — "), text_of(F.col("title"))),
        F.concat(F.lit("Company: "), text_of(F.col("company"))),
        F.concat(F.lit("Location: "), text_of(F.col("location"))),
        F.concat(F.lit("Apply: "), text_of(F.col("source_url"))),
    )
    entries = waiting.where(F.col("tier").isin(*tiers)).select(
        part.alias("part"),
        F.coalesce(F.col("score"), F.lit(0)).alias("score"),
        "fetched_at",
        "source_url",
        block.alias("block"),
    )
    return entries.unionByName(
        headers.select(
            F.col("h.part").alias("part"),
            empty.cast("int").alias("score"),
            empty.cast("timestamp").alias("fetched_at"),
            empty.cast("string").alias("source_url"),
            F.col("h.block").alias("block"),
        )
    ).orderBy(
        "part", F.desc("score"), F.desc_nulls_first("fetched_at"), F.asc("source_url")
    )


def eligibility_label(code: Column) -> Column:
    label = F.lit(rules.ELIGIBILITY_LABELS[rules.UNKNOWN])
    for value, text in rules.ELIGIBILITY_LABELS.items():
        label = F.when(code == value, F.lit(text)).otherwise(label)
    return label


def alert_text(
    eligibility: Column, score: Column, title: Column, company: Column,
    location: Column, url: Column, reasons: Column,
) -> Column:
    """One rendered alert; ``reasons`` is the ordered array of explanations."""
    label = eligibility_label(eligibility)

    def safe(value: Column) -> Column:
        return html_escape(F.coalesce(value, F.lit("")))

    shown = F.filter(
        reasons, lambda r: ~r.startswith(rules.REASON_ELIGIBILITY.strip()) & (r != label)
    )
    bullets = F.array_join(F.transform(shown, lambda r: F.concat(F.lit("• "), html_escape(r))), "\n")
    block = F.when(F.size(reasons) > 0, bullets).otherwise(F.lit(rules.ALERT_FALLBACK))
    return F.concat(
        label, F.lit("\n🎯 MATCH: "), score.cast("string"), F.lit("%\n\n💼 "), safe(title),
        F.lit("\n🏢 "), safe(company), F.lit("\n📍 "), safe(location),
        F.lit("\n\nWhy it matches:\n"), block,
        F.lit('\n\n🔗 <a href="'), safe(url), F.lit('">Apply</a>'),
    )


def status_report(store: DataFrame) -> DataFrame:
    """Totals over the store in one pass."""
    return store.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_if(F.col("telegram_sent")).alias("alerts_sent"),
        F.count_if(F.col("tier") == "strong").alias("strong_jobs"),
        F.count_if((F.col("tier") == "strong") & ~F.col("telegram_sent")).alias("strong_unsent"),
        F.count_if(F.col("digested") == F.lit(False)).alias("digest_queue"),
        F.round(F.avg("score"), 4).alias("average_score"),
    )


_STATUS = ("total_jobs", "alerts_sent", "strong_jobs", "strong_unsent", "digest_queue")


def status_sums(rows: DataFrame) -> DataFrame:
    """What ``status_report`` is made of, as sums that can be added and taken off; one row."""
    strong = F.col("tier") == "strong"
    return rows.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_if(F.col("telegram_sent")).alias("alerts_sent"),
        F.count_if(strong).alias("strong_jobs"),
        F.count_if(strong & ~F.col("telegram_sent")).alias("strong_unsent"),
        F.count_if(F.col("digested") == F.lit(False)).alias("digest_queue"),
        F.coalesce(F.sum(F.col("score").cast("long")), F.lit(0)).alias("points"),
        F.count("score").alias("scored"),
    )


def status_moved(sums: DataFrame, logged: DataFrame) -> DataFrame:
    """Sums after a scan, from those before it and the rows it logged: new versions are added, the versions they replace taken off."""
    replaced = status_sums(logged.where("old IS NOT NULL").select("old.*"))
    parts = sums.unionByName(status_sums(logged)).unionByName(replaced.select(*[(-F.col(c)).alias(c) for c in replaced.columns]))
    return parts.agg(*[F.sum(c).alias(c) for c in parts.columns])


def status_of(sums: DataFrame) -> DataFrame:
    """The report from its sums."""
    average = F.round(F.col("points") / F.nullif(F.col("scored"), F.lit(0)), 4)
    return sums.select(*_STATUS, average.alias("average_score"))


def strong_by_state(store: DataFrame) -> DataFrame:
    return (
        store.where(F.col("tier") == "strong")
        .groupBy("score", "telegram_sent")
        .agg(F.count(F.lit(1)).alias("jobs"))
    )


def send_rate(notifications: DataFrame) -> DataFrame:
    """Share of sent notifications per channel, in percent."""
    return notifications.groupBy("channel").agg(
        F.count(F.lit(1)).alias("notifications"),
        F.count_if(F.col("status") == "sent").alias("sent"),
        F.round(
            F.count_if(F.col("status") == "sent") * 100.0 / F.count(F.lit(1)), 4
        ).alias("success_rate"),
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counted = None
    for name, table in tables.items():
        row = table.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        counted = row if counted is None else counted.unionByName(row)
    return counted


def recent(store: DataFrame, limit: int = 20) -> DataFrame:
    return store.orderBy(F.desc("fetched_at"), F.asc("source_url")).limit(limit)


def nearest_first(store: DataFrame) -> DataFrame:
    return store.withColumn("zone_label", places.zone_label(F.col("zone_rank"))).orderBy(
        F.asc("zone_rank"), F.desc_nulls_last("score"), F.asc("source_url")
    )


def by_date_bucket(store: DataFrame, as_of: dt.date | Column) -> DataFrame:
    bucket = dates.date_bucket(F.col("posted_date"), as_of).alias("bucket")
    return store.groupBy(bucket).agg(F.count(F.lit(1)).alias("jobs"))
