"""The posting store: snapshots in, changed snapshots out.

A snapshot has one row per ``source_url``. Every operation returns a new
DataFrame; writing it to a new path is the caller's commit.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacansift import rules
from vacansift.functions import places
from vacansift.functions.text import join_parts
from vacansift.operators.collect import present
from vacansift.schemas import BACKFILLED, STORE, STORE_DEFAULTS

PAYLOAD = (
    "source", "title", "company", "location", "description", "score", "tier",
    "eligibility", "employment_type", "posted_date", "deadline_date", "category",
    "zone_rank", "reasons", "blockers",
)


def moment(as_of: dt.date | Column) -> Column:
    return (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast("timestamp")


def payload(scored: DataFrame) -> DataFrame:
    """Stored form of a scored posting."""
    return scored.withColumns(
        {
            "employment_type": F.nullif(F.col("employment_type"), F.lit("")),
            "zone_rank": places.zone_rank(F.col("location"), F.col("title")),
            "reasons": join_parts(F.col("reasons")),
            "blockers": join_parts(F.col("blockers")),
        }
    )


def collapse(
    rows: DataFrame, order: Sequence[str], display: Sequence[str] = ("title",)
) -> DataFrame:
    """One row per URL: what a row-by-row upsert in ``order`` would do to it.

    ``rows`` carry the payload columns and two flags: ``inserts`` (the row may
    create the URL) and ``fills`` (the row may also fill missing fields of an
    existing one), and ``rejected`` where rows can be refused. Result: the inserting row (``row``), the ``display`` fields of
    the first filling row (``latest``), a ``fill_<field>`` per backfilled field
    and the numbers of filling and of refused rows.
    """
    refused = F.col("rejected") if "rejected" in rows.columns else F.lit(False)
    rank = F.struct(*order)
    inserting = F.when(F.col("inserts"), rank)
    filling = F.when(F.col("fills"), rank)
    fills = [
        F.min_by(c, F.when(F.col("fills") & present(c), rank)).alias(f"fill_{c}")
        for c in BACKFILLED
    ]
    return rows.groupBy("source_url").agg(
        F.min_by(F.struct(*PAYLOAD), inserting).alias("row"),
        F.min(inserting).alias("first_rank"),
        F.min_by(F.struct(*display), filling).alias("latest"),
        F.count_if(F.col("fills")).alias("n_fills"),
        F.count_if(refused).alias("n_rejected"),
        *fills,
    )


def merge(store: DataFrame, batch: DataFrame, as_of: dt.date | Column) -> DataFrame:
    """Full outer merge of a snapshot with a collapsed batch.

    Both sides have one row per URL, so no key is hot. Result: the store
    columns plus ``is_new``, ``touched``, ``in_store`` and the batch's
    ``n_fills``, ``n_rejected``, ``first_rank`` and ``latest``.
    """
    both = _stored(store).join(batch, "source_url", "full_outer")
    return _outcomes(both, as_of).where(F.col("in_store") | F.col("is_new"))


def merge_listed(versions: Sequence[DataFrame], batch: DataFrame, as_of: dt.date | Column) -> DataFrame:
    """What a merge does to the URLs of a collapsed batch, and to no others: a row per URL, also for those that stay unknown.

    ``versions`` hold the store, the newest first, each with at most one row per URL (``changelog.versions``). Every join keeps the batch's side, so rows of
    other URLs are never moved on, and tables bucketed by URL are not moved at all.
    """
    both = batch
    for place, version in enumerate(versions):
        both = both.join(_stored(version).withColumnRenamed("s", f"s{place}"), "source_url", "left")
    places = [f"s{place}" for place in range(len(versions))]
    return _outcomes(both.withColumn("s", F.coalesce(*places)).drop(*places), as_of)


#: Fields of the replaced version that are kept beside a changed row, for reports that are kept up by changes.
REPORTED = ("score", "tier", "telegram_sent", "digested")


def _stored(store: DataFrame) -> DataFrame:
    return store.select("source_url", F.struct(*[c for c in STORE.names if c != "source_url"]).alias("s"))


def _outcomes(both: DataFrame, as_of: dt.date | Column) -> DataFrame:
    now = moment(as_of)
    in_store = F.col("s").isNotNull()
    is_new = ~in_store & F.col("row").isNotNull()
    touched = in_store & (F.coalesce(F.col("n_fills"), F.lit(0)) > 0)

    def pick(field: T.StructField) -> Column:
        c = field.name
        if c == "source_url":
            return F.col(c)
        old = F.col(f"s.{c}")
        if c == "updated_at":
            return F.when(is_new | touched, now).otherwise(old).alias(c)
        if c in ("fetched_at", "created_at"):
            return F.when(is_new, now).otherwise(old).alias(c)
        if c not in PAYLOAD:
            default = STORE_DEFAULTS.get(c)
            fresh = F.lit(default) if default is not None else F.lit(None)
            return F.when(is_new, fresh.cast(field.dataType)).otherwise(old).alias(c)
        new = F.col(f"row.{c}")
        if c not in BACKFILLED:
            return F.when(in_store, old).otherwise(new).cast(field.dataType).alias(c)
        kept = F.nullif(old, F.lit("")) if c == "employment_type" else old
        fill = F.col(f"fill_{c}")
        value = (
            F.when(touched, F.coalesce(kept, fill))
            .when(in_store, old)
            .otherwise(F.coalesce(new, fill))
        )
        return value.cast(field.dataType).alias(c)

    return both.select(
        *[pick(f) for f in STORE.fields],
        is_new.alias("is_new"),
        touched.alias("touched"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_fills", "n_rejected")],
        F.col("first_rank"),
        F.col("latest"),
        in_store.alias("in_store"),
        _replaced().alias("old"),
    )


def _replaced() -> Column:
    return F.when(F.col("s").isNotNull(), F.struct(*[F.col(f"s.{c}").alias(c) for c in REPORTED]))


def upsert(
    store: DataFrame, rows: DataFrame, as_of: dt.date | Column, order: Sequence[str]
) -> DataFrame:
    """Insert new URLs, fill missing fields of known ones, change nothing else.

    ``rows`` are in stored form (see ``payload``); several rows may share a URL.
    """
    flagged = rows.withColumns({"inserts": F.lit(True), "fills": F.lit(True)})
    merged = merge(store, collapse(flagged, order), as_of)
    return merged.select(*STORE.names, "is_new", "touched")


def upsert_changes(
    store: DataFrame, rows: DataFrame, as_of: dt.date | Column, order: Sequence[str]
) -> DataFrame:
    """Only the rows that ``upsert`` inserts or fills, as a change set beside the store.

    Stored postings that are not listed are not written, and a bucketed store (``changelog.create``) is not moved.
    """
    flagged = rows.withColumns({"inserts": F.lit(True), "fills": F.lit(True)})
    return changed(merge_listed([store], collapse(flagged, order), as_of))


def changed(outcomes: DataFrame) -> DataFrame:
    """The rows of a merge that differ from the store, in the store's columns, with ``is_new``, ``touched`` and some fields of the ``old`` version."""
    return outcomes.where(F.col("is_new") | F.col("touched")).select(*STORE.names, "is_new", "touched", "old")


def mark(
    store: DataFrame, urls: DataFrame, flag: str, as_of: dt.date | Column
) -> DataFrame:
    """Set a boolean flag on the listed URLs (an empty list changes nothing)."""
    listed = urls.select("source_url").distinct().withColumn("listed", F.lit(True))
    hit = F.col("listed").isNotNull()
    return (
        store.join(listed, "source_url", "left")
        .withColumns(
            {
                flag: F.when(hit, F.lit(True)).otherwise(F.col(flag)),
                "updated_at": F.when(hit, moment(as_of)).otherwise(F.col("updated_at")),
            }
        )
        .select(*store.columns)
    )


def marked_changes(versions: Sequence[DataFrame], urls: DataFrame, flag: str, as_of: dt.date | Column) -> DataFrame:
    """The listed rows that a ``mark`` changes, for a log of changes; rows of other URLs are not moved, unknown URLs ignored."""
    both = urls.select("source_url").where("source_url IS NOT NULL").distinct()
    for place, version in enumerate(versions):
        both = both.join(_stored(version).withColumnRenamed("s", f"s{place}"), "source_url", "left")
    row = F.coalesce(*[f"s{place}" for place in range(len(versions))])
    rows = both.select("source_url", row.alias("s")).where("s IS NOT NULL").select("source_url", "s.*", _replaced().alias("old"))
    new = rows.where(~F.coalesce(F.col(flag), F.lit(False))).withColumns({flag: F.lit(True), "updated_at": moment(as_of)})
    return new.select(*STORE.names, F.lit(False).alias("is_new"), F.lit(False).alias("touched"), "old")


def toggle(store: DataFrame, commands: DataFrame, flag: str) -> DataFrame:
    """Apply on/off commands: the last one per URL sets the flag and its time.

    ``commands``: source_url, value boolean, at timestamp, command_id.
    """
    last = commands.groupBy("source_url").agg(
        F.max_by(F.struct("value", "at"), F.struct("at", "command_id")).alias("c")
    )
    hit = F.col("c").isNotNull()
    stamp = f"{flag}_at"
    return (
        store.join(last, "source_url", "left")
        .withColumns(
            {
                flag: F.when(hit, F.col("c.value")).otherwise(F.col(flag)),
                stamp: F.when(hit, F.when(F.col("c.value"), F.col("c.at"))).otherwise(
                    F.col(stamp)
                ),
                "updated_at": F.when(hit, F.col("c.at")).otherwise(F.col("updated_at")),
            }
        )
        .select(*store.columns)
    )


def backfill_zones(store: DataFrame, as_of: dt.date | Column) -> DataFrame:
    """Place rows still marked "elsewhere": nearer of location and title."""
    unplaced = F.col("zone_rank") == rules.ZONE_ELSEWHERE
    return store.withColumns(
        {
            "zone_rank": F.when(
                unplaced, places.nearest_zone(F.col("location"), F.col("title"))
            ).otherwise(F.col("zone_rank")),
            "updated_at": F.when(unplaced, moment(as_of)).otherwise(F.col("updated_at")),
        }
    )


def purgeable() -> Column:
    """Remote or retired-board rows nobody saved or applied to."""
    kept = F.coalesce(F.col("saved"), F.lit(False)) | F.coalesce(F.col("applied"), F.lit(False))
    remote = F.coalesce(F.col("eligibility").isin(*rules.REMOTE_CODES), F.lit(False))
    retired = F.coalesce(F.col("source").isin(*rules.RETIRED_BOARDS), F.lit(False))
    return ~kept & (remote | retired)


def purge(store: DataFrame) -> DataFrame:
    return store.where(~purgeable())


def add_columns(
    table: DataFrame,
    schema: T.StructType = STORE,
    defaults: Mapping[str, object] = STORE_DEFAULTS,
    as_of: dt.date | Column | None = None,
) -> DataFrame:
    """Bring an older snapshot to a schema: absent columns get their default.

    Applying it twice changes nothing. With ``as_of``, rows without
    ``updated_at`` get it.
    """
    absent = {
        f.name: F.lit(defaults.get(f.name)).cast(f.dataType)
        for f in schema.fields
        if f.name not in table.columns
    }
    grown = table.withColumns(absent) if absent else table
    if as_of is not None:
        grown = grown.withColumn("updated_at", F.coalesce("updated_at", moment(as_of)))
    return grown.select(*schema.names, *[c for c in grown.columns if c not in schema.names])


def seed(dimension: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    """Add the names a dimension lacks; existing rows stay as they are."""
    missing = names.dropDuplicates([key]).join(dimension.select(key), key, "left_anti")
    return dimension.unionByName(missing, allowMissingColumns=True)


def write_snapshot(store: DataFrame, path: str) -> None:
    """Write a snapshot to a path that does not exist yet, split by category."""
    store.write.mode("errorifexists").partitionBy("category").parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORE).parquet(path).select(*STORE.names)
