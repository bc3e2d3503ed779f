"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def table_schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


LISTING = table_schema(
    source="string", source_url="string", title="string", company="string", location="string",
    description="string", employment_type="string", posted_date="date", deadline_date="date",
    category_hint="string", seq="bigint",
)

DETAIL = table_schema(
    source_url="string", body="string", qualifications="array<string>", experience="string"
)

STORE = table_schema(
    source="string", source_url="string", title="string", company="string", location="string",
    description="string", score="int", tier="string", eligibility="string",
    employment_type="string", posted_date="date", deadline_date="date", category="string",
    zone_rank="int", reasons="string", blockers="string", telegram_sent="boolean",
    digested="boolean", applied="boolean", applied_at="timestamp", saved="boolean",
    saved_at="timestamp", fetched_at="timestamp", updated_at="timestamp", created_at="timestamp",
)

NOTIFICATION = table_schema(
    source_url="string", channel="string", status="string", attempts="int", last_error="string",
    sent_at="timestamp", created_at="timestamp", updated_at="timestamp",
)

SOURCE = table_schema(name="string", base_url="string", active="boolean")

# Child tables of the store, keyed by its URL.
SAVED = table_schema(source_url="string", created_at="timestamp")
APPLICATION = table_schema(
    source_url="string", status="string", applied_at="timestamp", interview_at="timestamp",
    notes="string", created_at="timestamp", updated_at="timestamp",
)
MATCH = table_schema(
    source_url="string", score="int", tier="string", matched_skills="string",
    matched_locations="string", reasons="string", blockers="string",
)

# One entry of the JSON feed, in DDL form.
FEED_ENTRY = (
    "fields struct<title:string, url_alias:string, date:struct<created:string>, body:string, "
    "source:array<struct<name:string>>, country:array<struct<name:string>>>"
)

# Columns a conflicting row may fill in when the stored value is missing.
BACKFILLED = ("eligibility", "employment_type", "posted_date", "deadline_date")

# Default of a column that older snapshots lack.
STORE_DEFAULTS = {
    "score": 0,
    "tier": "poor",
    "category": "ICT",
    "zone_rank": 9,
    "telegram_sent": False,
    "digested": False,
    "applied": False,
    "saved": False,
}
