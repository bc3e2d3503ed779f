"""Notification states as a fold over delivery events, whole or slice by slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("source_url", "channel")


def partial(deliveries: DataFrame) -> DataFrame:
    """State per (source_url, channel) of some events: its last attempt with its place, counts and times, and the last event it knows of.

    ``deliveries``: source_url, channel, outcome (pending, sent or failed),
    error, at, event_id (the place in the log of events).
    """
    attempted = F.col("outcome").isin("sent", "failed")
    rows = deliveries.select(
        *KEY,
        F.when(
            attempted,
            F.struct(
                F.struct("at", "event_id").alias("rank"),
                F.col("outcome"),
                F.when(F.col("outcome") == "failed", F.col("error")).alias("error"),
                F.col("at"),
            ),
        ).alias("last"),
        attempted.cast("long").alias("attempts"),
        F.when(F.col("outcome") == "sent", F.col("at")).alias("sent_at"),
        F.col("at").alias("created_at"),
        F.col("event_id").alias("through"),
    )
    return merged(rows)


def merged(states: DataFrame) -> DataFrame:
    """States of the same key brought together; the order in which that is done makes no difference."""
    return states.groupBy(*KEY).agg(
        F.max_by("last", F.col("last.rank")).alias("last"),
        F.sum("attempts").alias("attempts"),
        F.max("sent_at").alias("sent_at"),
        F.min("created_at").alias("created_at"),
        F.max("through").alias("through"),
    )


def high_water(states: DataFrame) -> Column:
    """The last event that states know of; a literal, so that a filter on it reaches the scan of the events."""
    return F.lit(states.agg(F.max("through")).first()[0])


def advanced(states: DataFrame, deliveries: DataFrame) -> DataFrame:
    """States after further events. Events up to the high-water mark are known already and are not read, so a slice that comes again changes nothing.

    Slices come in the order of the log: an event that turns up late below the mark is not seen.
    """
    mark = high_water(states)
    fresh = deliveries.where(mark.isNull() | (F.col("event_id") > mark))
    return merged(states.unionByName(partial(fresh)))


def finished(states: DataFrame) -> DataFrame:
    """Notifications as a table has them."""
    return states.select(
        *KEY,
        F.coalesce(F.col("last.outcome"), F.lit("pending")).alias("status"),
        F.col("attempts").cast("int").alias("attempts"),
        F.col("last.error").alias("last_error"),
        "sent_at",
        "created_at",
        F.coalesce(F.col("last.at"), F.col("created_at")).alias("updated_at"),
    )


def fold(deliveries: DataFrame) -> DataFrame:
    """Current state per (source_url, channel), in one go.

    Creating a notification again changes nothing; every
    attempt counts, the last attempt decides status and error, and the last
    success gives sent_at.
    """
    return finished(partial(deliveries))
