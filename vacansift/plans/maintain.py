"""Maintenance of a snapshot: schema growth, zones, purge."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame

from vacansift.operators import children as child_tables
from vacansift.operators import store as stores


def run(
    store: DataFrame, children: dict[str, DataFrame], as_of: dt.date | Column
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Grown, placed and purged store, with child rows of purged postings gone from all child tables."""
    grown = stores.add_columns(store, as_of=as_of)
    kept = stores.purge(stores.backfill_zones(grown, as_of))
    return kept, child_tables.cascade(children, kept)
