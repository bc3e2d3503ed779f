"""Registered queries over the driver tables."""

from vacansift.catalog import (  # noqa: F401
    collect_queries,
    extraction_queries,
    function_queries,
    ingest_queries,
    report_queries,
    scoring_queries,
    store_queries,
    stream_queries,
)
from vacansift.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
