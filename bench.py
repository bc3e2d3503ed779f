"""Time headline queries: prints one JSON line.

BENCH_SF_DIR: data folder (default /root/testdata/sf0.1); BENCH_CPUS: cores
(default 8). Every query runs once to warm up (plans, JIT) and once timed,
including the time to build its plan; results go to the noop sink.
"""

from __future__ import annotations

import json
import os
import time

from vacansift.catalog import QUERIES
from vacansift.session import local_session

HEADLINE = (
    "tier_summary", "score_posting", "score_documents", "classify_location", "normalize_text",
    "qualify", "qualify_documents", "first_seen_backfill", "paging_stop", "upsert", "scan_store",
    "scan_metrics", "outbox_fold", "toggle_state", "digest_rows", "digest_lines", "status_report",
    "page_text", "page_links", "cards_myjobmag", "feed_listings",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
