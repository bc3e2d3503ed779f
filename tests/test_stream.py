"""The incremental scan: replays, restarts and new files."""

import datetime as dt

from vacansift.schemas import DETAIL, LISTING, STORE
from vacansift.streaming import incremental

DAY = dt.date(2026, 9, 1)


def listing(url, title, seq, posted=None):
    return ("PSC", url, title, "C", "Nairobi, Kenya", "HTML, CSS and React.", "", posted, None, None, seq)


def test_incremental_scan(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "root")
    base = spark.createDataFrame([], STORE)
    details = spark.createDataFrame([], DETAIL)

    def land(*rows):
        spark.createDataFrame(rows, LISTING).coalesce(1).write.mode("append").parquet(landing)
        run()

    def run():
        incremental.run_available(spark, landing, root, base, details, DAY).awaitTermination()

    def store():
        rows = incremental.current(spark, root, base).collect()
        return {r.source_url: (r.title, r.posted_date) for r in rows}

    land(listing("a", "Junior Web Developer", 1), listing("b", "Cook", 2))
    assert store() == {"a": ("Junior Web Developer", None), "b": ("Cook", None)}
    # A repeated listing keeps the first title and fills only what was missing.
    land(listing("a", "Other", 1, DAY), listing("c", "Waiter", 2), listing("c", "Late", 3))
    expected = {"a": ("Junior Web Developer", DAY), "b": ("Cook", None), "c": ("Waiter", None)}
    assert store() == expected
    run()  # nothing new landed
    assert store() == expected
    land(listing("b", "Again", 1))
    assert store() == expected
    # The strong posting was never marked as alerted, so each listing of it is due again.
    kinds = sorted((r.source_url, r.kind) for r in incremental.alerts(spark, root).collect())
    assert kinds == [("a", "new"), ("a", "retry")]
    # Once its alert is delivered, further listings are quiet, and a compaction changes no row.
    incremental.mark_delivered(root, spark.createDataFrame([("a",)], "source_url string"))
    before = sorted(map(tuple, incremental.current(spark, root, base).collect()))
    assert [r for r in before if r[1] == "a"][0][STORE.names.index("telegram_sent")] is True
    incremental.compact(spark, root, base)
    incremental.compact(spark, root, base)
    assert sorted(map(tuple, incremental.current(spark, root, base).collect())) == before
    land(listing("a", "Once more", 1), listing("d", "Junior Web Developer", 2))
    later = sorted((r.source_url, r.kind) for r in incremental.alerts(spark, root).collect())
    assert later == [("a", "new"), ("a", "retry"), ("d", "new")]
    assert store() == {**expected, "d": ("Junior Web Developer", None)}
