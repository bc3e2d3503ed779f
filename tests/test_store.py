"""Store operators and whole scans against plain Python simulations."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vacansift import rules
from vacansift.operators import changelog, children, outbox, reports, scoring
from vacansift.operators import store as stores
from vacansift.plans import digest, maintain, scan
from vacansift.schemas import LISTING, STORE
from vacansift.session import written
from vacansift.sources import tables

DAY = dt.date(2026, 9, 1)
NOW = dt.datetime(2026, 9, 1)
OLD = dt.datetime(2026, 8, 1)


def posting(url, **values):
    row = {
        "source": "PSC", "source_url": url, "title": "Clerk", "company": "C", "location": "Nairobi",
        "description": "d", "score": 10, "tier": "poor", "eligibility": "KENYA",
        "employment_type": None, "posted_date": None, "deadline_date": None, "category": "ICT",
        "zone_rank": 2, "reasons": "", "blockers": "", "telegram_sent": False, "digested": False,
        "applied": False, "applied_at": None, "saved": False, "saved_at": None,
        "fetched_at": OLD, "updated_at": OLD, "created_at": OLD,
    }
    row.update(values)
    return tuple(row[c] for c in STORE.names)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], STORE)


def test_upsert_matches_row_by_row(spark):
    rng = random.Random(11)
    maybe = lambda *v: rng.choice((None, *v))
    stored = [
        posting(
            f"u{i}", eligibility=maybe("KENYA"), employment_type=rng.choice([None, "", "Contract"]),
            posted_date=maybe(dt.date(2026, 1, 1)), deadline_date=maybe(dt.date(2026, 2, 2)),
        )
        for i in range(0, 60, 2)
    ]
    batch = []
    for seq in range(600):
        url = "u0" if seq % 3 == 0 else f"u{rng.randrange(80)}"
        row = dict(zip(STORE.names, posting(
            url, title=f"t{seq}", eligibility=maybe("UNKNOWN"), employment_type=maybe("Full Time"),
            posted_date=maybe(dt.date(2026, 3, 3)), deadline_date=maybe(dt.date(2026, 4, 4)),
        )))
        batch.append((seq, row))
    state = {r[1]: dict(zip(STORE.names, r)) for r in stored}
    touched, fresh = set(), set()
    for _, row in batch:
        url = row["source_url"]
        if url not in state:
            state[url] = {**row, "fetched_at": NOW, "updated_at": NOW, "created_at": NOW}
            fresh.add(url)
            continue
        old = state[url]
        if url not in fresh:
            touched.add(url)
        old["updated_at"] = NOW
        old["employment_type"] = (old["employment_type"] or None) or row["employment_type"]
        for c in ("eligibility", "posted_date", "deadline_date"):
            old[c] = old[c] if old[c] is not None else row[c]

    schema = "seq int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in STORE.fields)
    rows = [(seq, *[r[c] for c in STORE.names]) for seq, r in batch]
    rng.shuffle(rows)
    incoming = spark.createDataFrame(rows, schema).select("seq", "source_url", *stores.PAYLOAD)
    out = stores.upsert(spark.createDataFrame(stored, STORE), incoming, DAY, ("seq",))
    got = {r["source_url"]: r.asDict() for r in out.collect()}
    assert {u for u, r in got.items() if r["is_new"]} == fresh
    assert {u for u, r in got.items() if r["touched"]} == touched
    assert {u: {c: r[c] for c in STORE.names} for u, r in got.items()} == state

    again = stores.upsert(out.select(*STORE.names), incoming, DAY, ("seq",))
    assert again.where("is_new").count() == 0


LISTINGS = [
    ("Junior Web Developer", "Nairobi, Kenya", "HTML, CSS, JavaScript and React. Entry-level.", None),
    ("IT Support Technician", "Remote / Worldwide", "Hardware and help desk.", None),
    ("Android Developer", "Thika, Kenya", "Kotlin. Graduate trainee.", "ICT"),
    ("Cleaner", "Malindi", "KCSE certificate holder.", "FORM4"),
    ("Sales Rep", "Malindi", "Diploma in Sales and Marketing.", "FORM4"),
    ("Waiter", "Mombasa", "Good manners.", "FORM4"),
    ("Agent", "Work from home", "KCSE holder.", "FORM4"),
    ("Help Desk Assistant", "Kenya", "Networking, hardware. Internship.", ""),
]


def scan_inputs(spark):
    rng = random.Random(5)
    rows = []
    for seq in range(240):
        title, location, text, hint = rng.choice(LISTINGS)
        url = "hot" if seq % 3 == 0 else f"u{rng.randrange(60)}"
        url = rng.choice([None, ""]) if seq % 37 == 5 else url
        rows.append((
            "PSC", url, title, "C & D", location, text, rng.choice(["", "Contract"]),
            rng.choice([None, dt.date(2026, 8, 25)]), None, hint, seq,
        ))
    listings = spark.createDataFrame(rows, LISTING)
    store = spark.createDataFrame(
        [
            posting(f"u{i}", tier=rng.choice(["strong", "poor"]), telegram_sent=rng.choice([True, False]),
                    eligibility=rng.choice([None, "KENYA"]))
            for i in range(0, 60, 3)
        ],
        STORE,
    )
    details = spark.createDataFrame(
        [(f"u{i}", "Basic math skills.", ["KCSE"], "1 year") for i in range(1, 60, 4)]
        + [(f"u{i}", "Driving licence needed.", [], "") for i in range(2, 60, 4)],
        "source_url string, body string, qualifications array<string>, experience string",
    )
    return listings, store, details


def simulate_scan(verdicts, store, failing):
    state = {u: dict(r) for u, r in store.items()}
    stored = set(state)
    m = dict.fromkeys(
        "processed new_jobs strong consider alert_attempts alerts_sent alert_failures "
        "school_saved school_rejected remote_dropped".split(), 0,
    )
    for v in sorted(verdicts, key=lambda v: v["seq"]):
        url, school = v["source_url"], v["category"] == "FORM4"
        if v["remote"]:
            m["remote_dropped"] += 1
            continue
        if school:
            if url in state:
                continue
            if v["rejected"]:
                m["school_rejected"] += 1
                continue
        m["processed"] += 1
        alert = False
        if url in state:
            row = state[url]
            for c in ("eligibility", "posted_date", "deadline_date"):
                row[c] = row[c] if row[c] is not None else v[c]
            row["employment_type"] = (row["employment_type"] or None) or v["employment_type"]
            alert = row["tier"] == "strong" and not row["telegram_sent"]
        else:
            state[url] = {**{c: v[c] for c in stores.PAYLOAD}, "telegram_sent": False}
            m["new_jobs"] += 1
            if school:
                m["school_saved"] += 1
                continue
            m["strong"] += v["tier"] == "strong"
            m["consider"] += v["tier"] == "consider"
            alert = v["tier"] == "strong"
        if alert:
            m["alert_attempts"] += 1
            ok = url not in failing
            m["alerts_sent" if ok else "alert_failures"] += 1
            state[url]["telegram_sent"] = state[url]["telegram_sent"] or ok
    return state, m, set(state) - stored


def test_scan_matches_row_by_row(spark):
    listings, store, details = scan_inputs(spark)
    failing = {"hot", "u7", "u9", "u12"}
    failed = spark.createDataFrame([(u,) for u in failing], "source_url string")
    result = scan.run(listings, store, details, DAY, failed_urls=failed)
    verdicts = [r.asDict() for r in result.judged.collect()]
    assert len(verdicts) == listings.where("source_url <> ''").count()
    stored = {r["source_url"]: r.asDict() for r in store.collect()}
    state, counts, fresh = simulate_scan(verdicts, stored, failing)

    merged = {r["source_url"]: r.asDict() for r in result.store.collect()}
    assert set(merged) == set(state)
    assert {u for u, r in merged.items() if r["is_new"]} == fresh
    assert {r["source_url"] for r in result.merged.collect()} <= {v["source_url"] for v in verdicts}
    for url, want in state.items():
        for c in stores.PAYLOAD:
            assert merged[url][c] == want[c], (url, c)
    got = result.metrics.first().asDict()
    assert got.pop("fetched") == listings.count()
    assert got == counts
    alerted = {r["source_url"]: r["message"] for r in result.alerts.collect()}
    assert len(alerted) == counts["alerts_sent"] + len(failing & set(alerted))
    assert all("C &amp; D" in text and "Eligibility:" not in text for text in alerted.values())


def test_staged_scan_gives_the_same_store(spark, tmp_path):
    listings, store, details = scan_inputs(spark)
    plain = scan.run(listings, store, details, DAY).store
    staged = scan.run(listings, store, details, DAY, work_folder=str(tmp_path / "judged")).store
    assert plain.exceptAll(staged).isEmpty() and staged.exceptAll(plain).isEmpty()


def test_known_school_postings_are_left_alone(spark):
    store = spark.createDataFrame([posting("u", eligibility=None, tier="strong")], STORE)
    row = ("PSC", "u", "Cleaner", "C", "Malindi", "KCSE holder.", "", DAY, None, "FORM4", 1)
    listings = spark.createDataFrame([row], LISTING)
    none = spark.createDataFrame([], "source_url string, body string, qualifications array<string>, experience string")
    result = scan.run(listings, store, none, DAY)
    kept = result.merged.first()
    assert not kept["touched"] and kept["eligibility"] is None and result.alerts.isEmpty()


def test_mark_toggle_and_digest(spark):
    store = spark.createDataFrame(
        [posting("a"), posting("b", digested=None), posting("c", digested=True), posting("d", score=None, tier=None)],
        STORE,
    )
    none = spark.createDataFrame([], "source_url string")
    assert stores.mark(store, none, "digested", DAY).exceptAll(store).isEmpty()
    marked = stores.mark(store, spark.createDataFrame([("a",), ("a",), ("zz",)], "source_url string"), "telegram_sent", DAY)
    assert [r.source_url for r in marked.where("telegram_sent").collect()] == ["a"]
    assert marked.count() == 4

    commands = spark.createDataFrame(
        [("a", True, OLD, 1), ("a", False, NOW, 2), ("b", True, NOW, 3)],
        "source_url string, value boolean, at timestamp, command_id int",
    )
    toggled = {r.source_url: (r.saved, r.saved_at) for r in stores.toggle(store, commands, "saved").collect()}
    assert toggled["a"] == (False, None) and toggled["b"] == (True, NOW) and toggled["c"] == (False, None)

    rows = reports.digest_rows(store).collect()
    assert [r.source_url for r in rows] == ["d", "a"]  # unknown scores lead
    done = digest.mark_reported(store, DAY)
    assert reports.digest_rows(done).isEmpty()
    assert done.where("digested is null").count() == 1


def test_digest_report_is_written_before_marking(spark, tmp_path):
    store = spark.createDataFrame(
        [posting("a", tier="strong", score=80), posting("b", tier="strong", score=90, category="FORM4"),
         posting("c", tier="poor")],
        STORE,
    )
    path = str(tmp_path / "digest")
    after = digest.run(store, DAY, "POSTINGS", path)
    blocks = [r.block for r in spark.read.parquet(path).orderBy("part", F.desc("score")).collect()]
    assert blocks[0].startswith("POSTINGS\n\n3 new jobs") and len(blocks) == 4
    assert "90% — " + rules.SCHOOL_TITLE_PREFIX in blocks[2] and "80% — Clerk" in blocks[3]
    assert after.where("digested").count() == 3
    with pytest.raises(Exception):
        digest.run(store, DAY, "POSTINGS", path)


def test_empty_digest_has_no_lines(spark, empty):
    assert reports.digest_lines(empty, "H").isEmpty()


def test_maintenance(spark):
    store = spark.createDataFrame(
        [
            posting("keep", zone_rank=9, location="Nairobi", title="Cook - Malindi"),
            posting("remote", eligibility="REMOTE-AFRICA"),
            posting("saved", eligibility="REMOTE-AFRICA", saved=True),
            posting("applied", source="RemoteOK", applied=True),
            posting("retired", source="RemoteOK", saved=None),
            posting("plain", eligibility=None),
        ],
        STORE,
    )
    children = spark.createDataFrame([("keep",), ("retired",), ("saved",), ("saved",)], "source_url string")
    kept, kids = maintain.run(store, {"notes": children}, DAY)
    assert {r.source_url for r in kept.collect()} == {"keep", "saved", "applied", "plain"}
    assert kept.where("source_url = 'keep'").first()["zone_rank"] == 0
    assert kids["notes"].count() == 3
    old = store.drop("category", "zone_rank", "saved")
    once = stores.add_columns(old)
    assert once.columns == STORE.names and once.exceptAll(stores.add_columns(once)).isEmpty()


def test_children_of_purged_postings_go_in_one_join(spark, no_broadcast):
    store = spark.createDataFrame(
        [posting("a", saved=True, saved_at=NOW), posting("b", applied=True, applied_at=OLD), posting("gone", eligibility="REMOTE-AFRICA")],
        STORE,
    )
    notes = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("gone", "y", 3), (None, "z", 4)], "source_url string, text string, child_row int")
    tables = {"saved": children.saved(store), "application": children.applications(store), "note": notes, "key": store.select("source_url")}
    kept, rest = maintain.run(store, tables, DAY)
    assert {name: rows.columns for name, rows in rest.items()} == {name: rows.columns for name, rows in tables.items()}
    assert [tuple(r) for r in rest["saved"].collect()] == [("a", NOW)]
    (applied,) = rest["application"].collect()
    assert applied["status"] == "applied" and applied["applied_at"] == OLD and applied["interview_at"] is None
    assert sorted(r["child_row"] for r in rest["note"].collect()) == [1, 2]
    assert {r[0] for r in rest["key"].collect()} == {"a", "b"}
    # What is read back is written: no table is joined again.
    assert "Join" not in rest["note"]._jdf.queryExecution().executedPlan().toString()


def test_match_rows_keep_all_skills_and_places(spark):
    skills = list(rules.DEFAULT_PROFILE.skills)[:9]
    text = ", ".join(skills) + ". " + ", ".join(rules.DEFAULT_PROFILE.locations)
    rows = [("PSC", "u", "Clerk", "C", "Nairobi", text, "", DAY, None, None, 1), ("PSC", "u", "Other", "C", "Nairobi", "", "", DAY, None, None, 2)]
    scored = scoring.score_postings(spark.createDataFrame(rows, LISTING), DAY)
    (match,) = children.matches(scored, ("seq",)).collect()
    first = scored.where("seq = 1").first()
    assert match["matched_skills"].split("; ") == first["skills"] and len(first["skills"]) >= 9
    assert match["matched_locations"].split("; ") == first["matched_locations"] and len(first["matched_locations"]) > rules.LOCATIONS_SHOWN
    assert match["reasons"] == "; ".join(first["reasons"]) and match["score"] == first["score"]


def test_digest_that_broke_off_marks_what_it_reported(spark, log, tmp_path, monkeypatch):
    rows = [posting("a", score=90, tier="strong"), posting("b"), posting("c", digested=None), posting("d", digested=True)]
    changelog.create(spark.createDataFrame(rows, STORE), log)
    root = str(tmp_path / "digest")

    def broken(*_):
        raise OSError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(changelog, "append", broken)
        with pytest.raises(OSError):
            digest.run_logged(spark, log, 2, DAY, "H", root)
    # A posting that turns up before the digest is run again waits for the next one.
    late = spark.createDataFrame([posting("late", score=99, tier="strong")], STORE)
    changelog.append(late.selectExpr("*", "true AS is_new", "false AS touched"), log, 1)
    digest.run_logged(spark, log, 2, DAY, "H", root)
    digest.run_logged(spark, log, 2, DAY, "H", root)
    flags = {r["source_url"]: r["digested"] for r in changelog.current(spark, log).collect()}
    assert flags == {"a": True, "b": True, "c": None, "d": True, "late": False}
    report = " ".join(r["block"] for r in spark.read.parquet(f"{root}/report/epoch=2").collect())
    assert "2 new jobs" in report and "99%" not in report
    digest.run_logged(spark, log, 3, DAY, "H", root)
    assert changelog.current(spark, log).where("source_url = 'late'").first()["digested"]


def test_seed_keeps_existing_rows(spark):
    have = spark.createDataFrame([("a", "x")], "name string, base_url string")
    names = spark.createDataFrame([("a",), ("b",), ("b",)], "name string")
    rows = {r.name: r.base_url for r in stores.seed(have, names).collect()}
    assert rows == {"a": "x", "b": None}


def test_outbox(spark):
    t = [NOW + dt.timedelta(minutes=i) for i in range(5)]
    events = spark.createDataFrame(
        [
            ("a", "mail", "pending", None, t[0], 0), ("a", "mail", "failed", "boom", t[1], 1),
            ("a", "mail", "sent", None, t[2], 2), ("b", "mail", "sent", None, t[1], 3),
            ("b", "mail", "failed", "again", t[3], 4), ("c", "mail", "pending", None, t[4], 5),
        ],
        "source_url string, channel string, outcome string, error string, at timestamp, event_id int",
    )
    got = {r.source_url: (r.status, r.attempts, r.last_error, r.sent_at, r.updated_at) for r in outbox.fold(events).collect()}
    assert got == {
        "a": ("sent", 2, None, t[2], t[2]),
        "b": ("failed", 2, "again", t[1], t[3]),
        "c": ("pending", 0, None, None, t[4]),
    }


def test_outbox_by_slices_equals_one_fold(spark):
    rng = random.Random(9)
    rows = [
        (f"u{rng.randrange(6)}", rng.choice("ab"), rng.choice(["sent", "failed", "pending"]), f"e{i}", NOW + dt.timedelta(minutes=rng.randrange(9)), i)
        for i in range(200)
    ]
    schema = "source_url string, channel string, outcome string, error string, at timestamp, event_id int"
    events = spark.createDataFrame(rows, schema)
    want = sorted(map(repr, outbox.fold(events).collect()))
    states = outbox.partial(events.limit(0))
    assert outbox.finished(states).collect() == []
    for last in (40, 120, 120, 90, 199, 199):
        states = spark.createDataFrame(outbox.advanced(states, events.where(F.col("event_id") <= last)).collect(), states.schema)
    assert sorted(map(repr, outbox.finished(states).collect())) == want
    parts = [outbox.partial(events.where(F.col("event_id") % 3 == k)) for k in (2, 0, 1)]
    together = outbox.merged(parts[0].unionByName(outbox.merged(parts[1].unionByName(parts[2]))))
    assert sorted(map(repr, outbox.finished(together).collect())) == want


def test_only_new_events_are_read(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.range(10).selectExpr("'u' AS source_url", "'c' AS channel", "'sent' AS outcome", "'' AS error", "now() AS at", "id AS event_id").write.parquet(path)
    events = spark.read.parquet(path)
    states = outbox.partial(events.where("event_id < 5"))
    plan = outbox.advanced(states, events)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(event_id,4)" in plan


def test_snapshot_sinks(spark, tmp_path):
    store = spark.createDataFrame([posting("a"), posting("b", category="FORM4")], STORE)
    path = str(tmp_path / "snap")
    stores.write_snapshot(store, path)
    assert stores.read_snapshot(spark, path).exceptAll(store).isEmpty()


def above_scans(plan, table):
    """Operators between the scans of a table and the root of a printed plan."""
    path, found = {}, []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        path = {d: name for d, name in path.items() if d < depth}
        if "FileScan" in line and table in line:
            found.append([path[d] for d in sorted(path)])
        path[depth] = line[depth:]
    return found


@pytest.fixture()
def log(spark, tmp_path):
    made = changelog.Log(f"log_{tmp_path.name.replace('-', '_')}", 8, str(tmp_path))
    yield made
    spark.sql(f"DROP TABLE IF EXISTS {made.base}")
    spark.sql(f"DROP TABLE IF EXISTS {made.changes}")


@pytest.fixture()
def no_broadcast(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_logged_scan_equals_a_scan_of_a_snapshot(spark, log):
    listings, store, details = scan_inputs(spark)
    failed = spark.createDataFrame([(u,) for u in ("hot", "u7", "u9", "u12")], "source_url string")
    want = scan.run(listings, store, details, DAY, failed_urls=failed)
    changelog.create(store, log)
    alerts, metrics, matches = scan.run_logged(listings, log, 0, details, DAY, failed_urls=failed)
    assert sorted(map(tuple, matches.collect())) == sorted(map(tuple, want.matches.collect()))
    assert {r["source_url"] for r in matches.collect()} == {r["source_url"] for r in want.changes.where("is_new").collect()}
    assert metrics.first() == want.metrics.first() and metrics.first()["school_rejected"] > 0
    assert sorted(map(tuple, alerts.collect())) == sorted(map(tuple, want.alerts.collect()))
    moved = reports.status_moved(reports.status_sums(store), changelog.logged(spark, log, 1))
    assert reports.status_of(moved).collect() == reports.status_report(want.store).collect()
    plan = moved._jdf.queryExecution().executedPlan().toString()
    assert log.changes in plan and log.base not in plan
    after = sorted(map(repr, want.store.collect()))
    assert sorted(map(repr, changelog.current(spark, log).collect())) == after
    # Run again under its epoch, it leaves the same store; a second scan finds the marks of delivered alerts.
    again, same, _ = scan.run_logged(listings, log, 0, details, DAY, failed_urls=failed)
    assert same.first() == metrics.first() and sorted(map(repr, changelog.current(spark, log).collect())) == after
    delivered = want.alerts.select("source_url").limit(3).collect()
    sent = spark.createDataFrame([*delivered, ("nowhere",), (None,)], "source_url string")
    late, _, _ = scan.run_logged(listings, log, 1, details, DAY, delivered=sent)
    left = {r["source_url"] for r in again.collect()} - {r["source_url"] for r in delivered}
    assert {r["source_url"] for r in late.collect()} == left
    flags = {r["source_url"]: r["telegram_sent"] for r in changelog.current(spark, log).collect()}
    assert all(flags[r["source_url"]] for r in delivered) and "nowhere" not in flags
    with pytest.raises(ValueError, match="epoch"):
        changelog.append(want.changes, log, 0)


def test_logged_store_is_not_shuffled(spark, log, no_broadcast):
    listings, store, details = scan_inputs(spark)
    changelog.create(store, log)
    scan.run_logged(listings, log, 0, details, DAY)
    judged = written(scan.judge(listings, changelog.versions(spark, log), details, DAY), "judged")
    frames = [scan.outcomes(judged, changelog.versions(spark, log), DAY), changelog.current(spark, log)]
    for frame in frames:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        for table in (log.base, log.changes):
            ways = above_scans(plan, table)
            assert ways and not [w for w in ways if any(line.startswith("Exchange") for line in w)], plan
    assert "SortMergeJoin" in plan


def test_lookup_reads_one_bucket(spark, log):
    changelog.create(spark.createDataFrame([posting(f"u{i}") for i in range(40)], STORE), log)
    changelog.append(spark.createDataFrame([posting("u7", score=77)], STORE).selectExpr("*", "false AS is_new", "true AS touched"), log, 0)
    found = changelog.by_url(spark, log, "u7")
    assert found._jdf.queryExecution().executedPlan().toString().count("SelectedBucketsCount: 1 out of 8") == 2
    assert [r["score"] for r in found.collect()] == [77] and changelog.by_url(spark, log, "nowhere").isEmpty()


def test_compacted_log(spark, log):
    changelog.create(spark.createDataFrame([posting("a"), posting("b")], STORE), log)
    changelog.append(spark.createDataFrame([posting("b", score=50), posting("c")], STORE).selectExpr("*", "source_url = 'c' AS is_new", "source_url = 'b' AS touched"), log, 0)
    changelog.append(spark.createDataFrame([posting("b", score=70)], STORE).selectExpr("*", "false AS is_new", "true AS touched"), log, 4)
    into = changelog.Log(log.name + "_later", 4, log.folder + "/later")
    changelog.compact(spark, log, into)
    rows = {r["source_url"]: (r["score"], r["is_new"], r["touched"]) for r in changelog.current(spark, into).collect()}
    assert rows == {"a": (10, False, False), "b": (70, False, False), "c": (10, False, False)}
    spark.sql(f"DROP TABLE {into.base}")
    spark.sql(f"DROP TABLE {into.changes}")


def test_lookup_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "store")
    spark.createDataFrame([posting("a"), posting("b")], STORE).write.parquet(path)
    store = spark.read.parquet(path)
    assert tables.exists(store, "a") and not tables.exists(store, "zz")
    found = tables.by_url(store, "b").select("title")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source_url,b)" in plan and "description" not in plan
