"""Upserts, flags, maintenance and whole scans over the derived store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacansift import rules
from vacansift.catalog import relations as R
from vacansift.catalog import sql_rules as S
from vacansift.catalog.registry import query, sql_stamp, stamp
from vacansift.catalog.scoring_queries import DETAILS_SQL
from vacansift.operators import changelog, children, collect, outbox, reports, scoring
from vacansift.operators import store as stores
from vacansift.plans import digest, maintain, scan
from vacansift.schemas import STORE
from vacansift.session import new_folder, written
from vacansift.sources import details as detail_pages
from vacansift.sources.tables import surrogate_id, table

DAY = R.AS_OF
NOW = f"{R.SQL_DAY}::TIMESTAMP"

# ------------------------------------------------------------------ upsert --

CATEGORISED_SQL = f"""{S.SCORED_SQL},
stored AS (
  SELECT *, coalesce(nullif(category_hint, ''), 'ICT') AS category,
    {S.zone_rank('location', 'title')} AS zone_rank FROM scored)"""

_FILLS = ("eligibility", "posted_date", "deadline_date")
_UPSERT_COLUMNS = (
    "source_url, is_new, touched, source, title, score, tier, category, zone_rank, eligibility, "
    "employment_type, posted_date, deadline_date, reasons, blockers"
)


def merged_sql(rows: str) -> str:
    """``merged`` over rows with the flags ins and fil."""
    plain = ("source", "title", "score", "tier", "category", "zone_rank", "company", "location")
    lists = ("reasons", "blockers")
    first = ", ".join(f"'{c}': {c}" for c in (*plain, *_FILLS, "description"))
    first += ", " + ", ".join(f"'{c}': array_to_string({c}, '; ')" for c in lists)
    first += ", 'employment_type': nullif(employment_type, '')"
    fills = ", ".join(
        f"arg_min({c}, seq) FILTER (WHERE fil AND {c} IS NOT NULL) AS fill_{c}" for c in _FILLS
    )
    kept = ", ".join(f"CASE WHEN in_store THEN s.{c} ELSE r.{c} END AS {c}" for c in (*plain, *lists, "description"))
    filled = ", ".join(
        f"CASE WHEN touched THEN coalesce(s.{c}, fill_{c}) WHEN in_store THEN s.{c} "
        f"ELSE coalesce(r.{c}, fill_{c}) END AS {c}"
        for c in _FILLS
    )
    return f"""collapsed AS (
  SELECT source_url, arg_min({{{first}}}, seq) FILTER (WHERE ins) AS r, min(seq) FILTER (WHERE ins) AS first_seq,
    {fills},
    arg_min(employment_type, seq) FILTER (WHERE fil AND employment_type <> '') AS fill_employment_type,
    arg_min({{'title': title, 'company': company, 'location': location, 'eligibility': eligibility,
      'reasons': reasons}}, seq) FILTER (WHERE fil) AS latest,
    count(*) FILTER (WHERE fil) AS n_fills
  FROM {rows} GROUP BY source_url),
matched AS (
  SELECT coalesce(s.source_url, b.source_url) AS source_url, s.source_url IS NOT NULL AS in_store, s, b.r, b.latest,
    b.first_seq, coalesce(b.n_fills, 0) AS n_fills, fill_eligibility, fill_posted_date, fill_deadline_date,
    fill_employment_type, s.source_url IS NOT NULL AND coalesce(b.n_fills, 0) > 0 AS touched
  FROM store s FULL JOIN collapsed b ON s.source_url = b.source_url),
merged AS (
  SELECT source_url, NOT in_store AS is_new, touched, in_store, n_fills, first_seq, latest,
    in_store AND s.telegram_sent AS sent, {kept}, {filled},
    CASE WHEN touched THEN coalesce(nullif(s.employment_type, ''), fill_employment_type)
      WHEN in_store THEN s.employment_type ELSE coalesce(r.employment_type, fill_employment_type) END AS employment_type,
    CASE WHEN touched OR NOT in_store THEN {NOW} ELSE s.updated_at END AS updated_at
  FROM matched WHERE in_store OR r IS NOT NULL)"""


@query(
    "upsert",
    f"""WITH {R.POSTINGS_SQL}, {R.STORE_SQL}, {CATEGORISED_SQL},
    batch AS (SELECT *, true AS ins, true AS fil FROM stored WHERE source_url <> ''), {merged_sql('batch')}
    SELECT {_UPSERT_COLUMNS}, {sql_stamp('updated_at')} FROM merged""",
)
def upsert(spark: SparkSession, folder: str) -> DataFrame:
    listed = collect.with_category(R.postings(spark, folder).where(collect.known_url()))
    batch = stores.payload(scoring.score_postings(listed, DAY))
    merged = stores.upsert(R.store(spark, folder), batch, DAY, ("seq",))
    return merged.select(*_UPSERT_COLUMNS.split(", "), stamp("updated_at"))


def new_log(store: DataFrame) -> changelog.Log:
    """A store with a log of changes, under a name of its own."""
    spark = store.sparkSession
    folder, name = new_folder(spark, "store").rsplit("/", 1)
    log = changelog.Log(name.replace("-", "_"), int(spark.conf.get("spark.sql.shuffle.partitions")), f"{folder}/{name}")
    changelog.create(store, log)
    return log


@query(
    "upsert_changes",
    f"""WITH {R.POSTINGS_SQL}, {R.STORE_SQL}, {CATEGORISED_SQL},
    batch AS (SELECT *, true AS ins, true AS fil FROM stored WHERE source_url <> ''), {merged_sql('batch')}
    SELECT {_UPSERT_COLUMNS}, {sql_stamp('updated_at')} FROM merged WHERE is_new OR touched""",
)
def upsert_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The change set of an upsert into a bucketed store."""
    log = new_log(R.store(spark, folder))
    listed = collect.with_category(R.postings(spark, folder).where(collect.known_url()))
    batch = stores.payload(scoring.score_postings(listed, DAY))
    changed = stores.upsert_changes(spark.table(log.base), batch, DAY, ("seq",))
    return changed.select(*_UPSERT_COLUMNS.split(", "), stamp("updated_at"))


@query(
    "payload_projection",
    f"""WITH {R.TEXT_POSTINGS_SQL}, {CATEGORISED_SQL}
    SELECT source_url, description, nullif(employment_type, '') AS employment_type,
      zone_rank, array_to_string(reasons, '; ') AS reasons, array_to_string(blockers, '; ') AS blockers
    FROM stored""",
)
def payload_projection(spark: SparkSession, folder: str) -> DataFrame:
    return stores.payload(scoring.score_postings(R.text_postings(spark, folder), DAY)).select(
        "source_url", "description", "employment_type", "zone_rank", "reasons", "blockers"
    )


# -------------------------------------------------------------------- scan --

SCAN_SQL = f"""{R.POSTINGS_SQL}, {R.STORE_SQL}, {DETAILS_SQL}, {CATEGORISED_SQL},
withpages AS (
  SELECT p.*, d.body, d.qualifications, d.experience
  FROM (SELECT * FROM stored WHERE category = 'FORM4' AND source_url <> '') p
  LEFT JOIN (SELECT * FROM details WHERE source_url NOT IN (SELECT source_url FROM store)) d USING (source_url)),
{S.judged('withpages')},
verdicts AS (
  SELECT source_url, seq, source, title, company, location, description, score, tier, eligibility, employment_type,
    posted_date, deadline_date, category, zone_rank, reasons, blockers, remote_wording, true AS ok
  FROM stored WHERE category <> 'FORM4' AND source_url <> ''
  UNION ALL BY NAME
  SELECT source_url, seq, source, title, company, location, coalesce(nullif(body, ''), description) AS description,
    (CASE WHEN level = 'confirmed' THEN 70 ELSE 55 END)::INT AS score, 'consider' AS tier, eligibility, employment_type,
    posted_date, coalesce(deadline_date, {S.deadline("nullif(body, '')")}) AS deadline_date, category, zone_rank,
    verdict_reasons AS reasons, []::VARCHAR[] AS blockers, remote_wording, ok
  FROM judged),
flagged AS (
  SELECT *, ok AND NOT remote AS ins, ok AND NOT remote AND category <> 'FORM4' AS fil, NOT ok AND NOT remote AS rejected
  FROM (SELECT *, remote_wording OR eligibility IN ('REMOTE-AFRICA', 'REMOTE-WORLDWIDE', 'REMOTE-RESTRICTED') AS remote
    FROM verdicts)),
{merged_sql('flagged')},
alerted AS (
  SELECT *, tier = 'strong' AND ((is_new AND category <> 'FORM4') OR (touched AND NOT coalesce(sent, false))) AS due
  FROM merged)"""


def _scan(
    spark: SparkSession,
    folder: str,
    failed: DataFrame | None = None,
    work_folder: str | None = None,
) -> scan.Scan:
    return scan.run(
        R.postings(spark, folder),
        R.store(spark, folder),
        detail_pages.parse(R.details(spark, folder)),
        DAY,
        failed_urls=failed,
        work_folder=work_folder,
    )


@query(
    "scan_store",
    f"WITH {SCAN_SQL} SELECT {_UPSERT_COLUMNS}, description, {sql_stamp('updated_at')} FROM merged",
)
def scan_store(spark: SparkSession, folder: str) -> DataFrame:
    """The store after a whole scan that is logged: score, gate, qualify, append the changes, merge on read."""
    log = new_log(R.store(spark, folder))
    scan.run_logged(R.postings(spark, folder), log, 0, detail_pages.parse(R.details(spark, folder)), DAY)
    return changelog.current(spark, log).select(*_UPSERT_COLUMNS.split(", "), "description", stamp("updated_at"))


def _escape(value: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        value = f"replace({value}, '{raw}', '{safe}')" if raw != "''" else f"replace({value}, '''', '{safe}')"
    return value


_LABEL = "CASE latest.eligibility " + " ".join(
    f"WHEN '{c}' THEN '{t}'" for c, t in rules.ELIGIBILITY_LABELS.items()
) + " ELSE '❓ LOCATION UNCLEAR' END"
_MESSAGE = (
    f"{_LABEL} || chr(10) || '🎯 MATCH: ' || score || '%' || chr(10) || chr(10) || '💼 ' || {_escape('latest.title')} "
    f"|| chr(10) || '🏢 ' || {_escape('latest.company')} || chr(10) || '📍 ' || {_escape('latest.location')} "
    "|| chr(10) || chr(10) || 'Why it matches:' || chr(10) || array_to_string(list_transform(list_filter(latest.reasons, "
    f"lambda x: NOT starts_with(x, 'Eligibility:') AND x <> {_LABEL}), lambda x: '• ' || {_escape('x')}), chr(10)) "
    f"|| chr(10) || chr(10) || '🔗 <a href=\"' || {_escape('source_url')} || '\">Apply</a>'"
)


@query(
    "alert_payload",
    f"""WITH {SCAN_SQL} SELECT source_url, CASE WHEN is_new THEN 'new' ELSE 'retry' END AS kind, score,
      {_MESSAGE} AS message FROM alerted WHERE due""",
)
def alert_payload(spark: SparkSession, folder: str) -> DataFrame:
    return _scan(spark, folder).alerts


@query(
    "alert_retry",
    f"""WITH {R.POSTINGS_SQL}, {R.STORE_SQL}
    SELECT p.k, p.source_url, s.score, s.tier FROM postings p JOIN store s USING (source_url)
    WHERE s.tier = 'strong' AND NOT s.telegram_sent""",
)
def alert_retry(spark: SparkSession, folder: str) -> DataFrame:
    """Listings of known postings that are strong and were never alerted."""
    waiting = R.store(spark, folder).where(
        (F.col("tier") == "strong") & ~F.coalesce(F.col("telegram_sent"), F.lit(False))
    )
    listed = R.postings(spark, folder).where(collect.known_url()).select("k", "source_url")
    return listed.join(waiting.select("source_url", "score", "tier"), "source_url")


_FAILS = "substr(source_url, length('https://jobs.example/job/') + 1)::BIGINT % 7 = 0"


@query(
    "scan_metrics",
    f"""WITH {SCAN_SQL}, tries AS (
      SELECT *, CASE WHEN due AND {_FAILS} THEN n_fills WHEN due THEN 1 ELSE 0 END AS attempts FROM alerted),
    sums AS (SELECT (count(*) FILTER (WHERE is_new AND category = 'FORM4') + sum(n_fills))::BIGINT AS processed,
        count(*) FILTER (WHERE is_new) AS new_jobs,
        count(*) FILTER (WHERE is_new AND category <> 'FORM4' AND tier = 'strong') AS strong,
        count(*) FILTER (WHERE is_new AND category <> 'FORM4' AND tier = 'consider') AS consider,
        sum(attempts)::BIGINT AS alert_attempts,
        (sum(attempts) FILTER (WHERE NOT {_FAILS}))::BIGINT AS alerts_sent,
        (sum(attempts) FILTER (WHERE {_FAILS}))::BIGINT AS alert_failures,
        count(*) FILTER (WHERE is_new AND category = 'FORM4') AS school_saved FROM tries),
    refusals AS (SELECT count(*) AS school_rejected FROM flagged f LEFT JOIN merged m USING (source_url)
      WHERE f.rejected AND (m.in_store IS NULL OR (NOT m.in_store AND f.seq < m.first_seq)))
    SELECT (SELECT count(*) FROM postings) AS fetched, sums.*,
      (SELECT count(*) FROM flagged WHERE remote) AS remote_dropped,
      (SELECT school_rejected FROM refusals) AS school_rejected FROM sums""",
)
def scan_metrics(spark: SparkSession, folder: str) -> DataFrame:
    number = F.regexp_extract("source_url", r"(\d+)$", 1).cast("long")
    listed = R.postings(spark, folder).where(collect.known_url())
    failed = listed.select("source_url").where(number % 7 == 0)
    done = scan.run_logged(
        R.postings(spark, folder), new_log(R.store(spark, folder)), 0, detail_pages.parse(R.details(spark, folder)), DAY,
        failed_urls=failed,
    )
    return done.metrics


@query(
    "scan_after_delivery",
    f"WITH {SCAN_SQL} SELECT source_url, 'retry' AS kind, score FROM alerted WHERE due AND {_FAILS}",
)
def scan_after_delivery(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts of a second scan of the same listings, after most alerts of the first went out: only the failed ones come again."""
    log, pages = new_log(R.store(spark, folder)), detail_pages.parse(R.details(spark, folder))
    first = scan.run_logged(R.postings(spark, folder), log, 0, pages, DAY).alerts
    number = F.regexp_extract("source_url", r"(\d+)$", 1).cast("long")
    delivered = first.where(number % 7 != 0).select("source_url")
    second = scan.run_logged(R.postings(spark, folder), log, 1, pages, DAY, delivered=delivered)
    return second.alerts.select("source_url", "kind", "score")


# ------------------------------------------------------------------- flags --


@query(
    "mark_flags",
    f"""WITH {R.FULL_STORE_SQL}, {R.DELIVERIES_SQL},
    ids AS (SELECT DISTINCT source_url FROM deliveries WHERE outcome = 'sent')
    SELECT s.source_url, s.telegram_sent OR i.source_url IS NOT NULL AS telegram_sent,
      strftime(CASE WHEN i.source_url IS NOT NULL THEN {NOW} ELSE s.updated_at END, '%Y-%m-%d %H:%M:%S') AS updated_at
    FROM store s LEFT JOIN ids i USING (source_url)""",
)
def mark_flags(spark: SparkSession, folder: str) -> DataFrame:
    sent = R.deliveries(spark, folder).where(F.col("outcome") == "sent")
    marked = stores.mark(R.full_store(spark, folder), sent, "telegram_sent", DAY)
    return marked.select("source_url", "telegram_sent", stamp("updated_at"))


@query(
    "mark_digested",
    f"""WITH {R.FULL_STORE_SQL}
    SELECT source_url, CASE WHEN digested IS NULL THEN NULL ELSE true END AS digested,
      strftime(CASE WHEN NOT digested THEN {NOW} ELSE updated_at END, '%Y-%m-%d %H:%M:%S') AS updated_at
    FROM store""",
)
def mark_digested(spark: SparkSession, folder: str) -> DataFrame:
    return digest.mark_reported(R.full_store(spark, folder), DAY).select(
        "source_url", "digested", stamp("updated_at")
    )


@query(
    "digest_logged",
    f"""WITH {R.FULL_STORE_SQL}
    SELECT source_url, CASE WHEN digested IS NULL THEN NULL ELSE true END AS digested,
      strftime(CASE WHEN NOT digested THEN {NOW} ELSE updated_at END, '%Y-%m-%d %H:%M:%S') AS updated_at
    FROM store""",
)
def digest_logged(spark: SparkSession, folder: str) -> DataFrame:
    """The store after a digest whose marks are logged beside it."""
    log = new_log(R.full_store(spark, folder))
    digest.run_logged(spark, log, 0, DAY, "Digest", new_folder(spark, "digest"))
    return changelog.current(spark, log).select("source_url", "digested", stamp("updated_at"))


@query(
    "status_after_changes",
    f"""WITH {SCAN_SQL}, after AS (SELECT m.*, CASE WHEN m.in_store THEN s.digested ELSE false END AS digested
      FROM merged m LEFT JOIN store s ON s.source_url = m.source_url)
    SELECT count(*) AS total_jobs, count(*) FILTER (WHERE sent) AS alerts_sent, count(*) FILTER (WHERE tier = 'strong') AS strong_jobs,
      count(*) FILTER (WHERE tier = 'strong' AND NOT sent) AS strong_unsent, count(*) FILTER (WHERE digested = false) AS digest_queue,
      round(avg(score), 4) AS average_score FROM after""",
)
def status_after_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The status report after a scan, from the sums before it and the rows it logged."""
    log = new_log(R.store(spark, folder))
    before = written(reports.status_sums(spark.table(log.base)), "status")
    scan.run_logged(R.postings(spark, folder), log, 0, detail_pages.parse(R.details(spark, folder)), DAY)
    return reports.status_of(reports.status_moved(before, changelog.logged(spark, log, 1)))


def _toggled(flag: str, wanted: str) -> str:
    return (
        f"SELECT source_url, arg_max(value, (moment, command_id)) AS value, arg_max(moment, (moment, command_id)) AS moment "
        f"FROM toggles WHERE {wanted} GROUP BY source_url"
    )


@query(
    "toggle_state",
    f"""WITH {R.FULL_STORE_SQL}, {R.TOGGLES_SQL}, sv AS ({_toggled('saved', 'for_saved')}), ap AS ({_toggled('applied', 'NOT for_saved')})
    SELECT s.source_url, CASE WHEN sv.moment IS NULL THEN s.saved ELSE sv.value END AS saved,
      strftime(CASE WHEN sv.moment IS NULL THEN s.saved_at WHEN sv.value THEN sv.moment END, '%Y-%m-%d %H:%M:%S') AS saved_at,
      CASE WHEN ap.moment IS NULL THEN s.applied ELSE ap.value END AS applied,
      strftime(CASE WHEN ap.moment IS NULL THEN s.applied_at WHEN ap.value THEN ap.moment END, '%Y-%m-%d %H:%M:%S') AS applied_at
    FROM store s LEFT JOIN sv USING (source_url) LEFT JOIN ap USING (source_url)""",
)
def toggle_state(spark: SparkSession, folder: str) -> DataFrame:
    commands = R.toggles(spark, folder)
    saved = stores.toggle(R.full_store(spark, folder), commands.where("for_saved"), "saved")
    both = stores.toggle(saved, commands.where("not for_saved"), "applied")
    return both.select("source_url", "saved", stamp("saved_at"), "applied", stamp("applied_at"))


_OUTBOX_SQL = f"""WITH {R.DELIVERIES_SQL}, {{outbox}}
    SELECT source_url, channel, status, attempts, last_error, {sql_stamp('sent_at')}, {sql_stamp('created_at')},
      {sql_stamp('updated_at')} FROM outbox""".replace(
        "{outbox}",
        """outbox AS (
      SELECT source_url, channel,
        coalesce(arg_max(outcome, (moment, event_id)) FILTER (WHERE outcome <> 'pending'), 'pending') AS status,
        (count(*) FILTER (WHERE outcome <> 'pending'))::INT AS attempts,
        arg_max_null(CASE WHEN outcome = 'failed' THEN error END, (moment, event_id)) FILTER (WHERE outcome <> 'pending') AS last_error,
        max(moment) FILTER (WHERE outcome = 'sent') AS sent_at, min(moment) AS created_at,
        coalesce(max(moment) FILTER (WHERE outcome <> 'pending'), min(moment)) AS updated_at
      FROM deliveries GROUP BY source_url, channel)""",
)
_OUTBOX = ("source_url", "channel", "status", "attempts", "last_error")


def _shown_outbox(notifications: DataFrame) -> DataFrame:
    return notifications.select(*_OUTBOX, stamp("sent_at"), stamp("created_at"), stamp("updated_at"))


@query("outbox_fold", _OUTBOX_SQL)
def outbox_fold(spark: SparkSession, folder: str) -> DataFrame:
    return _shown_outbox(outbox.fold(R.deliveries(spark, folder)))


@query("outbox_merge", _OUTBOX_SQL)
def outbox_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The outbox kept up over three slices of the log of events, one of which comes twice."""
    events = R.deliveries(spark, folder)
    last = events.agg(F.max("event_id")).first()[0] or 0
    slices = [events.where(F.col("event_id") <= last * (n + 1) // 3) for n in range(3)]
    states = written(outbox.partial(slices[0]), "outbox")
    for part in (slices[1], slices[1], slices[2]):
        states = written(outbox.advanced(states, part), "outbox")
    return _shown_outbox(outbox.finished(states))


# ------------------------------------------------------------- maintenance --


@query(
    "zone_backfill",
    f"""WITH {R.FULL_STORE_SQL}
    SELECT source_url, (CASE WHEN zone_rank = 9 THEN least(coalesce({S.zone('location')}, 9), coalesce({S.zone('title')}, 9))
      ELSE zone_rank END)::INT AS zone_rank FROM store""",
)
def zone_backfill(spark: SparkSession, folder: str) -> DataFrame:
    return stores.backfill_zones(R.full_store(spark, folder), DAY).select("source_url", "zone_rank")


_KEPT = (
    "coalesce(saved, false) OR coalesce(applied, false) OR NOT (coalesce(eligibility IN "
    "('REMOTE-AFRICA', 'REMOTE-WORLDWIDE', 'REMOTE-RESTRICTED'), false) OR source IN "
    "('Himalayas', 'RemoteOK', 'We Work Remotely'))"
)


@query(
    "purge_cascade",
    f"""WITH {R.FULL_STORE_SQL}, {R.DELIVERIES_SQL}, {R.POSTINGS_SQL}, kept AS (SELECT source_url FROM store WHERE {_KEPT})
    SELECT 'posting' AS kind, source_url, 1::BIGINT AS n FROM kept
    UNION ALL SELECT 'delivery', source_url, count(*) FROM deliveries
      WHERE source_url IN (SELECT source_url FROM kept) GROUP BY source_url
    UNION ALL SELECT 'saved', source_url, 1 FROM store WHERE saved AND ({_KEPT})
    UNION ALL SELECT 'application', source_url, 1 FROM store WHERE applied AND ({_KEPT})
    UNION ALL SELECT 'match', source_url, 1 FROM (SELECT DISTINCT source_url FROM postings WHERE source_url <> '')
      WHERE source_url IN (SELECT source_url FROM kept)""",
)
def purge_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Maintenance of a snapshot: what stays of postings and their four child tables."""
    store = R.full_store(spark, folder)
    kept, rest = maintain.run(
        store,
        {
            "delivery": R.deliveries(spark, folder),
            "saved": children.saved(store),
            "application": children.applications(store),
            "match": _matches(spark, folder),
        },
        DAY,
    )
    rows = kept.select(F.lit("posting").alias("kind"), "source_url", F.lit(1).cast("long").alias("n"))
    for name, child in rest.items():
        counts = child.groupBy("source_url").agg(F.count(F.lit(1)).alias("n"))
        rows = rows.unionByName(counts.select(F.lit(name).alias("kind"), "source_url", "n"))
    return rows


def _matches(spark: SparkSession, folder: str) -> DataFrame:
    listed = collect.with_category(R.postings(spark, folder).where(collect.known_url()))
    return children.matches(scoring.score_postings(listed, DAY), ("seq",))


@query(
    "match_rows",
    f"""WITH {R.POSTINGS_SQL}, {S.SCORED_SQL}
    SELECT source_url, r.score AS score, r.tier AS tier, array_to_string(r.skills, '; ') AS matched_skills,
      array_to_string(r.matched_locations, '; ') AS matched_locations, array_to_string(r.reasons, '; ') AS reasons,
      array_to_string(r.blockers, '; ') AS blockers
    FROM (SELECT source_url, arg_min({{'score': score, 'tier': tier, 'skills': skills, 'matched_locations': matched_locations,
      'reasons': reasons, 'blockers': blockers}}, seq) AS r FROM scored WHERE source_url <> '' GROUP BY source_url)""",
)
def match_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The match table of all postings: every skill and place, also those that the reasons don't show."""
    return _matches(spark, folder)


@query(
    "evolve_schema",
    f"""WITH {R.FULL_STORE_SQL}
    SELECT source_url, score, NULL::VARCHAR AS eligibility, 'ICT' AS category, 9::INT AS zone_rank, false AS saved,
      NULL::VARCHAR AS saved_at, false AS applied, strftime(CASE WHEN score % 2 = 0 THEN updated_at ELSE {NOW} END,
      '%Y-%m-%d %H:%M:%S') AS updated_at FROM store""",
)
def evolve_schema(spark: SparkSession, folder: str) -> DataFrame:
    old = R.full_store(spark, folder).drop(
        "eligibility", "category", "zone_rank", "saved", "saved_at", "applied", "applied_at"
    )
    gaps = old.withColumn("updated_at", F.when(F.col("score") % 2 == 0, F.col("updated_at")))
    grown = stores.add_columns(stores.add_columns(gaps, as_of=DAY), as_of=DAY)
    return grown.select(
        "source_url", "score", "eligibility", "category", "zone_rank", "saved", stamp("saved_at"),
        "applied", stamp("updated_at"),
    )


@query(
    "seed_sources",
    f"""WITH names AS (SELECT DISTINCT {R._SOURCE} || ' ' || o_custkey % 40 AS name, o_custkey % 40 AS n FROM orders),
    dim AS (SELECT name, 'https://b' || n || '.example' AS base_url, n % 2 = 0 AS active FROM names WHERE n % 3 = 0)
    SELECT name, base_url, active FROM dim
    UNION ALL SELECT name, NULL, true FROM names WHERE name NOT IN (SELECT name FROM dim)""",
)
def seed_sources(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("o_custkey") % 40
    board = R.pick(rules.BOARDS, F.col("o_orderkey") * 3 + F.col("o_custkey"))
    names = table(spark, folder, "orders").select(
        F.concat_ws(" ", board, n.cast("string")).alias("name"), n.alias("n")
    )
    dimension = names.where("n % 3 = 0").distinct().select(
        "name",
        F.concat(F.lit("https://b"), F.col("n").cast("string"), F.lit(".example")).alias("base_url"),
        (F.col("n") % 2 == 0).alias("active"),
    )
    return stores.seed(dimension, names.select("name", F.lit(True).alias("active")))


@query(
    "surrogate_ids",
    f"WITH {R.FULL_STORE_SQL} SELECT count(*) AS postings, count(DISTINCT source_url) AS ids FROM store",
)
def surrogate_ids(spark: SparkSession, folder: str) -> DataFrame:
    """As many ids as postings, on these tables."""
    return R.full_store(spark, folder).agg(
        F.count(F.lit(1)).alias("postings"),
        F.countDistinct(surrogate_id(F.col("source_url"))).alias("ids"),
    )




@query(
    "lookup_by_url",
    f"""WITH {R.FULL_STORE_SQL} SELECT source_url, title, score FROM store
    WHERE source_url = (SELECT max(source_url) FROM store)""",
)
def lookup_by_url(spark: SparkSession, folder: str) -> DataFrame:
    """The posting with one URL, from its bucket of a store and of its log."""
    log = new_log(R.full_store(spark, folder))
    url = spark.table(log.base).agg(F.max("source_url")).first()[0]
    return changelog.by_url(spark, log, url).select("source_url", "title", "score")
