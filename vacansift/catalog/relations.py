"""Relations every registered query starts from, derived from the driver tables.

The driver tables hold none of the vocabulary the rules look for, so postings
are derived row by row from ``orders`` (and ``events``, ``documents``) with
integer arithmetic that picks phrases. The phrase lists cover every rule branch.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacansift import rules
from vacansift.functions.text import literal_list
from vacansift.sources.tables import table

AS_OF = dt.date(2001, 8, 1)

TITLES = (
    "Web Developer, Junior", "Computer Support Assistant", "Principal Backend Engineer",
    "Mobile App Developer", "ICT Assistant", "Storekeeper", "Gardener - Lavington",
    "Tanker Truck Driver", "Field Agent - Mtwapa", "Service Desk Analyst",
    "Network Installer", "Front Office Clerk", "Remote Chat Agent",
    "Interface Developer Intern", "Typist and Data Entry", "Senior Area Manager",
    "Kitchen Porter", "ICT Attachment (2 Places)", "Lead Programmer", "Night Guard",
    "  Filing   Clerk ", "Virtual Office Helper", "Teacher at Lake School", "Baker",
)
LOCATIONS = (
    "Nairobi, Kenya", "Malindi", "Mombasa", "Remote / Worldwide", "Africa",
    "United States Only", "Eldoret", "Narok", "Kericho", "Nairobi, Mombasa, Malindi",
    "Work from home", "East Africa", "Kilifi", "Westlands", "Europe", "Thika",
    "Berlin", "Diani", "Maasai Mara",
)
OPENINGS = (
    "Our web shop needs html, css and javascript every day, react.js now and then.",
    "You keep printers, cabling and networking alive and answer the help desk line.",
    "Ten services in node.js over postgresql wait for a senior hand with 10+ years.",
    "Builds phone apps in java or kotlin, reviewed through git and github.",
    "Reaches the monthly sales figures and keeps the customer book.",
    "The post includes travel to remote areas of two counties.",
    "This is a fully remote role with weekly calls.",
    "Colleagues in nine countries; Bonus only after probation.",
    "Files, audits and records   management for the branch.",
    "Data entry into postgres through a typescript form.",
    "We hire people who work from anywhere.",
    "Sweep the   yard and polish the counters.",
    "Takes over as shift lead of the depot.",
)
REQUIREMENTS = (
    "Must hold a driving permit or PSV badge.",
    "HND or university graduate, ready to travel.",
    "Form four or diploma, whichever came last.",
    "Diploma holders only; form iv leavers next year.",
    "A trade test is desirable, good eyesight is not optional.",
    "kcse mean of C (plain) will do.",
    "Needs a minimum grade B- in kcse; craft course a plus.",
    "Form 4, mean grade of at least D+ and steady hands.",
    "Secondary school level, grade of C plus at the least.",
    "kcpe, minimum grade e, if the head teacher says so",
    "Registration by the nursing council within a month.",
    "Carry photocopies of original supporting documents and a birth certificate.",
    "CCNA or proficiency in Linux.",
    "School leaving certificates and testimonials at the gate.",
    "Fresh graduates welcome, training on the job.",
    "Only residents of Canada can be considered.",
    "Candidates must live in the UK.",
)
ENDINGS = (
    "Application deadline: 29th July 2001.",
    "Closing date 30/08/2001.",
    "Apply by September 24, 2001.",
    "Deadline: 31 February 2001, or August 10, 2001.",
    "Posted 27 August by the office.",
    "Full-time contract.",
    "Internship over one term.",
    "Part time work.",
    "Canada only.",
    "European union only.",
    "Graduate trainee intake.",
    "Remote work possible.",
    "",
    "Deadline not given, opened 4 May 2001 or thereabouts.",
)
ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderdate")
CATEGORIES_PER_BOARD = 3
PAGES_PER_CATEGORY = 3


# ------------------------------------------------------------------- Spark --


def pick(values: Sequence[str], index: Column) -> Column:
    return F.get(literal_list(values), (index % len(values)).cast("int"))


def dealt(rows: DataFrame) -> DataFrame:
    """Source columns dealt out over all cores before rows are derived from them: a driver table is a single row group, which one task reads."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def url_number(k: Column) -> Column:
    """Of ten orders in a row, three share a URL."""
    return F.when(k % 10 == 9, k - 9).when(k % 5 == 4, k - 4).otherwise(k)


def description(k: Column, c: Column) -> Column:
    return F.concat_ws(
        " ",
        pick(OPENINGS, k * 11 + c),
        pick(REQUIREMENTS, k * 13 + c * 2),
        pick(ENDINGS, k + c * 5),
    )


def raw_postings(orders: DataFrame) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    as_of = F.lit(AS_OF)
    return orders.select(
        k.alias("k"),
        c.alias("c"),
        pick(rules.BOARDS, k * 3 + c).alias("source"),
        F.when(k % 97 == 5, F.lit(None))
        .when(k % 101 == 7, F.lit(""))
        .otherwise(F.concat(F.lit("https://jobs.example/job/"), url_number(k).cast("string")))
        .alias("source_url"),
        pick(TITLES, k * 7 + c).alias("title"),
        F.format_string("Customer#%09d", c).alias("company"),
        pick(LOCATIONS, k * 5 + c * 3).alias("location"),
        description(k, c).alias("description"),
        F.when(k % 13 == 0, F.lit("Full Time"))
        .when(k % 13 == 1, F.lit("Contract"))
        .when(k % 13 == 2, F.lit(None))
        .otherwise(F.lit(""))
        .alias("employment_type"),
        F.when(k % 11 == 0, F.lit(None))
        .when(k % 3 == 0, F.col("o_orderdate").cast("date"))
        .otherwise(F.date_sub(as_of, (k % 45 - 3).cast("int")))
        .alias("posted_date"),
        F.when(k % 6 == 0, F.date_add(as_of, (k % 30).cast("int"))).alias("deadline_date"),
        F.when(k % 5 == 0, F.lit("FORM4"))
        .when(k % 5 == 1, F.lit("ICT"))
        .when(k % 5 == 2, F.lit(""))
        .alias("category_hint"),
        # Collection order: board by board, then by key.
        (((k * 3 + c) % len(rules.BOARDS)) * 1_000_000_000_000 + k).alias("seq"),
    )


def postings(spark: SparkSession, folder: str) -> DataFrame:
    """One posting per order."""
    return raw_postings(dealt(table(spark, folder, "orders").select(*ORDER_COLUMNS)))


def text_postings(spark: SparkSession, folder: str) -> DataFrame:
    """One posting per document: the whole text between two phrases."""
    d = F.col("doc_id")
    return dealt(table(spark, folder, "documents").select("doc_id", "source", "text")).select(
        d.alias("k"),
        F.lit("MyJobMag").alias("source"),
        F.concat(F.lit("https://docs.example/job/"), d.cast("string")).alias("source_url"),
        pick(TITLES, d * 7).alias("title"),
        F.col("source").alias("company"),
        pick(LOCATIONS, d * 5).alias("location"),
        F.concat_ws(
            " ", pick(OPENINGS, d * 11), F.col("text"), pick(REQUIREMENTS, d * 13), pick(ENDINGS, d)
        ).alias("description"),
        F.lit("").alias("employment_type"),
        F.date_sub(F.lit(AS_OF), (d % 45).cast("int")).alias("posted_date"),
        F.lit(None).cast("date").alias("deadline_date"),
        F.lit(None).cast("string").alias("category_hint"),
        d.alias("seq"),
    )


def store(spark: SparkSession, folder: str) -> DataFrame:
    """A snapshot that listings overlap with: every third order that owns its URL."""
    return _stored(table(spark, folder, "orders").where(F.col("o_orderkey") % 3 == 0))


def full_store(spark: SparkSession, folder: str) -> DataFrame:
    """A snapshot of every order that owns its URL."""
    return _stored(table(spark, folder, "orders"))


def _stored(orders: DataFrame) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    owners = dealt(orders.select(*ORDER_COLUMNS).where((k % 10 != 9) & (k % 5 != 4)))
    at = F.timestamp_add("MINUTE", -(k % 50000), F.lit(AS_OF).cast("timestamp"))
    return owners.select(
        F.when(k % 29 == 0, F.lit("RemoteOK"))
        .otherwise(pick(rules.BOARDS, k * 3 + c))
        .alias("source"),
        F.concat(F.lit("https://jobs.example/job/"), k.cast("string")).alias("source_url"),
        pick(TITLES, k * 7 + c).alias("title"),
        F.format_string("Customer#%09d", c).alias("company"),
        pick(LOCATIONS, k * 5 + c * 3).alias("location"),
        description(k, c).alias("description"),
        F.when(k % 41 != 0, (k * 17 + c) % 101).cast("int").alias("score"),
        F.when((k * 17 + c) % 101 >= rules.STRONG_FROM, F.lit("strong"))
        .when((k * 17 + c) % 101 >= rules.CONSIDER_FROM, F.lit("consider"))
        .when(k % 37 == 0, F.lit(None))
        .otherwise(F.lit("poor"))
        .alias("tier"),
        F.when(k % 4 != 1, pick(("KENYA", "UNKNOWN", "REMOTE-AFRICA", "REMOTE-WORLDWIDE"), k + c))
        .alias("eligibility"),
        F.when(k % 13 == 0, F.lit("Full Time"))
        .when(k % 2 == 0, F.lit(""))
        .alias("employment_type"),
        F.when(k % 7 != 0, F.col("o_orderdate").cast("date")).alias("posted_date"),
        F.when(k % 8 == 0, F.date_add(F.lit(AS_OF), (k % 30).cast("int"))).alias("deadline_date"),
        F.when(k % 5 == 0, F.lit("FORM4")).otherwise(F.lit("ICT")).alias("category"),
        F.when(k % 2 == 0, 9).otherwise(k % 5).cast("int").alias("zone_rank"),
        F.concat(F.lit("stored "), k.cast("string")).alias("reasons"),
        F.lit("").alias("blockers"),
        (k % 4 == 0).alias("telegram_sent"),
        F.when(k % 19 != 0, k % 6 < 3).alias("digested"),
        (k % 23 == 0).alias("applied"),
        F.when(k % 23 == 0, at).alias("applied_at"),
        F.when(k % 31 != 0, k % 17 == 0).alias("saved"),
        F.when(k % 17 == 0, at).alias("saved_at"),
        at.alias("fetched_at"),
        at.alias("updated_at"),
        at.alias("created_at"),
    )


def details(spark: SparkSession, folder: str) -> DataFrame:
    """Detail pages (as HTML) of some orders only, for joins in which others have none."""
    k = F.col("o_orderkey")
    return detail_pages(table(spark, folder, "orders").where((k % 5 == 0) & (k % 4 != 0)))


def detail_pages(orders: DataFrame) -> DataFrame:
    """The detail page of each order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    tags = pick(
        (
            "<a>Diploma</a> , <a>KCSE</a>", "<a>KCSE</a>", "<a>First School Leaving Certificate</a>",
            "<a>Others</a>", "<a>Vocational</a> , <a>MBA/MSc/MA</a>",
        ),
        k + c,
    )
    html = F.concat(
        F.lit("<html><body><nav>Jobs by Education Diploma KCSE Vocational</nav><div><h1>"),
        pick(TITLES, k * 7 + c),
        F.lit("</h1>\n<ul><li>Job Type <a>Full Time</a></li>\n<li>Qualification "),
        tags,
        F.lit("</li>\n<li>Experience "),
        (k % 4).cast("string"),
        F.lit(" year</li>\n<li>Location <a>Nairobi</a></li>\n<li>Job Field <a>Sales</a></li>\n"
              "</ul>\n<p>Basic   math skills &amp; care.</p>\n<p>"),
        pick(REQUIREMENTS, k * 3 + c),
        F.lit("</p>\n<p>"),
        pick(ENDINGS, k * 9 + c),
        F.lit("</p>\n<h2>"),
        pick(rules.DETAIL_ENDS, k),
        F.lit("</h2>\n<p>Send a diploma.</p></div><footer>Degree</footer></body></html>"),
    )
    return dealt(orders.select(*ORDER_COLUMNS)).select(
        F.concat(F.lit("https://jobs.example/job/"), k.cast("string")).alias("source_url"),
        F.when(k % 35 == 0, F.lit("<html><body>nothing</body></html>")).otherwise(html).alias("html"),
    )


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_type")
    return table(spark, folder, "events").select(
        F.concat(F.lit("https://jobs.example/job/"), (F.col("user_id") * 3).cast("string")).alias(
            "source_url"
        ),
        F.when(F.col("event_id") % 2 == 0, F.lit("telegram")).otherwise(F.lit("email")).alias("channel"),
        F.when(e == "error", F.lit("failed"))
        .when(e == "purchase", F.lit("sent"))
        .otherwise(F.lit("pending"))
        .alias("outcome"),
        F.concat(F.lit("code "), (F.col("event_id") % 7).cast("string")).alias("error"),
        F.col("ts").cast("timestamp").alias("at"),
        "event_id",
    )


def toggles(spark: SparkSession, folder: str) -> DataFrame:
    """On/off commands for the saved and applied flags."""
    return (
        table(spark, folder, "events")
        .where(F.col("event_type").isin("click", "view"))
        .select(
            F.concat(
                F.lit("https://jobs.example/job/"), (F.col("user_id") * 3).cast("string")
            ).alias("source_url"),
            (F.col("event_type") == "click").alias("value"),
            F.col("ts").cast("timestamp").alias("at"),
            F.col("event_id").alias("command_id"),
            (F.col("event_id") % 2 == 0).alias("for_saved"),
        )
    )


def crawl(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of a crawl: categories overlap and repeat earlier URLs."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    board = (k * 3 + c) % len(rules.BOARDS)
    category = k.cast("long") % CATEGORIES_PER_BOARD
    page = (F.floor(k / 3) % PAGES_PER_CATEGORY + 1).cast("int")
    # Some boards repeat page 1 on later pages, or category 0 in category 2.
    repeated = (
        F.when((board % 4 == 1) & (page == 2), k % 3)
        .when((board % 4 == 2) & (category == 2), k % 9)
        .when((board % 4 == 3) & (category == 1) & (page == 3), k % 6)
        .when((board % 4 == 1) & (page == 1), F.when(k % 2 == 0, k % 3).otherwise(k))
        .otherwise(k)
    )
    return table(spark, folder, "orders").select(
        pick(rules.BOARDS, board).alias("source"),
        F.concat(F.lit("https://jobs.example/job/"), repeated.cast("string")).alias("source_url"),
        category.cast("int").alias("category_ord"),
        page.alias("page"),
        k.alias("pos"),
    )


def feed(spark: SparkSession, folder: str) -> DataFrame:
    """JSON feed entries as text."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    named = lambda *n: F.array(*[F.struct(F.lit(v).alias("name")) for v in n])
    created = F.concat(
        F.date_format(F.col("o_orderdate"), "yyyy-MM-dd"),
        pick(("T23:30:00+03:00", "T00:15:00Z", "T08:00:00+00:00"), k),
    )
    fields = F.struct(
        F.when(k % 23 == 0, F.lit(" ")).otherwise(pick(TITLES, k * 7 + c)).alias("title"),
        F.when(k % 19 != 0, F.concat(F.lit("https://feed.example/job/"), k.cast("string")))
        .alias("url_alias"),
        F.struct(F.when(k % 17 != 0, created).otherwise(F.lit("soon")).alias("created")).alias("date"),
        F.concat(
            F.lit("<p>"), pick(OPENINGS, k * 11 + c), F.lit("</p><p>Pay &amp; leave.</p><b>"),
            pick(ENDINGS, k + c), F.lit("</b>"),
        ).alias("body"),
        F.when(k % 3 == 0, named("Relief Org", "Health Fund"))
        .when(k % 3 == 1, named("Relief Org"))
        .alias("source"),
        F.when(k % 4 == 0, named("Kenya", "Uganda")).when(k % 4 == 1, named("Kenya")).alias("country"),
    )
    return dealt(table(spark, folder, "orders").select(*ORDER_COLUMNS)).select(
        k.alias("k"), F.to_json(F.struct(fields.alias("fields"))).alias("entry")
    )


# --------------------------------------------------------------------- SQL --


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values: Sequence[str]) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def sql_pick(values: Sequence[str], index: str) -> str:
    return f"{sql_list(values)}[(({index}) % {len(values)}) + 1]"


SQL_DAY = "DATE '2001-08-01'"
_URL_NO = (
    "CASE WHEN o_orderkey % 10 = 9 THEN o_orderkey - 9 "
    "WHEN o_orderkey % 5 = 4 THEN o_orderkey - 4 ELSE o_orderkey END"
)
_BOARD = f"((o_orderkey * 3 + o_custkey) % {len(rules.BOARDS)})"
_SOURCE = sql_pick(rules.BOARDS, "o_orderkey * 3 + o_custkey")
_TITLE = sql_pick(TITLES, "o_orderkey * 7 + o_custkey")
_LOCATION = sql_pick(LOCATIONS, "o_orderkey * 5 + o_custkey * 3")
_DESCRIPTION = (
    f"{sql_pick(OPENINGS, 'o_orderkey * 11 + o_custkey')} || ' ' || "
    f"{sql_pick(REQUIREMENTS, 'o_orderkey * 13 + o_custkey * 2')} || ' ' || "
    f"{sql_pick(ENDINGS, 'o_orderkey + o_custkey * 5')}"
)
_COMPANY = "'Customer#' || lpad(o_custkey::VARCHAR, 9, '0')"

POSTINGS_SQL = f"""postings AS (
  SELECT o_orderkey AS k, o_custkey AS c, {_SOURCE} AS source,
    CASE WHEN o_orderkey % 97 = 5 THEN NULL WHEN o_orderkey % 101 = 7 THEN ''
      ELSE 'https://jobs.example/job/' || ({_URL_NO})::VARCHAR END AS source_url,
    {_TITLE} AS title, {_COMPANY} AS company, {_LOCATION} AS location,
    {_DESCRIPTION} AS description,
    CASE o_orderkey % 13 WHEN 0 THEN 'Full Time' WHEN 1 THEN 'Contract' WHEN 2 THEN NULL
      ELSE '' END AS employment_type,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE
      ELSE {SQL_DAY} - (o_orderkey % 45 - 3)::INT END AS posted_date,
    CASE WHEN o_orderkey % 6 = 0 THEN {SQL_DAY} + (o_orderkey % 30)::INT END AS deadline_date,
    CASE o_orderkey % 5 WHEN 0 THEN 'FORM4' WHEN 1 THEN 'ICT' WHEN 2 THEN '' END AS category_hint,
    {_BOARD} * 1000000000000 + o_orderkey AS seq
  FROM orders)"""

TEXT_POSTINGS_SQL = f"""postings AS (
  SELECT doc_id AS k, 'MyJobMag' AS source, 'https://docs.example/job/' || doc_id AS source_url,
    {sql_pick(TITLES, 'doc_id * 7')} AS title, source AS company,
    {sql_pick(LOCATIONS, 'doc_id * 5')} AS location,
    {sql_pick(OPENINGS, 'doc_id * 11')} || ' ' || text || ' ' ||
      {sql_pick(REQUIREMENTS, 'doc_id * 13')} || ' ' || {sql_pick(ENDINGS, 'doc_id')} AS description,
    '' AS employment_type, {SQL_DAY} - (doc_id % 45)::INT AS posted_date,
    NULL::DATE AS deadline_date, NULL::VARCHAR AS category_hint, doc_id AS seq
  FROM documents)"""

_AT = f"{SQL_DAY}::TIMESTAMP - to_minutes(o_orderkey % 50000)"
STORE_SQL = f"""store AS (
  SELECT CASE WHEN o_orderkey % 29 = 0 THEN 'RemoteOK' ELSE {_SOURCE} END AS source,
    'https://jobs.example/job/' || o_orderkey AS source_url,
    {_TITLE} AS title, {_COMPANY} AS company, {_LOCATION} AS location,
    {_DESCRIPTION} AS description,
    CASE WHEN o_orderkey % 41 <> 0 THEN ((o_orderkey * 17 + o_custkey) % 101)::INT END AS score,
    CASE WHEN (o_orderkey * 17 + o_custkey) % 101 >= {rules.STRONG_FROM} THEN 'strong'
      WHEN (o_orderkey * 17 + o_custkey) % 101 >= {rules.CONSIDER_FROM} THEN 'consider'
      WHEN o_orderkey % 37 = 0 THEN NULL ELSE 'poor' END AS tier,
    CASE WHEN o_orderkey % 4 <> 1 THEN
      {sql_pick(('KENYA', 'UNKNOWN', 'REMOTE-AFRICA', 'REMOTE-WORLDWIDE'), 'o_orderkey + o_custkey')}
      END AS eligibility,
    CASE WHEN o_orderkey % 13 = 0 THEN 'Full Time' WHEN o_orderkey % 2 = 0 THEN '' END AS employment_type,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS posted_date,
    CASE WHEN o_orderkey % 8 = 0 THEN {SQL_DAY} + (o_orderkey % 30)::INT END AS deadline_date,
    CASE WHEN o_orderkey % 5 = 0 THEN 'FORM4' ELSE 'ICT' END AS category,
    CASE WHEN o_orderkey % 2 = 0 THEN 9 ELSE (o_orderkey % 5)::INT END AS zone_rank,
    'stored ' || o_orderkey AS reasons, '' AS blockers,
    o_orderkey % 4 = 0 AS telegram_sent,
    CASE WHEN o_orderkey % 19 <> 0 THEN o_orderkey % 6 < 3 END AS digested,
    o_orderkey % 23 = 0 AS applied,
    CASE WHEN o_orderkey % 23 = 0 THEN {_AT} END AS applied_at,
    CASE WHEN o_orderkey % 31 <> 0 THEN o_orderkey % 17 = 0 END AS saved,
    CASE WHEN o_orderkey % 17 = 0 THEN {_AT} END AS saved_at,
    {_AT} AS fetched_at, {_AT} AS updated_at, {_AT} AS created_at
  FROM orders
  WHERE o_orderkey % 3 = 0 AND o_orderkey % 10 <> 9 AND o_orderkey % 5 <> 4)"""
FULL_STORE_SQL = STORE_SQL.replace("o_orderkey % 3 = 0 AND ", "")

DELIVERIES_SQL = """deliveries AS (
  SELECT 'https://jobs.example/job/' || user_id * 3 AS source_url,
    CASE WHEN event_id % 2 = 0 THEN 'telegram' ELSE 'email' END AS channel,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'sent' ELSE 'pending' END AS outcome,
    'code ' || event_id % 7 AS error, ts AS moment, event_id
  FROM events)"""

TOGGLES_SQL = """toggles AS (
  SELECT 'https://jobs.example/job/' || user_id * 3 AS source_url, event_type = 'click' AS value,
    ts AS moment, event_id AS command_id, event_id % 2 = 0 AS for_saved
  FROM events WHERE event_type IN ('click', 'view'))"""

CRAWL_SQL = f"""crawl AS (
  SELECT {sql_pick(rules.BOARDS, 'board')} AS source,
    'https://jobs.example/job/' || CASE
      WHEN board % 4 = 1 AND page = 2 THEN k % 3
      WHEN board % 4 = 2 AND category_ord = 2 THEN k % 9
      WHEN board % 4 = 3 AND category_ord = 1 AND page = 3 THEN k % 6
      WHEN board % 4 = 1 AND page = 1 THEN CASE WHEN k % 2 = 0 THEN k % 3 ELSE k END
      ELSE k END AS source_url,
    category_ord, page, k AS pos
  FROM (SELECT o_orderkey AS k, {_BOARD} AS board,
      (o_orderkey % {CATEGORIES_PER_BOARD})::INT AS category_ord,
      (o_orderkey // 3 % {PAGES_PER_CATEGORY} + 1)::INT AS page FROM orders))"""
