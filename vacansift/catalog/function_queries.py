"""Scalar functions over whole relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacansift import rules
from vacansift.catalog import relations as R
from vacansift.catalog import sql_rules as S
from vacansift.catalog.registry import query
from vacansift.functions import dates, links, markup, places, qualification, text
from vacansift.operators import reports, scoring
from vacansift.sources.tables import table

DAY = R.AS_OF
K, C = "o_orderkey", "o_custkey"


@query("normalize_text", f"SELECT doc_id, {S.normal('text')} AS text_n FROM documents")
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", text.normalize_text(F.col("text")).alias("text_n")
    )


@query(
    "clean_nested",
    """SELECT o_orderkey AS k,
      CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus || ', ' || CASE WHEN o_orderkey % 3 = 0
        THEN '' ELSE o_orderpriority END END AS tags_text,
      o_orderstatus || ' ' || o_custkey || ' ' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE
        o_orderstatus || ', ' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END END
        || ' ' || CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END AS record_text,
      o_orderpriority || ' ' || o_orderstatus AS map_text
    FROM orders""",
)
def clean_nested(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col(K)
    tags = F.when(
        k % 5 != 0,
        F.array(F.col("o_orderstatus"), F.when(k % 3 != 0, F.col("o_orderpriority"))),
    )
    nested = table(spark, folder, "orders").select(
        k.alias("k"),
        tags.alias("tags"),
        F.struct("o_orderstatus", C, tags.alias("tags"), (k % 2 == 0).alias("even")).alias("record"),
        F.create_map(
            F.lit("first"), F.col("o_orderpriority"), F.lit("second"), F.col("o_orderstatus")
        ).alias("named"),
    )
    kinds = {f.name: f.dataType for f in nested.schema.fields}
    return nested.select(
        "k",
        text.clean_text(F.col("tags"), kinds["tags"]).alias("tags_text"),
        text.clean_text(F.col("record"), kinds["record"]).alias("record_text"),
        text.clean_text(F.col("named"), kinds["named"]).alias("map_text"),
    )


_HEADING_SQL = (
    f"CASE o_orderkey % 7 WHEN 0 THEN t || ' at ' || c WHEN 1 THEN t || ' at Base at ' || c WHEN 2 THEN t "
    "WHEN 3 THEN t || ' Job ' || c WHEN 4 THEN t || ' Job Big Job ' || c WHEN 5 THEN ' at ' || c ELSE '' END"
)


def _or(default: str, value: str) -> str:
    return f"coalesce(nullif(trim({value}), ''), '{default}')"


@query(
    "split_title_company",
    f"""WITH h AS (SELECT o_orderkey AS k, {_HEADING_SQL} AS h FROM (
        SELECT o_orderkey, {R._TITLE} AS t, {R._COMPANY} AS c FROM orders))
    SELECT k, {_or('Untitled', "CASE WHEN contains(h, ' at ') THEN regexp_extract(h, '(?s)^(.*) at (.*)$', 1) ELSE h END")} AS last_title,
      {_or('Unknown', "CASE WHEN contains(h, ' at ') THEN regexp_extract(h, '(?s)^(.*) at (.*)$', 2) ELSE '' END")} AS last_company,
      {_or('Untitled', "CASE WHEN contains(h, ' Job ') THEN regexp_extract(h, '(?s)^(.*?) Job (.*)$', 1) ELSE h END")} AS first_title,
      {_or('Unknown', "CASE WHEN contains(h, ' Job ') THEN regexp_extract(h, '(?s)^(.*?) Job (.*)$', 2) ELSE '' END")} AS first_company
    FROM h""",
)
def split_title_company(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("k")
    t, c = F.col("title"), F.col("company")
    shapes = F.array(
        F.concat(t, F.lit(" at "), c), F.concat(t, F.lit(" at Base at "), c), t,
        F.concat(t, F.lit(" Job "), c), F.concat(t, F.lit(" Job Big Job "), c),
        F.concat(F.lit(" at "), c), F.lit(""),
    )
    headed = R.postings(spark, folder).select(k, F.get(shapes, (k % 7).cast("int")).alias("h"))
    last = text.split_title_company(F.col("h"), " at ", last=True)
    first = text.split_title_company(F.col("h"), " Job ", last=False)
    return headed.select(
        "k",
        last[0].alias("last_title"), last[1].alias("last_company"),
        first[0].alias("first_title"), first[1].alias("first_company"),
    )


@query(
    "classify_location",
    f"""WITH {R.POSTINGS_SQL}, {S.LOCATED_SQL}
    SELECT k, {S.eligibility('place_rule')} AS classified, eligibility,
      CASE WHEN place_rule LIKE 'RESTRICTED:%' THEN 'Restricted to ' || split_part(place_rule, ':', 2)
        WHEN place_rule = 'KENYA' THEN 'Kenya eligibility detected'
        WHEN place_rule = 'REMOTE-AFRICA' THEN 'Africa eligibility detected'
        WHEN place_rule = 'REMOTE-WORLDWIDE' THEN 'Worldwide remote eligibility detected'
        WHEN place_rule = 'UNKNOWN:remote' THEN 'Remote work mentioned, but geographic eligibility is unclear'
        ELSE 'No clear Kenya eligibility found' END AS evidence
    FROM located""",
)
def classify_location(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.with_eligibility(R.postings(spark, folder)).select(
        "k",
        places.eligibility_of(F.col("place_rule")).alias("classified"),
        "eligibility",
        places.evidence_of(F.col("place_rule")).alias("evidence"),
    )


@query(
    "deadline_extract",
    f"WITH {R.POSTINGS_SQL} SELECT k, {S.deadline('description')} AS deadline_date FROM postings",
)
def deadline_extract(spark: SparkSession, folder: str) -> DataFrame:
    return R.postings(spark, folder).select(
        "k", dates.extract_deadline(F.col("description")).alias("deadline_date")
    )


_DM_SQL = f"(o_orderkey % 33)::VARCHAR || ' ' || {R.sql_pick(rules.MONTHS, 'o_orderkey // 33')}"


@query(
    "posted_day_month",
    f"""WITH t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 7 THEN lower({_DM_SQL}) ELSE {_DM_SQL} END AS s,
        (o_orderkey % 33)::VARCHAR AS d, o_orderkey // 33 % 12 + 1 AS m FROM orders),
    y AS (SELECT k, {S.made("'2001'", 'm', 'd')} AS this_year, {S.made("'2000'", 'm', 'd')} AS last_year, s FROM t)
    SELECT k, s AS posted_text, CASE WHEN s <> lower(s) THEN
      CASE WHEN this_year > {R.SQL_DAY} THEN last_year ELSE this_year END END AS posted_date FROM y""",
)
def posted_day_month(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col(K)
    words = F.concat_ws(" ", (k % 33).cast("string"), R.pick(rules.MONTHS, F.floor(k / 33)))
    worded = table(spark, folder, "orders").select(
        k.alias("k"), F.when(k % 50 == 7, F.lower(words)).otherwise(words).alias("posted_text")
    )
    return worded.select(
        "k", "posted_text", dates.posted_day_month(F.col("posted_text"), DAY).alias("posted_date")
    )


_UNITS = ("day", "days", "week", "weeks", "month", "months")


@query(
    "posted_relative",
    f"""SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN {R.SQL_DAY} WHEN 1 THEN {R.SQL_DAY} - 1
      WHEN 2 THEN NULL ELSE {R.SQL_DAY} - ((o_orderkey % 40) * [1, 1, 7, 7, 30, 30][o_orderkey // 5 % 6 + 1])::INT END AS posted_date
    FROM orders""",
)
def posted_relative(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col(K)
    ago = F.concat_ws(" ", (k % 40).cast("string"), R.pick(_UNITS, F.floor(k / 5)), F.lit("ago"))
    phrase = (
        F.when(k % 5 == 0, F.lit("TODAY"))
        .when(k % 5 == 1, F.lit("Yesterday"))
        .when(k % 5 == 2, F.lit("some days ago"))
        .otherwise(ago)
    )
    card = F.concat_ws(" ", F.col("o_orderpriority"), F.lit("Nairobi"), phrase, F.lit("Easy apply"))
    return table(spark, folder, "orders").select(
        k.alias("k"), dates.posted_relative(card, DAY).alias("posted_date")
    )


_MDY_SQL = f"({R.sql_pick(rules.MONTHS, 'o_orderkey')} || ' ' || (o_orderkey // 12 % 33) || ', ' || (1999 + o_orderkey % 4))"
_MDY_DATE = S.made("(1999 + k % 4)", "k % 12 + 1", "(k // 12 % 33)::VARCHAR")


@query(
    "posted_mdy",
    f"""WITH t AS (SELECT o_orderkey AS k FROM orders)
    SELECT k, CASE WHEN k % 5 < 3 AND k % 5 <> 1 THEN {_MDY_DATE} END AS word_end,
      CASE WHEN k % 5 < 3 THEN {_MDY_DATE} END AS glued FROM t""",
)
def posted_mdy(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col(K)
    date = F.concat(
        R.pick(rules.MONTHS, k), F.lit(" "), F.floor(k / 12).cast("long") % 33, F.lit(", "), 1999 + k % 4
    )
    card = (
        F.when(k % 5 == 0, F.concat(F.lit("Published "), date, F.lit(" by staff")))
        .when(k % 5 == 1, F.concat(date, date))
        .when(k % 5 == 2, date)
        .when(k % 5 == 3, F.lower(date))
        .otherwise(F.lit("no date"))
    )
    cards = table(spark, folder, "orders").select(k.alias("k"), card.alias("card"))
    return cards.select(
        "k",
        dates.posted_month_day_year(F.col("card")).alias("word_end"),
        dates.posted_month_day_year(F.col("card"), word_end=False).alias("glued"),
    )


@query(
    "posted_url_iso",
    f"""WITH t AS (SELECT o_orderkey AS k FROM orders)
    SELECT k, CASE WHEN k % 3 <> 2 THEN {S.made('(1999 + k % 4)', 'k % 14', "(k % 33)::VARCHAR")} END AS from_permalink,
      CASE WHEN k % 4 <> 3 THEN {S.made('(1999 + k % 4)', 'k % 14', "(k % 33)::VARCHAR")} END AS from_iso
    FROM t""",
)
def posted_url_iso(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col(K)
    y, m, d = 1999 + k % 4, F.lpad((k % 14).cast("string"), 2, "0"), F.lpad((k % 33).cast("string"), 2, "0")
    path = F.concat_ws("/", F.lit("https://x.example"), y, m, d, F.lit("slug"))
    href = (
        F.when(k % 3 == 0, F.concat(path, F.lit("/")))
        .when(k % 3 == 1, path)
        .otherwise(F.concat(path, F.lit("/page/2")))
    )
    iso = F.concat(
        F.concat_ws("-", y, m, d),
        R.pick(("", "T23:30:00+03:00", "T01:00:00Z", " at noon"), k),
    )
    return table(spark, folder, "orders").select(
        k.alias("k"),
        dates.posted_from_permalink(href).alias("from_permalink"),
        dates.posted_from_iso(iso).alias("from_iso"),
    )


def _scored_query(columns: str) -> str:
    return f"WITH {R.POSTINGS_SQL}, {S.SCORED_SQL} SELECT {columns} FROM scored"


def _found(spark: SparkSession, folder: str) -> DataFrame:
    located = scoring.with_eligibility(R.postings(spark, folder))
    return scoring.with_matches(located, DAY, rules.DEFAULT_PROFILE)


@query("employment_type", _scored_query("k, employment, pts_employment"))
def employment_type(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.with_points(_found(spark, folder)).select("k", "employment", "pts_employment")


@query(
    "freshness",
    f"""WITH {R.POSTINGS_SQL}, a AS (SELECT k, {S._AGE} AS age_days FROM postings)
    SELECT k, age_days::INT AS age_days, (CASE WHEN age_days IS NULL THEN 2 WHEN age_days <= 14 THEN 5
      WHEN age_days <= 30 THEN 3 ELSE 0 END)::INT AS points,
      CASE WHEN age_days IS NULL THEN 'Posting date unknown' WHEN age_days <= 14 THEN 'Posted ' || age_days || 'd ago — fresh'
        WHEN age_days <= 30 THEN 'Posted ' || age_days || 'd ago' ELSE 'Posted ' || age_days || 'd ago — stale' END AS reason
    FROM a""",
)
def freshness(spark: SparkSession, folder: str) -> DataFrame:
    aged = R.postings(spark, folder).select(
        "k", dates.age_days(F.col("posted_date"), DAY).alias("age_days")
    )
    return aged.select(
        "k",
        "age_days",
        dates.freshness_points(F.col("age_days")).alias("points"),
        dates.freshness_reason(F.col("age_days")).alias("reason"),
    )


@query(
    "zone_rank",
    f"""WITH {R.POSTINGS_SQL} SELECT k, {S.zone_rank('location', 'title')} AS zone_rank,
      least(coalesce({S.zone('location')}, 9), coalesce({S.zone('title')}, 9))::INT AS nearest
    FROM postings""",
)
def zone_rank(spark: SparkSession, folder: str) -> DataFrame:
    return R.postings(spark, folder).select(
        "k",
        places.zone_rank(F.col("location"), F.col("title")).alias("zone_rank"),
        places.nearest_zone(F.col("location"), F.col("title")).alias("nearest"),
    )


@query(
    "match_terms",
    f"""WITH {R.POSTINGS_SQL}, {S.LOCATED_SQL}
    SELECT k, array_to_string({S.matched('title_n', S.P.titles)}, '; ') AS titles,
      array_to_string({S.matched('search_text', S.P.locations)}, '; ') AS places,
      array_to_string({S.matched('search_text', S.P.negatives)}, '; ') AS negatives FROM located""",
)
def match_terms(spark: SparkSession, folder: str) -> DataFrame:
    texts = scoring.with_texts(R.postings(spark, folder))
    profile = rules.DEFAULT_PROFILE
    title, search = F.col("title_n"), F.col("search_text")
    return texts.select(
        "k",
        text.join_parts(text.matched_terms(title, profile.titles)).alias("titles"),
        text.join_parts(text.matched_terms(search, profile.locations)).alias("places"),
        text.join_parts(text.matched_terms(search, profile.negatives)).alias("negatives"),
    )


@query("match_skills", _scored_query("k, array_to_string(skills, '; ') AS skills, len(skills)::INT AS n_skills"))
def match_skills(spark: SparkSession, folder: str) -> DataFrame:
    texts = scoring.with_texts(R.postings(spark, folder)).select("k", "search_text")
    found = texts.withColumn(
        "hits", text.matched_words(F.col("search_text"), rules.DEFAULT_PROFILE.skills)
    )
    return found.select(
        "k", text.join_parts(F.col("hits")).alias("skills"), F.size("hits").alias("n_skills")
    )


@query(
    "html_escape",
    """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'),
      '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM pages""",
)
def html_escape(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "page_id", text.html_escape(F.col("html")).alias("escaped")
    )


@query(
    "date_buckets",
    f"""WITH {R.POSTINGS_SQL}
    SELECT CASE WHEN posted_date IS NULL THEN 'unknown' WHEN posted_date >= {R.SQL_DAY} THEN 'today'
      WHEN posted_date = {R.SQL_DAY} - 1 THEN 'yesterday'
      WHEN posted_date >= date_trunc('week', {R.SQL_DAY}) THEN 'this week'
      WHEN posted_date >= date_trunc('month', {R.SQL_DAY}) THEN 'earlier this month'
      ELSE strftime(posted_date, '%Y-%m') END AS bucket, count(*) AS jobs
    FROM postings GROUP BY 1""",
)
def date_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return reports.by_date_bucket(R.postings(spark, folder), DAY)


@query(
    "looks_remote",
    f"WITH {R.POSTINGS_SQL} SELECT k, {S.remote('title', 'location', 'description')} AS remote FROM postings",
)
def looks_remote(spark: SparkSession, folder: str) -> DataFrame:
    return R.postings(spark, folder).select(
        "k",
        places.looks_remote(F.col("title"), F.col("location"), F.col("description")).alias("remote"),
    )


@query(
    "looks_remote_documents",
    f"WITH {R.TEXT_POSTINGS_SQL} SELECT k, {S.remote('title', 'location', 'description')} AS remote FROM postings",
)
def looks_remote_documents(spark: SparkSession, folder: str) -> DataFrame:
    return R.text_postings(spark, folder).select(
        "k",
        places.looks_remote(F.col("title"), F.col("location"), F.col("description")).alias("remote"),
    )


@query(
    "sentences",
    f"""SELECT doc_id, (u.i - 1)::INT AS pos, u.s AS sentence FROM (
      SELECT doc_id, unnest(list_transform({S.sentences(S.benign_free('text'))}, lambda x, i: {{'s': x, 'i': i}})) AS u
      FROM documents)""",
)
def sentences(spark: SparkSession, folder: str) -> DataFrame:
    split = qualification.split_sentences(qualification.strip_benign(F.col("text")))
    return table(spark, folder, "documents").select(
        "doc_id", F.posexplode(split).alias("pos", "sentence")
    )


@query(
    "find_blocker",
    f"""WITH {R.POSTINGS_SQL} SELECT k, {S.blocker(S.benign_free('description'))} AS blocker FROM postings""",
)
def find_blocker(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = R.postings(spark, folder).select(
        "k", qualification.strip_benign(F.col("description")).alias("cleaned")
    )
    return cleaned.select("k", qualification.first_blocker(F.col("cleaned")).alias("blocker"))


@query(
    "find_blocker_documents",
    f"""WITH {R.TEXT_POSTINGS_SQL} SELECT k, {S.blocker(S.benign_free('description'))} AS blocker FROM postings""",
)
def find_blocker_documents(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = R.text_postings(spark, folder).select(
        "k", qualification.strip_benign(F.col("description")).alias("cleaned")
    )
    return cleaned.select("k", qualification.first_blocker(F.col("cleaned")).alias("blocker"))


@query(
    "required_grade",
    f"WITH {R.POSTINGS_SQL} SELECT k, {S.grade('description')} AS grade FROM postings",
)
def required_grade(spark: SparkSession, folder: str) -> DataFrame:
    return R.postings(spark, folder).select(
        "k", qualification.required_grade(F.col("description")).alias("grade")
    )


_PAGE_TEXT = (
    "replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, "
    r"'(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<![a-z][^>]*>', '', 'g'), "
    r"'(?s)</?[A-Za-z][^>]*>', ' ', 'g'), "
    "'&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&amp;', '&')"
)


@query(
    "page_text",
    rf"SELECT page_id, trim(regexp_replace({_PAGE_TEXT}, '[\s\x0b\x{{85}}\x{{a0}}]+', ' ', 'g')) AS text FROM pages",
)
def page_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", markup.block_text(F.col("html")).alias("text"))


@query(
    "url_forms",
    """SELECT page_id, rtrim(split_part(url, '?', 1), '/') || '/' AS tidy,
      'https://host.example' || regexp_extract(url, '^https?://[^/]+(.*)$', 1) AS full_url,
      'https://host.example/' || substr(regexp_extract(url, '^https?://[^/]+(.*)$', 1), 2) AS from_page
    FROM pages""",
)
def url_forms(spark: SparkSession, folder: str) -> DataFrame:
    path = F.regexp_extract("url", "^https?://[^/]+(.*)$", 1)
    return table(spark, folder, "pages").select(
        "page_id",
        links.one_trailing_slash(links.without_query(F.col("url"))).alias("tidy"),
        links.absolute(path, "https://host.example").alias("full_url"),
        links.absolute_or_page(F.substring(path, F.lit(2), F.length(path)), "https://host.example").alias(
            "from_page"
        ),
    )
