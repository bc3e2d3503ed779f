"""Scoring and qualification over whole relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacansift.catalog import relations as R
from vacansift.catalog import sql_rules as S
from vacansift.catalog.registry import query
from vacansift.functions.text import join_parts
from vacansift.operators import collect, qualify, scoring
from vacansift.operators.gate import keep
from vacansift.sources import details as detail_pages
from vacansift.sources.tables import table

DAY = R.AS_OF
_POINTS = (
    "pts_location, pts_title, pts_skills, pts_education, pts_experience, pts_employment, "
    "pts_freshness, penalty"
)
_LISTS = (
    "array_to_string(skills, '; ') AS skills, array_to_string(matched_locations, '; ') AS places, "
    "array_to_string(blockers, '; ') AS blockers, array_to_string(reasons, '; ') AS reasons"
)


def _sql(columns: str, relation: str = R.POSTINGS_SQL, tail: str = "") -> str:
    return f"WITH {relation}, {S.SCORED_SQL} SELECT {columns} FROM scored {tail}"


def _scored(postings: DataFrame) -> DataFrame:
    return scoring.score_postings(postings, DAY)


@query("score_components", _sql(f"k, {_POINTS}, score"))
def score_components(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(R.postings(spark, folder)).select(
        "k", *scoring.COMPONENTS, "penalty", "score"
    )


@query(
    "score_posting",
    _sql("k, score, tier, eligibility, len(blockers)::INT AS n_blockers, len(skills)::INT AS n_skills"),
)
def score_posting(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(R.postings(spark, folder)).select(
        "k", "score", "tier", "eligibility",
        F.size("blockers").alias("n_blockers"), F.size("skills").alias("n_skills"),
    )


@query("score_documents", _sql("k, score, tier, eligibility", R.TEXT_POSTINGS_SQL))
def score_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(R.text_postings(spark, folder)).select("k", "score", "tier", "eligibility")


@query("score_reasons", _sql(f"k, {_LISTS}"))
def score_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(R.postings(spark, folder)).select(
        "k",
        join_parts(F.col("skills")).alias("skills"),
        join_parts(F.col("matched_locations")).alias("places"),
        join_parts(F.col("blockers")).alias("blockers"),
        join_parts(F.col("reasons")).alias("reasons"),
    )


_GATE = "source_url <> '' AND eligibility NOT IN ('REMOTE-AFRICA', 'REMOTE-WORLDWIDE', 'REMOTE-RESTRICTED') AND NOT remote_wording"


@query(
    "tier_summary",
    _sql(
        "tier, eligibility, count(*) AS postings, round(avg(score), 4) AS avg_score, "
        "min(score) AS min_score, max(score) AS max_score",
        tail=f"WHERE {_GATE} GROUP BY tier, eligibility",
    ),
)
def tier_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: score all postings, drop remote ones, summarise by tier."""
    listed = R.postings(spark, folder).where(collect.known_url())
    scored = _scored(listed).select("tier", "eligibility", "score", "remote_wording")
    return (
        keep(scored, ~scoring.is_remote())
        .groupBy("tier", "eligibility")
        .agg(
            F.count(F.lit(1)).alias("postings"),
            F.round(F.avg("score"), 4).alias("avg_score"),
            F.min("score").alias("min_score"),
            F.max("score").alias("max_score"),
        )
    )


@query("remote_gate", f"WITH {R.POSTINGS_SQL}, {S.LOCATED_SQL} SELECT k, eligibility FROM located WHERE {_GATE}")
def remote_gate(spark: SparkSession, folder: str) -> DataFrame:
    listed = R.postings(spark, folder).where(collect.known_url())
    located = scoring.with_eligibility(listed).select("k", "eligibility", "remote_wording")
    return keep(located, ~scoring.is_remote()).select("k", "eligibility")


_BARE = "bare AS (SELECT *, NULL::VARCHAR AS body, NULL::VARCHAR[] AS qualifications, NULL::VARCHAR AS experience FROM postings)"
_VERDICT = (
    "k, ok, level, reject_reason, array_to_string(verdict_reasons, '; ') AS reasons, "
    "CASE WHEN level = 'confirmed' THEN 70 ELSE 55 END::INT AS school_score"
)


def _bare(postings: DataFrame) -> DataFrame:
    empty = F.lit(None)
    return postings.withColumns(
        {
            "body": empty.cast("string"),
            "qualifications": empty.cast("array<string>"),
            "experience": empty.cast("string"),
        }
    )


def _verdict(evaluated: DataFrame) -> DataFrame:
    from vacansift.functions.qualification import qualification_score

    return evaluated.select(
        "k", "ok", "level", "reject_reason",
        join_parts(F.col("verdict_reasons")).alias("reasons"),
        qualification_score(F.col("level")).alias("school_score"),
    )


@query("qualify", f"WITH {R.POSTINGS_SQL}, {_BARE}, {S.judged('bare')} SELECT {_VERDICT} FROM judged")
def qualify_postings(spark: SparkSession, folder: str) -> DataFrame:
    return _verdict(qualify.evaluate(_bare(R.postings(spark, folder))))


@query(
    "qualify_documents",
    f"WITH {R.TEXT_POSTINGS_SQL}, {_BARE}, {S.judged('bare')} SELECT {_VERDICT} FROM judged",
)
def qualify_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _verdict(qualify.evaluate(_bare(R.text_postings(spark, folder))))


_TAGS = (
    "[['Diploma', 'KCSE'], ['KCSE'], ['First School Leaving Certificate'], ['Others'], "
    "['MBA/MSc/MA', 'Vocational']][(o_orderkey + o_custkey) % 5 + 1]"
)
DETAILS_SQL = f"""details AS (
  SELECT 'https://jobs.example/job/' || o_orderkey AS source_url,
    CASE WHEN o_orderkey % 35 = 0 THEN '' ELSE trim(regexp_replace('Basic math skills & care. ' ||
      {R.sql_pick(R.REQUIREMENTS, 'o_orderkey * 3 + o_custkey')} || ' ' ||
      {R.sql_pick(R.ENDINGS, 'o_orderkey * 9 + o_custkey')}, '\\s+', ' ', 'g')) END AS body,
    CASE WHEN o_orderkey % 35 = 0 THEN [] ELSE {_TAGS} END AS qualifications,
    CASE WHEN o_orderkey % 35 = 0 THEN '' ELSE (o_orderkey % 4) || ' year' END AS experience
  FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 4 <> 0)"""
ALL_DETAILS_SQL = DETAILS_SQL.replace(" WHERE o_orderkey % 5 = 0 AND o_orderkey % 4 <> 0", "")


@query(
    "detail_segments",
    f"""WITH {ALL_DETAILS_SQL} SELECT source_url, body, array_to_string(qualifications, '; ') AS qualifications,
      experience FROM details""",
)
def detail_segments(spark: SparkSession, folder: str) -> DataFrame:
    pages = R.detail_pages(table(spark, folder, "orders"))
    return detail_pages.parse(pages).select(
        "source_url", "body", join_parts(F.col("qualifications")).alias("qualifications"), "experience"
    )


ENRICHED_SQL = f"""withpages AS (
  SELECT p.*, d.body, d.qualifications, d.experience FROM
    (SELECT * FROM postings WHERE category_hint = 'FORM4' AND source_url <> '') p
    LEFT JOIN details d USING (source_url)),
{S.judged('withpages')}"""


@query(
    "qualify_enrich",
    f"""WITH {R.POSTINGS_SQL}, {DETAILS_SQL}, {ENRICHED_SQL}
    SELECT k, level, coalesce(nullif(body, ''), description) AS description,
      coalesce(deadline_date, {S.deadline("nullif(body, '')")}) AS deadline_date,
      CASE WHEN level = 'confirmed' THEN 70 ELSE 55 END::INT AS score, 'consider' AS tier,
      array_to_string(verdict_reasons, '; ') AS reasons
    FROM judged WHERE ok""",
)
def qualify_enrich(spark: SparkSession, folder: str) -> DataFrame:
    school = R.postings(spark, folder).where(
        (F.col("category_hint") == "FORM4") & collect.known_url()
    )
    pages = detail_pages.parse(R.details(spark, folder))
    evaluated = qualify.evaluate(qualify.with_details(school, pages)).select(
        "k", "description", "deadline_date", "body", "level", "verdict_reasons", "ok"
    )
    return qualify.enrich(keep(evaluated, F.col("ok"))).select(
        "k", "level", "description", "deadline_date", "score", "tier",
        join_parts(F.col("reasons")).alias("reasons"),
    )
