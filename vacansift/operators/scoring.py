"""Weighted scoring of postings against a candidate profile.

Each stage is one projection whose columns the next stage reads, so a text is
normalised and searched once however many rules use the result.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacansift import rules
from vacansift.functions import dates, places, text

COMPONENTS = (
    "pts_location", "pts_title", "pts_skills", "pts_education", "pts_experience",
    "pts_employment", "pts_freshness",
)


def with_texts(postings: DataFrame) -> DataFrame:
    """Normalised title, location, description and the two search texts."""
    parts = postings.withColumns(
        {
            "title_n": text.normalize_text(F.col("title")),
            "location_n": text.normalize_text(F.col("location")),
            "description_n": text.normalize_text(F.col("description")),
        }
    )
    return parts.withColumns(
        {
            "place_text": F.concat_ws(" ", "location_n", "description_n", "title_n"),
            "search_text": F.concat_ws(" ", "title_n", "location_n", "description_n"),
        }
    )


def with_eligibility(postings: DataFrame) -> DataFrame:
    """Classifier result, remote wording and the eligibility used for scoring."""
    found = with_texts(postings).withColumns(
        {
            "place_rule": places.eligibility_rule(F.col("place_text")),
            "remote_wording": places.looks_remote(
                F.col("title"), F.col("location"), F.col("description"), F.col("description_n")
            ),
        }
    )
    return found.withColumn(
        "scored_rule",
        places.without_bare_africa(F.col("place_rule"), F.col("remote_wording")),
    ).withColumn("eligibility", places.eligibility_of(F.col("scored_rule")))


def is_remote() -> Column:
    """Postings the gate drops (columns of ``with_eligibility``)."""
    return F.col("eligibility").isin(*rules.REMOTE_CODES) | F.col("remote_wording")


def with_matches(
    located: DataFrame, as_of: dt.date | Column, profile: rules.Profile
) -> DataFrame:
    """Every rule outcome the points and the explanations are built from."""
    search = F.col("search_text")
    starter = text.shortest_terms(rules.EXPERIENCE_TERMS)
    education_only = [
        t for t in text.shortest_terms(rules.EDUCATION_TERMS) if t not in starter
    ]
    explicit = F.nullif(text.strip_whitespace(F.col("employment_type")), F.lit(""))
    found = located.withColumns(
        {
            "title_hit": text.contains_any(F.col("title_n"), profile.titles),
            "skills": text.matched_words(search, profile.skills),
            "experience_hit": text.contains_any(search, starter),
            "employment": F.coalesce(
                explicit, text.first_term(search, rules.EMPLOYMENT_TERMS)
            ),
            "age_days": dates.age_days(F.col("posted_date"), as_of),
            "matched_locations": text.matched_terms(search, profile.locations),
            "negatives": text.matched_terms(search, profile.negatives),
        }
    )
    # Every starter term but "no experience necessary" also counts as education.
    assert set(starter) <= set(text.shortest_terms(rules.EDUCATION_TERMS))
    return found.withColumn(
        "education_hit",
        F.col("experience_hit") | text.contains_any(search, education_only),
    ).withColumn(
        "blockers",
        F.when(
            F.col("eligibility") == rules.RESTRICTED,
            F.concat(F.array(places.evidence_of(F.col("scored_rule"))), F.col("negatives")),
        ).otherwise(F.col("negatives")),
    )


def with_points(matched: DataFrame) -> DataFrame:
    def given(condition: Column, points: int) -> Column:
        return F.when(condition, points).otherwise(0)

    accepted = F.col("eligibility").isin(rules.KENYA, rules.AFRICA, rules.WORLDWIDE)
    return matched.withColumns(
        {
            "pts_location": F.when(accepted, rules.WEIGHT_LOCATION)
            .when(F.col("eligibility") == rules.RESTRICTED, 0)
            .otherwise(rules.WEIGHT_LOCATION_UNCLEAR),
            "pts_title": given(F.col("title_hit"), rules.WEIGHT_TITLE),
            "pts_skills": F.least(
                F.size("skills") * rules.POINTS_PER_SKILL, F.lit(rules.WEIGHT_SKILLS)
            ),
            "pts_education": given(F.col("education_hit"), rules.WEIGHT_EDUCATION),
            "pts_experience": given(F.col("experience_hit"), rules.WEIGHT_EXPERIENCE),
            "pts_employment": given(F.col("employment") != "", rules.WEIGHT_EMPLOYMENT_TYPE),
            "pts_freshness": dates.freshness_points(F.col("age_days")),
            "penalty": F.size("blockers") * rules.PENALTY_PER_BLOCKER,
        }
    )


def with_score(pointed: DataFrame) -> DataFrame:
    total = sum((F.col(c) for c in COMPONENTS[1:]), F.col(COMPONENTS[0])) - F.col("penalty")
    scored = pointed.withColumn(
        "score", F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")
    )
    return scored.withColumn("tier", tier_of(F.col("score"), F.col("eligibility")))


def tier_of(score: Column, eligibility: Column) -> Column:
    return (
        F.when(eligibility == rules.RESTRICTED, F.lit("poor"))
        .when(score >= rules.STRONG_FROM, F.lit("strong"))
        .when(score >= rules.CONSIDER_FROM, F.lit("consider"))
        .otherwise(F.lit("poor"))
    )


def with_reasons(scored: DataFrame) -> DataFrame:
    """Ordered explanation list."""
    location = F.when(F.col("eligibility") == rules.RESTRICTED, F.lit(rules.REASON_RESTRICTED))
    for code in (rules.KENYA, rules.AFRICA, rules.WORLDWIDE):
        location = location.when(
            F.col("eligibility") == code, F.lit(rules.ELIGIBILITY_LABELS[code])
        )
    location = location.otherwise(F.lit(rules.REASON_UNCLEAR))
    skills = F.concat(
        F.size("skills").cast("string"),
        F.lit(rules.REASON_SKILLS),
        F.array_join(F.slice("skills", 1, rules.SKILLS_SHOWN), ", "),
    )
    named = F.concat(
        F.lit(rules.REASON_LOCATIONS),
        F.array_join(F.slice("matched_locations", 1, rules.LOCATIONS_SHOWN), ", "),
    )
    lines = F.array(
        location,
        F.when(F.col("title_hit"), F.lit(rules.REASON_TITLE)),
        F.when(F.size("skills") > 0, skills),
        F.when(F.col("education_hit"), F.lit(rules.REASON_EDUCATION)),
        F.when(F.col("experience_hit"), F.lit(rules.REASON_EXPERIENCE)),
        F.when(
            F.col("employment") != "",
            F.concat(F.lit(rules.REASON_EMPLOYMENT), F.col("employment")),
        ),
        dates.freshness_reason(F.col("age_days")),
        F.when(F.size("matched_locations") > 0, named),
        F.concat(F.lit(rules.REASON_ELIGIBILITY), F.col("eligibility")),
    )
    return scored.withColumn("reasons", F.array_compact(lines))


def score_postings(
    postings: DataFrame,
    as_of: dt.date | Column,
    profile: rules.Profile = rules.DEFAULT_PROFILE,
) -> DataFrame:
    """Postings plus score, tier, eligibility, reasons, blockers and components."""
    return score_located(with_eligibility(postings), as_of, profile)


def score_located(
    located: DataFrame,
    as_of: dt.date | Column,
    profile: rules.Profile = rules.DEFAULT_PROFILE,
) -> DataFrame:
    """``score_postings`` of rows that have the columns of ``with_eligibility``."""
    return with_reasons(with_score(with_points(with_matches(located, as_of, profile))))
