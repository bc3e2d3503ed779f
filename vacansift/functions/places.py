"""Where a posting is: eligibility, remote wording and distance zones."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacansift import rules
from vacansift.functions.text import contains_any, matches


def eligibility_rule(text: Column) -> Column:
    """Name of the first geographic rule that applies to a normalised text.

    The value is an eligibility code, ``RESTRICTED:<region>``, or
    ``UNKNOWN:remote`` / ``UNKNOWN`` when nothing places the posting.
    """
    rule = (
        F.when(contains_any(text, rules.KENYA_TERMS), F.lit(rules.KENYA))
        .when(contains_any(text, rules.AFRICA_TERMS), F.lit(rules.AFRICA))
        .when(contains_any(text, rules.WORLDWIDE_TERMS), F.lit(rules.WORLDWIDE))
    )
    for region, terms in rules.RESTRICTED_TERMS.items():
        rule = rule.when(contains_any(text, terms), F.lit(f"RESTRICTED:{region}"))
    rule = rule.when(F.contains(text, F.lit("remote")), F.lit("UNKNOWN:remote"))
    return rule.otherwise(F.lit(rules.UNKNOWN))


def eligibility_of(rule: Column) -> Column:
    return (
        F.when(rule.startswith("RESTRICTED:"), F.lit(rules.RESTRICTED))
        .when(rule.startswith("UNKNOWN"), F.lit(rules.UNKNOWN))
        .otherwise(rule)
    )


def evidence_of(rule: Column) -> Column:
    text = F.when(
        rule.startswith("RESTRICTED:"),
        F.concat(F.lit(rules.EVIDENCE_RESTRICTED), F.substring_index(rule, ":", -1)),
    )
    for code, sentence in rules.EVIDENCE.items():
        text = text.when(rule == code, F.lit(sentence))
    text = text.when(rule == "UNKNOWN:remote", F.lit(rules.EVIDENCE_REMOTE_UNCLEAR))
    return text.otherwise(F.lit(rules.EVIDENCE_NONE))


def without_bare_africa(rule: Column, remote: Column) -> Column:
    """A mention of Africa counts only when the posting also reads as remote."""
    return F.when((rule == rules.AFRICA) & ~remote, F.lit(rules.UNKNOWN)).otherwise(rule)


def looks_remote(
    title: Column, location: Column, description: Column, lowered: Column | None = None
) -> Column:
    """Remote wording in title or location, or an unmistakable phrase in the text.

    ``lowered``: the description in lower case, where it already is a column.
    """
    headline = F.concat(
        F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(location, F.lit(""))
    )
    body = F.coalesce(description, F.lit(""))
    return matches(headline, rules.REMOTE_HEADLINE_PATTERN) | matches(
        body, rules.REMOTE_BODY_PATTERN, ("remote", "home", "anywhere"), lowered
    )


def zone_of(text: Column) -> Column:
    """Nearest zone whose towns are named, NULL without one."""
    value = F.coalesce(text, F.lit(""))
    branches = []
    for rank, towns in rules.ZONE_TOWNS.items():
        pattern = r"(?iU)\b(" + "|".join(re.escape(t) for t in towns) + r")\b"
        branches.append(F.when(value.rlike(pattern), F.lit(rank)))
    return F.coalesce(*branches)


def zone_rank(location: Column, title: Column) -> Column:
    """Zone of the location, else of the title, else 9."""
    return F.coalesce(
        zone_of(location), zone_of(title), F.lit(rules.ZONE_ELSEWHERE)
    ).cast("int")


def nearest_zone(location: Column, title: Column) -> Column:
    """Nearer of the location's and the title's zone (maintenance backfill)."""
    nowhere = F.lit(rules.ZONE_ELSEWHERE)
    return F.least(
        F.coalesce(zone_of(location), nowhere), F.coalesce(zone_of(title), nowhere)
    ).cast("int")


def zone_label(rank: Column) -> Column:
    label = F.lit(None).cast("string")
    for value, text in rules.ZONE_LABELS.items():
        label = F.when(rank == value, F.lit(text)).otherwise(label)
    return label
