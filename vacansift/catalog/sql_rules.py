"""SQL counterparts of the rule columns, for checking results with DuckDB."""

from __future__ import annotations

import re

from vacansift import rules
from vacansift.catalog.relations import SQL_DAY, sql_list, sql_text

P = rules.DEFAULT_PROFILE


def re2(pattern: str) -> str:
    """A pattern as a SQL literal. Possessive repeats, which only save Java's stack, become plain ones."""
    return sql_text(pattern.replace("*+", "*"))


def has_any(text: str, terms) -> str:
    return f"len(list_filter({sql_list(terms)}, lambda x: contains({text}, x))) > 0"


def matched(text: str, terms) -> str:
    return f"list_filter({sql_list(terms)}, lambda x: contains({text}, x))"


def words(text: str, terms) -> str:
    hits = ", ".join(
        f"CASE WHEN regexp_matches({text}, {sql_text(chr(92) + 'b' + re.escape(t) + chr(92) + 'b')}) "
        f"THEN {sql_text(t)} END"
        for t in terms
    )
    return f"list_filter([{hits}], lambda x: x IS NOT NULL)"


def found(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {re2(pattern)}, 'i')"


def normal(text: str) -> str:
    spaces = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    return f"trim(regexp_replace(lower(coalesce({text}, '')), {re2(spaces)}, ' ', 'g'))"


def place_rule(text: str) -> str:
    cases = [
        (rules.KENYA, rules.KENYA_TERMS),
        (rules.AFRICA, rules.AFRICA_TERMS),
        (rules.WORLDWIDE, rules.WORLDWIDE_TERMS),
        *[(f"RESTRICTED:{r}", t) for r, t in rules.RESTRICTED_TERMS.items()],
        ("UNKNOWN:remote", ("remote",)),
    ]
    whens = " ".join(f"WHEN {has_any(text, t)} THEN {sql_text(c)}" for c, t in cases)
    return f"CASE {whens} ELSE 'UNKNOWN' END"


def eligibility(rule: str) -> str:
    return (
        f"CASE WHEN {rule} LIKE 'RESTRICTED:%' THEN 'REMOTE-RESTRICTED' "
        f"WHEN {rule} LIKE 'UNKNOWN%' THEN 'UNKNOWN' ELSE {rule} END"
    )


def remote(title: str, location: str, description: str) -> str:
    headline = f"coalesce({title}, '') || ' ' || coalesce({location}, '')"
    return (
        f"({found(headline, rules.REMOTE_HEADLINE_PATTERN)} OR "
        f"{found(f'coalesce({description}, {sql_text(str())})', rules.REMOTE_BODY_PATTERN)})"
    )


def zone(text: str) -> str:
    whens = " ".join(
        f"WHEN {found(f'coalesce({text}, {sql_text(str())})', chr(92) + 'b(' + '|'.join(towns) + ')' + chr(92) + 'b')} THEN {rank}"
        for rank, towns in rules.ZONE_TOWNS.items()
    )
    return f"CASE {whens} END"


def zone_rank(location: str, title: str) -> str:
    return f"coalesce({zone(location)}, {zone(title)}, {rules.ZONE_ELSEWHERE})::INT"


LOCATED_SQL = f"""texts AS (
  SELECT *, location_n || ' ' || description_n || ' ' || title_n AS place_text,
    title_n || ' ' || location_n || ' ' || description_n AS search_text
  FROM (SELECT *, {normal('title')} AS title_n, {normal('location')} AS location_n,
    {normal('description')} AS description_n FROM postings)),
ruled AS (
  SELECT *, {place_rule('place_text')} AS place_rule,
    {remote('title', 'location', 'description')} AS remote_wording FROM texts),
located AS (
  SELECT *, {eligibility('scored_rule')} AS eligibility FROM (
    SELECT *, CASE WHEN place_rule = 'REMOTE-AFRICA' AND NOT remote_wording THEN 'UNKNOWN'
      ELSE place_rule END AS scored_rule FROM ruled))"""

_AGE = f"CASE WHEN posted_date IS NOT NULL THEN greatest(0, {SQL_DAY} - posted_date) END"

SCORED_SQL = f"""{LOCATED_SQL},
found AS (
  SELECT *, {matched('title_n', P.titles)} AS titles_hit, {words('search_text', P.skills)} AS skills,
    {has_any('search_text', rules.EDUCATION_TERMS)} AS education_hit,
    {has_any('search_text', rules.EXPERIENCE_TERMS)} AS experience_hit,
    coalesce(nullif(trim(employment_type), ''), {matched('search_text', rules.EMPLOYMENT_TERMS)}[1], '') AS employment,
    {_AGE} AS age_days,
    {matched('search_text', P.locations)} AS matched_locations,
    list_concat(CASE WHEN eligibility = 'REMOTE-RESTRICTED'
        THEN ['Restricted to ' || split_part(scored_rule, ':', 2)] ELSE [] END,
      {matched('search_text', P.negatives)}) AS blockers
  FROM located),
pointed AS (
  SELECT *, (CASE WHEN eligibility IN ('KENYA', 'REMOTE-AFRICA', 'REMOTE-WORLDWIDE') THEN 10
      WHEN eligibility = 'REMOTE-RESTRICTED' THEN 0 ELSE 2 END)::INT AS pts_location,
    (CASE WHEN len(titles_hit) > 0 THEN 30 ELSE 0 END)::INT AS pts_title,
    least(25, 5 * len(skills))::INT AS pts_skills,
    (CASE WHEN education_hit THEN 15 ELSE 0 END)::INT AS pts_education,
    (CASE WHEN experience_hit THEN 10 ELSE 0 END)::INT AS pts_experience,
    (CASE WHEN employment <> '' THEN 5 ELSE 0 END)::INT AS pts_employment,
    (CASE WHEN age_days IS NULL THEN 2 WHEN age_days <= 14 THEN 5 WHEN age_days <= 30 THEN 3
      ELSE 0 END)::INT AS pts_freshness,
    (10 * len(blockers))::INT AS penalty
  FROM found),
scored AS (
  SELECT *, CASE WHEN eligibility = 'REMOTE-RESTRICTED' THEN 'poor' WHEN score >= 75 THEN 'strong'
      WHEN score >= 45 THEN 'consider' ELSE 'poor' END AS tier,
    list_filter([
      CASE eligibility WHEN 'KENYA' THEN '🇰🇪 KENYA ELIGIBLE' WHEN 'REMOTE-AFRICA' THEN '🌍 AFRICA ELIGIBLE'
        WHEN 'REMOTE-WORLDWIDE' THEN '🌍 WORLDWIDE REMOTE'
        WHEN 'REMOTE-RESTRICTED' THEN '⚠️ Geographic restriction detected'
        ELSE '❓ Location eligibility unclear' END,
      CASE WHEN len(titles_hit) > 0 THEN 'Title strongly matches a target ICT role' END,
      CASE WHEN len(skills) > 0 THEN len(skills) || ' relevant skill(s): ' || array_to_string(skills[1:6], ', ') END,
      CASE WHEN education_hit THEN 'Entry-level/diploma-friendly language detected' END,
      CASE WHEN experience_hit THEN 'Experience requirements appear suitable' END,
      CASE WHEN employment <> '' THEN 'Employment type: ' || employment END,
      CASE WHEN age_days IS NULL THEN 'Posting date unknown' WHEN age_days <= 14 THEN 'Posted ' || age_days || 'd ago — fresh'
        WHEN age_days <= 30 THEN 'Posted ' || age_days || 'd ago' ELSE 'Posted ' || age_days || 'd ago — stale' END,
      CASE WHEN len(matched_locations) > 0
        THEN 'Preferred location mentioned: ' || array_to_string(matched_locations[1:4], ', ') END,
      'Eligibility: ' || eligibility], lambda x: x IS NOT NULL) AS reasons
  FROM (SELECT *, greatest(0, least(100, pts_location + pts_title + pts_skills + pts_education
      + pts_experience + pts_employment + pts_freshness - penalty))::INT AS score FROM pointed))"""


# Sentence ends without look-behind: mark them with chr(1), then split.
def sentences(text: str) -> str:
    marked = f"regexp_replace({text}, '([.;:!?])[\\s]+', '\\1' || chr(1), 'g')"
    marked = f"regexp_replace({marked}, '\\n+|•|·|\\s[-–—]\\s', chr(1), 'g')"
    return f"string_split({marked}, chr(1))"


def benign_free(text: str) -> str:
    return f"regexp_replace({text}, {re2('|'.join(rules.BENIGN_PATTERNS))}, ' ', 'gi')"


def blocker(cleaned: str) -> str:
    labels = " ".join(
        f"WHEN {found('s', p)} THEN {sql_text(name)}" for name, p in rules.BLOCKER_PATTERNS
    )
    one = (
        f"CASE WHEN {found('s', rules.SOFT_PATTERN)} THEN NULL "
        f"WHEN {found('s', rules.SCHOOL_PATTERN)} AND {found('s', rules.ALTERNATIVE_PATTERN)} THEN NULL "
        f"{labels} END"
    )
    return f"list_filter(list_transform({sentences(cleaned)}, lambda s: {one}), lambda x: x IS NOT NULL)[1]"


def grade(text: str) -> str:
    """Grade of the strictest mention: RE2 has no look-ahead, so the mention is
    matched with the characters after it and taken apart."""
    mention = (
        r"\b(?:mean\s+grade|grade\s+of|minimum\s+grade|mean\s+of)\s+(?:at\s+least\s+|of\s+)?"
        r"[A-E](?:$|[^A-Za-z].{0,12})"
    )
    letter = (
        "regexp_extract(m, '^(?:mean\\s+grade|grade\\s+of|minimum\\s+grade|mean\\s+of)\\s+"
        "(?:at\\s+least\\s+|of\\s+)?([A-E])(.*)$', {n}, 'i')"
    )
    tail = letter.format(n=2)
    modifier = (
        f"lower(regexp_extract({tail}, '^\\s*(\\+|-|plus|minus|\\(plus\\)|\\(minus\\)|plain|\\(plain\\))', 1, 'i'))"
    )
    following = f"left(ltrim({tail}), 1)"
    sign = (
        f"CASE WHEN {modifier} IN ('+', 'plus', '(plus)') THEN '+' "
        f"WHEN {modifier} IN ('-', 'minus', '(minus)') THEN '-' ELSE '' END"
    )
    rank = (
        f"CASE WHEN lower({letter.format(n=1)}) = {letter.format(n=1)} AND {modifier} = '' "
        f"AND {following} NOT IN ('', ',', '.', ';', ')') THEN NULL "
        f"ELSE list_position({sql_list(rules.GRADES)}, upper({letter.format(n=1)}) || {sign}) END"
    )
    per_sentence = (
        f"list_transform(regexp_extract_all(s, {re2(mention)}, 0, 'i'), lambda m: {rank})"
    )
    wanted = f"list_filter({sentences(text)}, lambda s: {found('s', rules.SCHOOL_PATTERN)})"
    best = f"list_min(list_filter(flatten(list_transform({wanted}, lambda s: {per_sentence})), lambda r: r > 0))"
    return f"{sql_list(rules.GRADES)}[{best}]"


def judged(source: str) -> str:
    """``judged`` and its helpers over a relation with title, description, body,
    qualifications (list) and experience."""
    return f"""ruletext AS (
  SELECT *, coalesce(title, '') || '. ' || coalesce(description, '') || '. ' || coalesce(body, '') AS rule_text
  FROM {source}),
probed AS (
  SELECT *, {found("coalesce(title, '')", rules.ROLE_PATTERN)} AS role_hit,
    {blocker(benign_free('rule_text'))} AS blocker, {grade('rule_text')} AS grade,
    contains(lower(coalesce(array_to_string(qualifications, ' '), '')), 'kcse')
      OR contains(lower(coalesce(array_to_string(qualifications, ' '), '')), 'first school leaving')
      OR {found('rule_text', rules.SCHOOL_PATTERN)} AS confirmed
  FROM ruletext),
refused AS (
  SELECT *, CASE WHEN role_hit THEN 'role normally needs a licence or qualification'
      WHEN blocker IS NOT NULL THEN blocker
      WHEN grade IN ('A', 'A-', 'B+', 'B', 'B-', 'C+') THEN 'KCSE grade ' || grade || ' required' END AS reject_reason
  FROM probed),
judged AS (
  SELECT *, reject_reason IS NULL AS ok,
    CASE WHEN reject_reason IS NULL AND confirmed THEN 'confirmed' ELSE 'likely' END AS level,
    CASE WHEN reject_reason IS NULL THEN list_filter([
      CASE WHEN confirmed THEN '🎓 Form 4 (KCSE) accepted'
        ELSE '🎓 Listed as a KCSE-level job (requirements not spelled out)' END,
      'No extra certificate, diploma or licence asked for',
      'KCSE mean grade ' || grade || ' or similar',
      'Experience: ' || nullif(trim(experience), '')], lambda x: x IS NOT NULL) ELSE [] END AS verdict_reasons
  FROM refused)"""


def window(text: str) -> str:
    return (
        f"regexp_extract({text}, {re2('(?is)(?:' + rules.DEADLINE_KEYWORD_PATTERN + ')(.{0,40})')}, 1)"
    )


def month_number(name: str) -> str:
    return f"list_position({sql_list([m.lower() for m in rules.MONTHS])}, lower({name}))"


def made(y: str, m: str, d: str) -> str:
    return f"try_cast(({y}) || '-' || lpad(({m})::VARCHAR, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"


def _part(text: str, pattern: str, n: int, flags: str = "(?i)") -> str:
    return f"regexp_extract({text}, {re2(flags + pattern)}, {n})"


def deadline(text: str) -> str:
    w = window(text)
    a, b, c = rules.DAY_MONTH_YEAR_PATTERN, rules.MONTH_DAY_YEAR_PATTERN, rules.NUMERIC_DATE_PATTERN
    return (
        f"coalesce({made(_part(w, a, 3), month_number(_part(w, a, 2)), _part(w, a, 1))}, "
        f"{made(_part(w, b, 3), month_number(_part(w, b, 1)), _part(w, b, 2))}, "
        f"{made(_part(w, c, 3), _part(w, c, 2), _part(w, c, 1))})"
    )
