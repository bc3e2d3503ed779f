"""Date extraction. Invalid dates become NULL; "today" is always ``as_of``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacansift import rules
from vacansift.functions.text import contains_any, once


def day(as_of: dt.date | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def _parsed(parts: list[Column], layout: str) -> Column:
    # Without a match all parts are empty; a parser that fails costs more than one that succeeds.
    return once(parts[0], lambda first: F.when(first != "", F.try_to_date(F.concat_ws(" ", first, *parts[1:]), layout)))


#: Patterns that begin with a border of words test it at every character; a look at the character first passes over most.
_AT_DIGIT = r"(?=\d)"
AT_AGE = r"(?=[ty\d])"
_AT_MONTH = f"(?=[{''.join(sorted({m[0] for m in rules.MONTHS}))}])"


def _groups(text: Column, pattern: str, count: int = 3) -> list[Column]:
    return [F.regexp_extract(text, pattern, i) for i in range(1, count + 1)]


def deadline_window(text: Column) -> Column:
    """Characters right after the first deadline keyword ('' without one)."""
    window = F.regexp_extract(
        text,
        rf"(?isU)(?=[acd])(?:{rules.DEADLINE_KEYWORD_PATTERN})(.{{0,{rules.DEADLINE_WINDOW}}})",
        1,
    )
    likely = once(F.lower(text), lambda t: contains_any(t, ("deadline", "closing", "apply")))
    return F.when(likely, window).otherwise(F.lit(""))


def date_in_window(window: Column) -> Column:
    """Day-month-year, else month-day-year, else d/m/y; invalid ones fall through."""
    flags = "(?iU)"
    d, m, y = _groups(window, flags + _AT_DIGIT + rules.DAY_MONTH_YEAR_PATTERN)
    m2, d2, y2 = _groups(window, flags + _AT_MONTH + rules.MONTH_DAY_YEAR_PATTERN)
    d3, m3, y3 = _groups(window, "(?U)" + _AT_DIGIT + rules.NUMERIC_DATE_PATTERN)
    return F.when(
        window != "",
        F.coalesce(
            _parsed([d, F.initcap(m), y], "d MMMM yyyy"),
            _parsed([d2, F.initcap(m2), y2], "d MMMM yyyy"),
            _parsed([d3, m3, y3], "d M yyyy"),
        ),
    )


def extract_deadline(text: Column) -> Column:
    return once(deadline_window(text), date_in_window)


def day_month_text(text: Column) -> Column:
    """First "28 August" style date (capitalised month), '' without one."""
    return F.regexp_extract(text, "(?U)" + _AT_DIGIT + rules.DAY_MONTH_PATTERN, 0)


def posted_day_month(text: Column, as_of: dt.date | Column) -> Column:
    """A date without year: this year, or last year when it would be in the future."""
    pattern = rf"(?U)^\s*(\d{{1,2}})\s+({rules.MONTH_ALTERNATIVES})(?!\w)"
    d, m = _groups(text, pattern, 2)
    today = day(as_of)

    def in_year(year: Column) -> Column:
        return _parsed([d, m, F.lpad(year.cast("string"), 4, "0")], "d MMMM yyyy")

    def past(this_year: Column) -> Column:
        return F.when(this_year > today, in_year(F.year(today) - 1)).otherwise(this_year)

    return once(in_year(F.year(today)), past)


def posted_relative(text: Column, as_of: dt.date | Column) -> Column:
    """today / yesterday / N days, weeks (7) or months (30) ago."""
    today = day(as_of)

    def resolved(phrase: Column) -> Column:
        amount = F.regexp_extract(phrase, r"^(\d+)", 1).try_cast("int")
        unit = (
            F.when(F.contains(phrase, F.lit("day")), 1)
            .when(F.contains(phrase, F.lit("week")), 7)
            .when(F.contains(phrase, F.lit("month")), 30)
        )
        return (
            F.when(phrase == "today", today)
            .when(phrase == "yesterday", F.date_sub(today, 1))
            .when(amount.isNotNull(), F.date_sub(today, F.try_multiply(amount, unit)))
        )

    return once(F.lower(F.regexp_extract(text, "(?iU)" + AT_AGE + rules.RELATIVE_DATE_PATTERN, 1)), resolved)


def posted_month_day_year(text: Column, word_end: bool = True) -> Column:
    """First "September 9, 2026" (capitalised month); optionally glued to more text."""
    pattern = "(?U)" + _AT_MONTH + rules.CARD_DATE_PATTERN + (r"\b" if word_end else "")

    def parsed(found: Column) -> Column:
        m, d, y = _groups(found, rules.CARD_DATE_PATTERN)
        return _parsed([d, m, y], "d MMMM yyyy")

    return once(F.regexp_extract(text, pattern, 0), parsed)


def posted_from_permalink(href: Column) -> Column:
    return _parsed(_groups(href, rules.PERMALINK_DATE_PATTERN), "yyyy MM dd")


def posted_from_iso(created: Column) -> Column:
    """Calendar date of an ISO timestamp in the timestamp's own offset."""
    well_formed = created.rlike(
        r"^\d{4}-\d{2}-\d{2}(.\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?)?$"
    )
    return F.when(well_formed, F.try_to_date(F.left(created, F.lit(10)), "yyyy-MM-dd"))


def age_days(posted: Column, as_of: dt.date | Column) -> Column:
    """Whole days since posting, 0 for future dates, NULL when unknown."""
    return F.when(posted.isNotNull(), F.greatest(F.lit(0), F.datediff(day(as_of), posted)))


def freshness_points(age: Column) -> Column:
    return (
        F.when(age.isNull(), rules.WEIGHT_FRESHNESS_UNKNOWN)
        .when(age <= rules.FRESH_DAYS, rules.WEIGHT_FRESHNESS)
        .when(age <= rules.PARTIAL_DAYS, rules.WEIGHT_FRESHNESS_PARTIAL)
        .otherwise(0)
    )


def freshness_reason(age: Column) -> Column:
    ending = (
        F.when(age <= rules.FRESH_DAYS, F.lit("d ago — fresh"))
        .when(age <= rules.PARTIAL_DAYS, F.lit("d ago"))
        .otherwise(F.lit("d ago — stale"))
    )
    text = F.concat(F.lit("Posted "), age.cast("string"), ending)
    return F.coalesce(text, F.lit(rules.REASON_DATE_UNKNOWN))


def date_bucket(posted: Column, as_of: dt.date | Column) -> Column:
    """today, yesterday, this week, earlier this month, else the month."""
    today = day(as_of)
    age = F.datediff(today, posted)
    return (
        F.when(posted.isNull(), F.lit("unknown"))
        .when(age <= 0, F.lit("today"))
        .when(age == 1, F.lit("yesterday"))
        .when(posted >= F.date_trunc("week", today).cast("date"), F.lit("this week"))
        .when(posted >= F.trunc(today, "month"), F.lit("earlier this month"))
        .otherwise(F.date_format(posted, "yyyy-MM"))
    )
