"""Text helpers: every function takes and returns Columns and stays in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unicode-aware classes (NBSP and the separator controls count as white space).
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def literal_list(values: Sequence[str]) -> Column:
    """A constant array of strings (folded at planning time)."""
    return F.split(F.lit("\x1f".join(values)), "\x1f")


def any_of(conditions: Iterable[Column]) -> Column:
    """OR of all conditions; false when there is none."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """True when one of the terms occurs as a substring.

    Terms that contain another listed term cannot change the answer, so only
    the shortest ones are scanned for.
    """
    return any_of(F.contains(text, F.lit(t)) for t in shortest_terms(terms))


def shortest_terms(terms: Iterable[str]) -> list[str]:
    kept: list[str] = []
    for term in sorted(dict.fromkeys(terms), key=len):
        if not any(other in term for other in kept):
            kept.append(term)
    return kept


def case_folded(text: Column) -> Column:
    """Lower case in which every character that a case-insensitive pattern takes for an ASCII letter is that letter."""
    odd = F.lower(F.translate(text, "\u017f\u212a\u0130\u0131", "skii"))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(odd)


def matches(
    text: Column, pattern: str, anchors: Sequence[str] = (), lowered: Column | None = None
) -> Column:
    """Case-insensitive, Unicode-aware regex test.

    ``anchors`` are lower-case words of which every match contains one: a byte
    search for them skips the regex engine on most texts. Pass ``lowered``, the
    text in lower case, where it already is a column.
    """
    test = F.coalesce(text.rlike(f"(?iU){pattern}"), F.lit(False))
    if not anchors:
        return test
    if lowered is None:
        likely = once(F.lower(text), lambda t: contains_any(t, anchors))
    else:
        likely = contains_any(lowered, anchors)
    return F.coalesce(likely, F.lit(False)) & test


def collapse_whitespace(text: Column) -> Column:
    # Unicode classes are slow; most texts are printable ASCII with single spaces and only need a look at each character.
    def collapsed(value: Column) -> Column:
        uneven = F.contains(value, F.lit("  ")) | value.rlike("[^ -~]")
        return F.when(uneven, F.regexp_replace(value, WHITESPACE, " ")).otherwise(value)

    return F.trim(once(text, collapsed))


def normalize_text(text: Column) -> Column:
    """Lower case, white space runs become one space, NULL becomes ''."""
    return collapse_whitespace(F.lower(F.coalesce(text, F.lit(""))))


def strip_whitespace(text: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    # Between two printable ASCII characters there is nothing to remove, and the pattern would try every run of white space.
    def stripped(value: Column) -> Column:
        bare = F.left(value, F.lit(1)).between("!", "~") & F.right(value, F.lit(1)).between("!", "~")
        return F.when(bare, value).otherwise(F.regexp_replace(value, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))

    return once(text, stripped)


def clean_text(value: Column, data_type: T.DataType) -> Column:
    """Flatten a scalar, array, map or struct to text (NULL becomes '')."""
    if isinstance(data_type, T.ArrayType):
        parts = F.transform(value, lambda x: clean_text(x, data_type.elementType))
        return F.coalesce(F.array_join(parts, ", "), F.lit(""))
    if isinstance(data_type, T.MapType):
        parts = F.transform(
            F.map_values(value), lambda x: clean_text(x, data_type.valueType)
        )
        return F.coalesce(F.array_join(parts, " "), F.lit(""))
    if isinstance(data_type, T.StructType):
        parts = [clean_text(value[f.name], f.dataType) for f in data_type.fields]
        return F.when(value.isNull(), F.lit("")).otherwise(F.concat_ws(" ", *parts))
    if isinstance(data_type, T.BooleanType):
        word = F.when(value, F.lit("True")).when(~value, F.lit("False"))
        return F.coalesce(word, F.lit(""))
    return F.coalesce(value.cast("string"), F.lit(""))


def matched_terms(text: Column, terms: Sequence[str]) -> Column:
    """Listed terms that occur as substrings, in list order."""
    if not terms:
        return F.array().cast("array<string>")
    return F.filter(literal_list(terms), lambda term: F.contains(text, term))


def matched_words(text: Column, terms: Sequence[str]) -> Column:
    """Listed terms that occur as whole words, in list order."""
    hits = []
    for term in terms:
        whole_word = rf"(?U)\b{re.escape(term)}\b"
        found = F.contains(text, F.lit(term)) & text.rlike(whole_word)
        hits.append(F.when(found, F.lit(term)))
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def first_term(text: Column, terms: Sequence[str]) -> Column:
    """First listed term that occurs, else ''."""
    branches = [F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in terms]
    return F.coalesce(*branches, F.lit(""))


def split_title_company(
    heading: Column, separator: str, last: bool
) -> tuple[Column, Column]:
    """Split a heading at the first or last separator into (title, company)."""
    found = F.contains(heading, F.lit(separator))
    gap = len(separator)
    if last:
        company = F.substring_index(heading, separator, -1)
        title = F.left(heading, F.length(heading) - F.length(company) - gap)
    else:
        title = F.substring_index(heading, separator, 1)
        company = F.substring(heading, F.length(title) + gap + 1, F.length(heading))
    title = F.when(found, title).otherwise(heading)
    company = F.when(found, company).otherwise(F.lit(""))
    return (
        or_default(strip_whitespace(title), "Untitled"),
        or_default(strip_whitespace(company), "Unknown"),
    )


def or_default(text: Column, default: str) -> Column:
    """The text, or the default when it is NULL or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def html_escape(text: Column) -> Column:
    # The five characters that are special in HTML.
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def join_parts(parts: Column) -> Column:
    return F.array_join(parts, "; ")
