"""HTML as text, with regular expressions over well-formed markup.

Differences from a DOM parser on broken markup (unclosed tags, ``<`` inside
attribute values) are accepted; everything runs as built-in expressions.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacansift.functions.text import collapse_whitespace, contains_any, once, strip_whitespace

_INVISIBLE = r"(?is)<(script|style|template)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<![a-z][^>]*>"
_TAG = r"(?s)</?[A-Za-z][^>]*>"
# All names that end in a semicolon; a map is searched in order, so the usual names are compared before it.
_USUAL = ("amp", "nbsp", "lt", "gt", "quot", "apos")
_NAMES = json.dumps({k[:-1]: v for k, v in sorted(html5.items()) if k.endswith(";")})
_ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def drop_elements(html: Column, names: Sequence[str]) -> Column:
    """Remove elements together with their content."""
    return F.regexp_replace(html, rf"(?is)<({'|'.join(names)})\b[^>]*>.*?</\1\s*>", "")


def drop_invisible(html: Column) -> Column:
    """Remove scripts, styles, templates, comments and doctypes."""
    likely = once(F.lower(html), lambda h: contains_any(h, ("<!", "<script", "<style", "<template")))
    return F.when(likely, F.regexp_replace(html, _INVISIBLE, "")).otherwise(html)


def replace_tags(html: Column, separator: str) -> Column:
    # Callers pass expressions of their own, so the markup is evaluated once.
    return once(html, lambda h: F.when(F.contains(h, F.lit("<")), F.regexp_replace(h, _TAG, separator)).otherwise(h))


def unescape(text: Column) -> Column:
    """Decode character references in one pass, so ``&amp;lt;`` gives ``&lt;``."""
    names = F.from_json(F.lit(_NAMES), "map<string,string>")

    def decoded(piece: Column, name: Column) -> Column:
        is_hex = name.rlike("^#[xX]")
        digits = F.when(is_hex, F.substring(name, 3, 8)).otherwise(
            F.conv(F.substring(name, 2, 8), 10, 16)
        )
        code = F.conv(digits, 16, 10).cast("int")
        in_range = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
        value = F.when(name.startswith("#"), F.when(in_range, char))
        for usual in _USUAL:
            value = value.when(name == usual, html5[f"{usual};"])
        value = value.otherwise(F.try_element_at(names, name))
        rest = F.substring(piece, F.length(name) + F.lit(2), F.length(piece))
        return F.coalesce(F.concat(value, rest), F.concat(F.lit("&"), piece))

    def piece_text(piece: Column) -> Column:
        return once(F.regexp_extract(piece, _ENTITY, 1), lambda name: decoded(piece, name))

    def whole(value: Column) -> Column:
        pieces = F.transform(
            F.split(value, "&"), lambda p, i: F.when(i == 0, p).otherwise(piece_text(p))
        )
        return F.when(F.contains(value, F.lit("&")), F.array_join(pieces, "")).otherwise(value)

    return once(text, whole)


def block_text(html: Column, visible: bool = False) -> Column:
    """Visible text, one space between text nodes, white space collapsed.

    ``visible``: scripts, styles and comments are already gone.
    """
    shown = html if visible else drop_invisible(html)
    return collapse_whitespace(unescape(replace_tags(shown, " ")))


def inline_text(html: Column, visible: bool = False) -> Column:
    """Text of a single element: tags vanish without a gap, ends are stripped."""
    shown = html if visible else drop_invisible(html)
    return strip_whitespace(unescape(replace_tags(shown, "")))
