"""Helpers of the corpus operators: input columns, written intermediates, row keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacansift.session import written as saved
from vacansift.sources.tables import table

__all__ = ["ascii_lower", "place", "saved", "table", "text_or_empty", "thinned", "unused"]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def place(draw: Column) -> Column:
    """Where a row stands in the order that samples are drawn in: by the low bits of its draw (a 64-bit hash), then by the whole draw."""
    return F.struct(F.pmod(draw, F.lit(1 << 30)).alias("low"), draw.alias("draw"))


def thinned(draw: Column, found: int, most: int) -> Column:
    """Whether a row may be among the ``most`` with the first places of ``found`` different draws.

    Passes about twice as many draws, so that what tasks send to the driver for a sample doesn't grow with their number, and enough more that
    a small sample isn't left short by chance. Callers order by ``place``.
    """
    share = min(1.0, (2.0 * most + 50) / max(found, 1))
    return F.pmod(draw, F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each lengthened until no column that is taken has it, whatever the case of its letters."""
    known = {c.lower() for c in taken}
    free = []
    for name in names:
        while name in known:
            name = f"_{name}"
        known.add(name)
        free.append(name)
    return free


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())
