"""Time levels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import timeplan
from ..plans.spec import LEVELS

#: Each level's pattern, its zero and the sign behind it in `yyyy-MM-dd HH:mm:ss.SSS`.
FORMATS = ("yyyy", "MM", "dd", "HH", "mm", "ss", "SSS")
ZERO = ("0000", "00", "00", "00", "00", "00", "000")
BETWEEN = ("-", "-", " ", ":", ":", ".")


def levels(ts: Column) -> dict[str, Column]:
    """The seven zero-padded levels of a timestamp."""
    return {n: F.date_format(ts, f) for n, f in zip(LEVELS, FORMATS, strict=True)}


def parsed(text: Column) -> Column:
    """A time text as timestamp: 23 characters with milliseconds, 19 with seconds, all others as a date; null if it isn't one."""
    size = F.length(text)
    return F.when(size == 23, F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSS"))).when(size == 19, F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))).otherwise(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def text_levels(text: Column) -> dict[str, Column]:
    """The levels of a time text: zeros where it is missing or empty, nulls where it can't be read."""
    none = F.coalesce(text, F.lit("")) == ""
    return {n: F.when(none, F.lit(z)).otherwise(c) for (n, c), z in zip(levels(parsed(text)).items(), ZERO, strict=True)}


def under(literal: str, depth: int) -> Column:
    """Whether the levels begin as a time literal does, down to a depth; depth 0 and less holds for all. Equalities, so they are pushed to scans."""
    out = F.lit(True)
    for name, value in zip(LEVELS, timeplan.parts(literal, depth) if depth > 0 else [], strict=False):
        out = out & (F.col(name) == value)
    return out


def rebuilt(columns: dict[str, Column]) -> Column:
    """`yyyy-MM-dd HH:mm:ss.SSS` from levels; absent or null ones are zeros."""
    out = []
    for n, z, sign in zip(LEVELS, ZERO, (*BETWEEN, ""), strict=True):
        out += [F.coalesce(columns[n], F.lit(z)) if n in columns else F.lit(z)] + ([F.lit(sign)] if sign else [])
    return F.concat(*out)
