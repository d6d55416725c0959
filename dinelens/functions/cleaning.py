"""Cleaning rules of the staging layer and text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker of a missing rating and the currency prefix of a
# cost, as they appear in the raw restaurant table.
MISSING_RATING = "--"
COST_PREFIX = "₹ "

# Fixed value: the characters Python's str.strip() removes (str.isspace),
# written as a regex class that Java regex and RE2 both read the same way.
WS_CLASS = (
    r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}"
    r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _cast(col: Column, type_name: str, strict: bool) -> Column:
    return col.cast(type_name) if strict else col.try_cast(type_name)


def clean_rating(c: str | Column, strict: bool = True) -> Column:
    """``'--'`` becomes NULL, anything else is cast to FLOAT.

    ``strict`` keeps the reference behaviour (a non-numeric text fails the
    job, as ANSI casts do); ``strict=False`` turns such text into NULL.
    """
    col = _c(c)
    return F.when(col == F.lit(MISSING_RATING), F.lit(None).cast("float")).otherwise(
        _cast(col, "float", strict)
    )


def clean_cost(c: str | Column, strict: bool = True) -> Column:
    """Remove the ``'₹ '`` prefix and cast to INTEGER."""
    return _cast(F.replace(_c(c), F.lit(COST_PREFIX), F.lit("")), "int", strict)


def strip_ws(c: str | Column) -> Column:
    """Python ``str.strip()``: remove leading and trailing white space."""
    col = F.regexp_replace(_c(c), F.lit("^" + WS_CLASS + "+"), F.lit(""))
    return F.regexp_replace(col, F.lit(WS_CLASS + "+$"), F.lit(""))


def non_blank(c: str | Column) -> Column:
    """SQL-side test ``c IS NOT NULL AND trim(c) != ''`` (spaces only)."""
    col = _c(c)
    return col.isNotNull() & (F.trim(col) != F.lit(""))


def split_list(c: str | Column, sep: str = ",") -> Column:
    """Delimited text to an array of stripped, non-empty items.

    NULL text gives NULL; ``"a,, b "`` gives ``["a", "b"]``.
    """
    parts = F.split(_c(c), F.lit(sep), -1)
    return F.filter(F.transform(parts, strip_ws), lambda x: x != F.lit(""))
