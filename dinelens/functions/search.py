"""Search predicates of the explorer and insight list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rx_search(c: str | Column, pattern: str, literal: bool = False) -> Column:
    """Case-insensitive "contains" test; NULL text never matches.

    By default ``pattern`` is a regular expression (as in the dashboards,
    where a bad pattern is an error). ``literal=True`` matches the text as is.
    Case is folded for all letters, not only ASCII ones.
    """
    col = F.col(c) if isinstance(c, str) else c
    if literal:
        hit = F.contains(F.lower(col), F.lower(F.lit(pattern)))
    else:
        hit = col.rlike("(?iu)" + pattern)
    return F.coalesce(hit, F.lit(False))
