"""City strings are stored as ``"Area,City"`` or just ``"City"``.

``real_city`` is the part after the first comma (trimmed), ``area`` the part
before it; a value without a comma is both its own city and its own area.
A three-part value ``a,b,c`` gives city ``b``; ``a,`` gives ``''``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _part(c: str | Column, n: int) -> Column:
    col = _c(c)
    return F.when(
        F.contains(col, F.lit(",")),
        F.trim(F.split_part(col, F.lit(","), F.lit(n))),
    ).otherwise(F.trim(col))


def real_city(c: str | Column) -> Column:
    """City part of an ``Area,City`` string; NULL stays NULL."""
    return _part(c, 2)


def area(c: str | Column) -> Column:
    """Area part of an ``Area,City`` string; NULL stays NULL."""
    return _part(c, 1)
