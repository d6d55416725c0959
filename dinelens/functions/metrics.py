"""Business metrics written as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """``num / NULLIF(den, 0)``: NULL instead of a division by zero."""
    return _c(num) / F.nullif(_c(den), F.lit(0))


def aov(revenue: str | Column, orders: str | Column, digits: int = 2) -> Column:
    """Average order value ``ROUND(revenue / NULLIF(orders, 0), 2)``."""
    return F.round(ratio(revenue, orders), digits)


# Rating buckets, upper bounds exclusive, in display order.
RATING_BUCKETS = [
    (2.0, "< 2.0"),
    (3.0, "2.0 - 3.0"),
    (4.0, "3.0 - 4.0"),
    (4.5, "4.0 - 4.5"),
    (None, "4.5+"),
]


def rating_bucket(c: str | Column) -> Column:
    col = _c(c)
    expr = None
    for bound, label in RATING_BUCKETS:
        if bound is None:
            return expr.otherwise(F.lit(label))
        cond = col < F.lit(bound)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def rating_sort_order(c: str | Column) -> Column:
    col = _c(c)
    expr = None
    for i, (bound, _) in enumerate(RATING_BUCKETS):
        if bound is None:
            return expr.otherwise(F.lit(i))
        cond = col < F.lit(bound)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr
