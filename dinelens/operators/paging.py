"""Paging of sorted listings.

A page is ``orderBy(...).offset(start).limit(size)``: Spark plans it as one
``TakeOrderedAndProject`` with an offset, so each task keeps at most
``offset + size`` rows and only one page reaches the driver. Page sizes are
bounded (100 by default), which keeps that per-task heap small; deep pages
cost ``O(offset)`` per task. A reader who goes on from the last row it has seen
asks for ``rows_after`` instead: a filter and a top-k, whatever the depth.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Page:
    page: int = 1
    size: int = 10

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.size


def _as_int(value, default: int) -> int:
    if value is None:
        return default
    try:
        return int(value)
    except (TypeError, ValueError):
        return default


def page_params(page=None, page_size=None, default_size: int = 10, max_size: int = 100) -> Page:
    """Clamp request values: page >= 1; size in 1..max_size; a value that
    is not an integer falls back to the default."""
    p = max(1, _as_int(page, 1))
    raw_size = _as_int(page_size, None) if page_size is not None else default_size
    size = default_size if raw_size is None else max(1, min(max_size, raw_size))
    return Page(p, size)


def clamp(value, low: int, high: int, default: int) -> int:
    """Clamp a top-k parameter; non-integers give ``default``."""
    return max(low, min(high, _as_int(value, default)))


def page_rows(df: DataFrame, order: list[Column], page: Page) -> DataFrame:
    """Rows of one page of ``df`` sorted by ``order`` (a total order)."""
    out = df.orderBy(*order)
    if page.offset:
        out = out.offset(page.offset)
    return out.limit(page.size)


def rows_after(df: DataFrame, order: list[tuple[str, bool]], last: tuple, size: int) -> DataFrame:
    """The ``size`` rows behind ``last`` in an order of ``(column, falling)``
    pairs, NULL last; ``last`` holds the order's values of the last row seen.

    The order must be total, as for ``page_rows``. Each task keeps ``size``
    rows and the first column's bound reaches the scan.
    """
    behind, equal = F.lit(False), F.lit(True)
    for (name, falling), value in zip(order, last, strict=True):
        c = F.col(name)
        if value is not None:
            beyond = (c < F.lit(value)) if falling else (c > F.lit(value))
            behind = behind | (equal & (F.coalesce(beyond, F.lit(True))))
        equal = equal & c.eqNullSafe(F.lit(value))
    by = [F.col(n).desc_nulls_last() if falling else F.col(n).asc_nulls_last() for n, falling in order]
    first, value = order[0], last[0]
    if value is not None:
        c = F.col(first[0])
        df = df.filter((c <= F.lit(value)) | c.isNull() if first[1] else (c >= F.lit(value)) | c.isNull())
    return df.filter(behind).orderBy(*by).limit(size)


def page_info(df: DataFrame, page: Page) -> DataFrame:
    """One row: ``total_count, total_pages, page, page_size``;
    ``total_pages = max(1, ceil(total_count / page_size))``."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("total_count")).select(
        "total_count",
        F.greatest(F.lit(1), F.ceil(F.col("total_count") / F.lit(page.size))).alias("total_pages"),
        F.lit(page.page).alias("page"),
        F.lit(page.size).alias("page_size"),
    )


# Largest cut (rows of narrow columns) that is broadcast explicitly.
MAX_BROADCAST_ROWS = 10_000


def bounded_broadcast(df: DataFrame, max_rows: int | None) -> DataFrame:
    """``broadcast(df)`` when ``df`` is known to hold at most ``max_rows``
    rows (a limit, a page, a top-n) and that bound is small; otherwise
    ``df`` unchanged and the planner picks the join by its estimates."""
    if max_rows is not None and max_rows <= MAX_BROADCAST_ROWS:
        return F.broadcast(df)
    return df


def attach_late(
    cut: DataFrame,
    source: DataFrame,
    key: str,
    columns: list[str],
    order: list[Column],
    n: int,
    output: list[str],
) -> DataFrame:
    """Join wide columns (long texts) to an already cut page.

    ``cut`` holds at most ``n`` rows (a page or a top-k); it is broadcast
    (``bounded_broadcast``) and ``source`` streams: the wide columns are
    read once and never shuffled, only the page's rows keep them. ``key``
    must be unique in ``source`` (the table's primary key).
    """
    wide = source.select(key, *columns)
    small = bounded_broadcast(cut, n)
    return small.join(wide, key).orderBy(*order).limit(n).select(*output)
