"""Mergeable distinct counts (P5's restaurant count, and any other value per group).

A sketch per group and day is a few kilobytes however many orders the day
had, and sketches of days merge: distinct values of a week, a month or all
time come from the stored sketches, without the orders and without counting a
value twice that occurs on two days. Exact distinct counts can't be added up.

With ``LG_K`` of 12 the standard error is about 1.04 / sqrt(4096) = 1.6 %; counts
of up to a few hundred are nearly exact. NULL values aren't counted; a NULL
group or day is a group or day of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12
STANDARD_ERROR = 1.04 / 2 ** (LG_K / 2)


def daily_sketches(rows: DataFrame, by: Sequence[str], day: str, value: str, lg_k: int = LG_K) -> DataFrame:
    """``by, day, n_rows, sketch``: a sketch of ``value`` per group and day.

    Sketches are built map-side and merged after the shuffle, so a group that
    holds a third of all rows sends one sketch per task and day.
    """
    return rows.groupBy(*by, day).agg(F.count(value).alias("n_rows"), F.hll_sketch_agg(value, lg_k).alias("sketch"))


def merged(sketches: DataFrame, by: Sequence[str | Column], rows: str = "n_rows") -> DataFrame:
    """``by, n_rows, distinct_estimate`` of any coarser groups of stored sketches."""
    union = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.groupBy(*by).agg(F.sum(rows).alias("n_rows"), union.alias("distinct_estimate"))


def within(estimate: Column, exact: Column, errors: float = 4.0) -> Column:
    """Is an estimate within that many standard errors (and one) of the exact count."""
    return F.abs(estimate - exact) <= F.lit(errors * STANDARD_ERROR) * exact + 1
