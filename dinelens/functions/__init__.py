"""Column expressions shared by the jobs and queries.

Everything here returns a ``pyspark.sql.Column`` built from built-in
functions, so it stays inside whole-stage codegen.
"""

from dinelens.functions.places import area, real_city
from dinelens.functions.cleaning import (
    clean_cost,
    clean_rating,
    non_blank,
    split_list,
    strip_ws,
)
from dinelens.functions.metrics import aov, rating_bucket, rating_sort_order, ratio
from dinelens.functions.search import rx_search

__all__ = [
    "area",
    "real_city",
    "clean_cost",
    "clean_rating",
    "non_blank",
    "split_list",
    "strip_ws",
    "aov",
    "ratio",
    "rating_bucket",
    "rating_sort_order",
    "rx_search",
]
