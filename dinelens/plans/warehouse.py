"""The named tables of the platform, derived lazily from one data directory.

``Warehouse.from_dir(spark, path)`` maps the driver's Parquet tables to the
raw food-order tables (``sources.fixtures``) and chains staging, marts and
the two gold review tables on top. Every attribute is a lazy DataFrame;
nothing runs until a query's result is consumed, and each query only pulls
the columns (and joins) it needs.

The gold review tables here are what the enrichment jobs would write when
replaying the recorded replies; ``sources.catalog`` writes them for real.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dinelens.operators import insights as ins
from dinelens.operators import marts, reviews, staging
from dinelens.operators.scoring import RecordedReplies, Scorer
from dinelens.sources import fixtures
from dinelens.sources.driver import BaseTables


# What ``jobs.build_warehouse`` writes and ``Warehouse.from_built`` reads.
BUILT_TABLES = (
    "stg_restaurants",
    "stg_orders",
    "mart_orders",
    "mart_city_restaurant_stats",
    "mart_city_order_stats",
    "gold_review_sentiments",
    "gold_restaurant_insights",
)


class Warehouse:
    # Open warehouses of the current session, by directory. Only the lazy
    # DataFrame handles are kept (analysed plans and file listings), never
    # results: every query still runs its whole plan against the files. Those
    # of an earlier session are let go when another one asks.
    _open: dict[str, "Warehouse"] = {}
    _session: SparkSession | None = None

    def __init__(self, spark: SparkSession, base: BaseTables):
        self.spark = spark
        self.base = base
        self._frames: dict[tuple, DataFrame] = {}

    @classmethod
    def from_dir(cls, spark: SparkSession, sf_dir: str) -> "Warehouse":
        return cls(spark, BaseTables(spark, sf_dir))

    @classmethod
    def shared(cls, spark: SparkSession, sf_dir: str) -> "Warehouse":
        """The open warehouse of ``sf_dir`` in this session (built once).

        For read-only inputs, like a dashboard service that keeps its
        table handles; use ``from_dir`` to see new files.
        """
        if cls._session is not spark:
            cls._open, cls._session = {}, spark
        key = sf_dir.rstrip("/")
        if key not in cls._open:
            cls._open[key] = cls.from_dir(spark, sf_dir)
        return cls._open[key]

    @classmethod
    def from_built(cls, spark: SparkSession, sf_dir: str, built_dir: str) -> "Warehouse":
        """Silver and gold tables are scans of what ``jobs.build_warehouse``
        wrote to ``built_dir``; only bronze comes from ``sf_dir``. Dashboard
        queries then read the marts instead of aggregating all orders."""
        w = cls.from_dir(spark, sf_dir)
        for name in BUILT_TABLES:
            w.__dict__[name] = spark.read.parquet(f"{built_dir.rstrip('/')}/{name}")
        w.__dict__["stg_orders"] = w.stg_orders.drop("order_year")
        w.__dict__["orders_for_marts"] = w.stg_orders.select("order_id", "restaurant_id", "order_amount")
        w.__dict__["gold_review_texts"] = w.gold_review_sentiments.select("review_id", "original_text")
        return w

    # bronze ---------------------------------------------------------------
    @cached_property
    def raw_restaurants(self) -> DataFrame:
        return fixtures.raw_restaurants(self.base)

    def raw_orders(self, columns=None) -> DataFrame:
        return self._memo("raw_orders", columns, fixtures.raw_orders)

    def raw_reviews(self, columns=None) -> DataFrame:
        return self._memo("raw_reviews", columns, fixtures.raw_reviews)

    def _memo(self, name: str, columns, build) -> DataFrame:
        """One lazy frame per (table, column list), built on first use."""
        key = (name, tuple(columns) if columns is not None else None)
        df = self._frames.get(key)
        if df is None:
            df = self._frames[key] = build(self.base, columns)
        return df

    @cached_property
    def review_responses(self) -> DataFrame:
        return fixtures.review_responses(self.base)

    @cached_property
    def review_scorer(self) -> Scorer:
        return fixtures.review_replay(self.base)

    @cached_property
    def insight_responses(self) -> DataFrame:
        return fixtures.insight_responses(self.base)

    # silver ---------------------------------------------------------------
    @cached_property
    def stg_restaurants(self) -> DataFrame:
        return staging.stg_restaurants(self.raw_restaurants)

    @cached_property
    def stg_restaurants_typed(self) -> DataFrame:
        return staging.stg_restaurants_typed(fixtures.restaurants_typed_input(self.base))

    @cached_property
    def stg_orders(self) -> DataFrame:
        cols = ["order_id", "r_id", "user_id", "order_date", "order_status", "sales_amount"]
        return staging.stg_orders(self.raw_orders(cols))

    @cached_property
    def orders_for_marts(self) -> DataFrame:
        """``stg_orders`` narrowed to the columns the marts read."""
        return staging.stg_orders(self.raw_orders(["order_id", "r_id", "sales_amount"]))

    # gold -----------------------------------------------------------------
    @cached_property
    def mart_orders(self) -> DataFrame:
        return marts.mart_orders(self.orders_for_marts, self.stg_restaurants)

    @cached_property
    def mart_city_restaurant_stats(self) -> DataFrame:
        return marts.mart_city_restaurant_stats(self.stg_restaurants)

    @cached_property
    def mart_city_order_stats(self) -> DataFrame:
        return marts.mart_city_order_stats(self.orders_for_marts, self.stg_restaurants)

    @cached_property
    def review_enrichment(self) -> DataFrame:
        """E8 over every pending review with the recorded replies."""
        raw = self.raw_reviews(["review_id", "restaurant_id", "comment"])
        return reviews.enrich_reviews(raw, self.review_scorer)

    @cached_property
    def gold_review_sentiments(self) -> DataFrame:
        return reviews.sentiment_rows(self.review_enrichment, with_timestamp=False)

    @cached_property
    def gold_review_texts(self) -> DataFrame:
        """``review_id, original_text`` of every review enrichment sends: the
        gold table's text column, read from the raw reviews (one row per id)
        without going through the reply join."""
        raw = self.raw_reviews(["review_id", "restaurant_id", "comment"])
        return reviews.enrich_candidates(raw).select(
            "review_id", F.col("text").alias("original_text")
        )

    @cached_property
    def insight_build(self) -> DataFrame:
        """E15 over every qualifying restaurant with the recorded replies."""
        raw = self.raw_reviews(["review_id", "restaurant_id", "comment"])
        return ins.insights_build(
            self.stg_restaurants, raw, RecordedReplies(self.insight_responses), max_themes=4
        )

    @cached_property
    def gold_restaurant_insights(self) -> DataFrame:
        return ins.insight_rows(self.insight_build, with_timestamp=False)

    def views(self) -> dict[str, DataFrame]:
        """Tables offered to ad-hoc SQL."""
        return {
            "mart_orders": self.mart_orders,
            "stg_restaurants": self.stg_restaurants,
            "gold_review_sentiments": self.gold_review_sentiments,
            "raw_orders": self.raw_orders(),
        }
