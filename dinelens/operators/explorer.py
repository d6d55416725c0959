"""Data explorer: searchable, filterable, paged listings.

All filters are plan nodes placed before the sort, so Catalyst pushes what
it can into the scan and the sort only sees the surviving rows. A listing
is a ``(rows, order)`` pair: ``page_rows`` takes one page of it and
``page_info`` counts it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinelens.functions.metrics import aov
from dinelens.functions.places import real_city
from dinelens.functions.search import rx_search
from dinelens.operators.paging import Page, attach_late, page_info, page_rows
from dinelens.operators.revenue import in_city
from dinelens.operators.text_index import TextIndex


@dataclass(frozen=True)
class LateColumns:
    """Wide columns of a listing that are joined to a page after it is cut:
    ``source`` holds ``key`` (unique) and ``columns``."""

    key: str
    source: DataFrame
    columns: tuple[str, ...]


@dataclass
class Listing:
    rows: DataFrame
    order: list[Column]
    late: LateColumns | None = None

    def page(self, page: Page) -> DataFrame:
        if self.late is None:
            return page_rows(self.rows, self.order, page)
        return self._attach(page_rows(self._narrow(), self.order, page), page.size)

    def info(self, page: Page) -> DataFrame:
        return page_info(self.rows, page)

    def head(self, n: int) -> DataFrame:
        """First ``n`` rows in order (the capped listing of the v1 API)."""
        if self.late is None:
            return self.rows.orderBy(*self.order).limit(n)
        return self._attach(self._narrow().orderBy(*self.order).limit(n), n)

    def _narrow(self) -> DataFrame:
        return self.rows.drop(*self.late.columns)

    def _attach(self, cut: DataFrame, n: int) -> DataFrame:
        late = self.late
        return attach_late(
            cut, late.source, late.key, list(late.columns), self.order, n, self.rows.columns
        )


def _searched(rows: DataFrame, column: str, search: str | None, literal: bool, index: TextIndex | None) -> DataFrame:
    """``rows`` whose ``column`` matches; from ``index`` (over the same rows) if there is one."""
    if not search:
        return rows
    return rows.filter(rx_search(column, search, literal)) if index is None else index.search(search, literal)


def restaurants_listing(
    restaurants: DataFrame,
    search: str | None = None,
    min_rating: float = 0.0,
    city: str | None = None,
    literal: bool = False,
    index: TextIndex | None = None,
) -> Listing:
    """Restaurants by rating (best first).

    ``search`` is a case-insensitive regex on the name; ``min_rating`` is
    applied only when > 0 (so NULL ratings stay at 0) and compared in FLOAT
    like the FLOAT rating column (4.1 >= 4.1 holds).
    """
    r = in_city(_searched(restaurants, "restaurant_name", search, literal, index), city)
    if min_rating and min_rating > 0:
        r = r.filter(F.col("rating") >= F.lit(float(min_rating)).cast("float"))
    rows = r.select("restaurant_name", "city", "rating", "cuisine", "cost_for_two", "restaurant_id")
    order = [
        F.col("rating").desc_nulls_last(),
        F.col("restaurant_name").asc_nulls_last(),
        F.col("city").asc_nulls_last(),
        F.col("restaurant_id").asc_nulls_last(),
    ]
    return Listing(rows, order)


def explore_restaurants(restaurants: DataFrame, page: Page, **filters) -> DataFrame:
    listing = restaurants_listing(restaurants, **filters)
    return listing.page(page).drop("restaurant_id")


def orders_listing(
    mart: DataFrame,
    cities: Sequence[str] | None = None,
    city: str | None = None,
    search: str | None = None,
    min_orders: float = 0,
    min_revenue: float = 0,
    literal: bool = False,
    index: TextIndex | None = None,
) -> Listing:
    """Mart rows with AOV; raw-city list, one real city, name search,
    and minimum orders / revenue (always applied, so NULL revenue drops)."""
    m = _searched(mart, "restaurant_name", search, literal, index)
    if cities:
        m = m.filter(F.col("city").isin(list(cities)))
    m = in_city(m, city)
    m = m.filter(
        (F.col("total_orders") >= F.lit(min_orders)) & (F.col("total_revenue") >= F.lit(min_revenue))
    )
    rows = m.select(
        "restaurant_name",
        "city",
        "total_orders",
        "total_revenue",
        aov("total_revenue", "total_orders").alias("avg_order_value"),
    )
    order = [
        F.col("total_revenue").desc_nulls_last(),
        F.col("restaurant_name").asc_nulls_last(),
        F.col("city").asc_nulls_last(),
    ]
    return Listing(rows, order)


def explore_orders(mart: DataFrame, page: Page, **filters) -> DataFrame:
    return orders_listing(mart, **filters).page(page)


def reviews_listing(
    gold: DataFrame | None,
    raw: DataFrame,
    search: str | None = None,
    literal: bool = False,
    texts: DataFrame | None = None,
    index: TextIndex | None = None,
) -> Listing:
    """D3 (with E3): enriched reviews, else all raw reviews; then the text
    search; pages by id.

    Enriched pages are cut on the narrow columns and the review texts of
    the page's rows joined afterwards, from ``texts`` (``review_id,
    original_text``; by default the gold table itself). The search still
    reads every text, but no text travels through a shuffle or a sort.
    That needs the id to be a key, as ``append_new`` keeps it in the gold
    table. Raw reviews have no key (ids may repeat or be NULL): their pages
    are a plain filter and top-k, ties ordered by text and rating. With an
    ``index`` over the enriched table's texts a search reads the rows that may
    match, and no others.
    """
    order = [F.col("review_id").asc_nulls_last()]
    if gold is not None:
        if search and index is not None:
            gold = index.search(search, literal)
            texts, search = gold, None
        rows = gold.select(
            "review_id",
            F.col("original_text").alias("review"),
            "sentiment",
            "topics",
            "summary",
        )
        if search:
            rows = rows.filter(rx_search("review", search, literal))
        source = (gold if texts is None else texts).select(
            "review_id", F.col("original_text").alias("review")
        )
        return Listing(rows, order, LateColumns("review_id", source, ("review",)))
    rows = reviews_fallback(raw).withColumnRenamed("comment", "review")
    if search:
        rows = rows.filter(rx_search("review", search, literal))
    return Listing(rows, [*order, F.col("review").asc_nulls_last(), F.col("rating").asc_nulls_last()])


def reviews_fallback(raw: DataFrame) -> DataFrame:
    """All raw reviews ``(review_id, comment, rating)``; the caller pages them."""
    return raw.select("review_id", "comment", "rating")


def distinct_cities(mart: DataFrame) -> DataFrame:
    """Distinct raw cities, sorted, NULL dropped."""
    return mart.select("city").filter(F.col("city").isNotNull()).distinct().orderBy("city")


def distinct_real_cities(mart: DataFrame) -> DataFrame:
    """Distinct real cities, sorted, NULL dropped."""
    c = real_city("city")
    return mart.select(c.alias("city")).filter(F.col("city").isNotNull()).distinct().orderBy("city")


def export_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON record; NULL fields kept, dates ISO."""
    record = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    return df.select(record.alias("json"))
