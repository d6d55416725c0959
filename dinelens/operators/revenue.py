"""Revenue, order and trend queries over the marts (Q1-Q20).

Every top-k carries a total tie-break (name and city ascending, NULLs
last), so a k-row answer is the same set in any engine and on any run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dinelens.functions.metrics import aov, rating_bucket, rating_sort_order, ratio
from dinelens.functions.places import area, real_city
from dinelens.operators.paging import Page, clamp, page_rows, rows_after

def _revenue_ties() -> list[Column]:
    return [F.col("restaurant_name").asc_nulls_last(), F.col("city").asc_nulls_last()]


def _by_revenue() -> list[Column]:
    return [F.col("total_revenue").desc_nulls_last(), *_revenue_ties()]


def in_city(df: DataFrame, city: str | None, col: str = "city") -> DataFrame:
    """Keep rows whose real city equals ``city`` (no filter when empty)."""
    city = (city or "").strip()
    return df.filter(real_city(col) == F.lit(city)) if city else df


# --------------------------------------------------------------------- KPIs


def _kpi_frame(mart: DataFrame, restaurants: DataFrame) -> DataFrame:
    """One union of the two inputs so that all KPIs come from one aggregate."""
    m = mart.select(
        F.col("total_revenue").alias("rev"),
        F.col("total_orders").alias("ords"),
        F.lit(None).cast("float").alias("rating"),
        F.lit(False).alias("is_restaurant"),
    )
    r = restaurants.select(
        F.lit(None).cast("double").alias("rev"),
        F.lit(None).cast("bigint").alias("ords"),
        F.col("rating"),
        F.lit(True).alias("is_restaurant"),
    )
    return m.unionByName(r)


def kpis(mart: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Q1: total revenue, total orders, restaurant count, mean rating."""
    return _kpi_frame(mart, restaurants).agg(
        F.coalesce(F.sum("rev"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(F.sum("ords"), F.lit(0).cast("bigint")).alias("total_orders"),
        F.count_if(F.col("is_restaurant")).alias("total_restaurants"),
        F.coalesce(F.round(F.avg("rating"), 2), F.lit(0.0)).alias("avg_rating"),
    )


def kpis_by_scope(mart: DataFrame, restaurants: DataFrame, city: str | None = None) -> DataFrame:
    """Q2: Q1 plus AOV = sum revenue / sum orders, optionally in one real city."""
    frame = _kpi_frame(in_city(mart, city), in_city(restaurants, city))
    return frame.agg(
        F.coalesce(F.sum("rev"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(F.sum("ords"), F.lit(0).cast("bigint")).alias("total_orders"),
        F.coalesce(F.round(ratio(F.sum("rev"), F.sum("ords")), 2), F.lit(0.0)).alias(
            "avg_order_value"
        ),
        F.count_if(F.col("is_restaurant")).alias("total_restaurants"),
        F.coalesce(F.round(F.avg("rating"), 2), F.lit(0.0)).alias("avg_rating"),
    )


# -------------------------------------------------------------- top-k rows


def top_city_rows(mart: DataFrame, k: int = 10) -> DataFrame:
    """Q3: the k mart rows with most revenue, showing city and revenue."""
    return mart.orderBy(*_by_revenue()).limit(k).select("city", "total_revenue")


def top_restaurants(mart: DataFrame, city: str | None = None, limit=10) -> DataFrame:
    """Q4: top-N mart rows by revenue; N clamped to 1..25 (default 10)."""
    n = clamp(limit, 1, 25, 10)
    return (
        in_city(mart, city)
        .orderBy(*_by_revenue())
        .limit(n)
        .select("restaurant_name", "total_revenue")
    )


def revenue_by_city(mart: DataFrame, k: int = 10) -> DataFrame:
    """Q5: revenue per raw city, top k."""
    return (
        mart.groupBy("city")
        .agg(F.sum("total_revenue").alias("rev"))
        .orderBy(F.col("rev").desc_nulls_last(), F.col("city").asc_nulls_last())
        .limit(k)
    )


def revenue_share_top_cities(mart: DataFrame, k: int = 10) -> DataFrame:
    """Q6: share (percent) of each top-k city within the top k.

    The window has no partition key, which is fine here: it runs on the
    k rows that survive the limit, never on the input.
    """
    top = revenue_by_city(mart, k)
    total = F.sum("rev").over(Window.partitionBy())
    return top.select("city", "rev", F.round(F.lit(100.0) * F.col("rev") / total, 4).alias("share_pct"))


def orders_vs_revenue(mart: DataFrame, k: int = 20) -> DataFrame:
    """Q7: mart rows with revenue > 0: city, orders, revenue; top k."""
    return (
        mart.filter(F.col("total_revenue") > 0)
        .orderBy(*_by_revenue())
        .limit(k)
        .select("city", "total_orders", "total_revenue")
    )


def restaurant_detail(mart: DataFrame, k: int = 20) -> DataFrame:
    """Q8: top k with revenue rounded to 2 and AOV."""
    return (
        mart.orderBy(*_by_revenue())
        .limit(k)
        .select(
            "restaurant_name",
            "city",
            "total_orders",
            F.round("total_revenue", 2).alias("revenue"),
            aov("total_revenue", "total_orders").alias("avg_order_value"),
        )
    )


# ------------------------------------------------------------------ trends


def _period_format(period: str) -> str:
    return "yyyy-MM" if period == "monthly" else "yyyy"


def _period_unit(period: str) -> str:
    return "MM" if period == "monthly" else "year"


def trend(
    raw_orders: DataFrame,
    period: str = "monthly",
    newest_first: bool = True,
    limit: int | None = 20,
    city: str | None = None,
    restaurants: DataFrame | None = None,
) -> DataFrame:
    """Q9/Q10/Q11: orders, revenue and mean amount per month or year.

    Rows with a NULL date or amount are left out; amounts are FLOAT. Q9/Q10
    take the newest ``limit`` periods, Q11 all periods oldest first with an
    optional real city of the order row.

    Rows are grouped on the first day of their period (a DATE, cheap to hash)
    and the ``YYYY-MM`` / ``YYYY`` label is formatted on the aggregated rows
    only; the label is a one-to-one function of that day.

    For a city, ``restaurants`` (``id, city``, one row per id) gives the
    cities: orders are summed per restaurant (``r_id``) and period first, so
    a restaurant with a third of all orders is combined before the shuffle
    and the join sees aggregates only. Without it the order rows must carry
    ``restaurant_city``.
    """
    o = raw_orders.filter(F.col("order_date").isNotNull() & F.col("sales_amount").isNotNull())
    amount = F.col("sales_amount").cast("float")
    start = F.trunc(F.col("order_date").cast("date"), _period_unit(period)).alias("period_start")
    n, total = F.count(F.lit(1)).alias("n"), F.sum(amount).alias("amount")
    if city and restaurants is not None:
        places = in_city(restaurants.select(F.col("id").alias("place_id"), "city"), city)
        parts = o.groupBy("r_id", start).agg(n, total)
        parts = parts.join(places, F.col("r_id") == F.col("place_id"))
    else:
        parts = in_city(o, city, "restaurant_city").groupBy(start).agg(n, total)
    orders, revenue = F.sum("n"), F.sum("amount")
    g = parts.groupBy("period_start").agg(
        orders.alias("total_orders"),
        F.round(revenue, 2).alias("total_revenue"),
        F.round(revenue / orders, 2).alias("avg_order_value"),
    )
    order = F.col("period_start").desc() if newest_first else F.col("period_start").asc_nulls_last()
    g = g.orderBy(order)
    if limit:
        g = g.limit(limit)
    return g.select(
        F.date_format("period_start", _period_format(period)).alias("period_label"),
        "total_orders",
        "total_revenue",
        "avg_order_value",
    )


def aov_trend(
    raw_orders: DataFrame,
    period: str = "monthly",
    city: str | None = None,
    restaurants: DataFrame | None = None,
) -> DataFrame:
    """Q12: AOV over time, the Q11 data."""
    return trend(raw_orders, period, newest_first=False, limit=None, city=city, restaurants=restaurants).select(
        "period_label", "avg_order_value"
    )


def trend_summary(trend_rows: DataFrame) -> DataFrame:
    """Q13: over the shown rows: revenue, orders, unweighted mean AOV.

    0 when there are no rows. Sums of rounded values are rounded again, so
    the last bits do not depend on the order of addition.
    """
    return trend_rows.agg(
        F.coalesce(F.round(F.sum("total_revenue"), 2), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(F.sum("total_orders"), F.lit(0).cast("bigint")).alias("total_orders"),
        F.coalesce(F.round(F.avg("avg_order_value"), 2), F.lit(0.0)).alias("avg_order_value"),
    )


# ----------------------------------------------------------- listings/ranks

SORT_COLUMNS_ALL_TIME = {"revenue": "total_revenue", "orders": "total_orders", "city": "city"}
SORT_COLUMNS_TABLE = {"revenue": "total_revenue", "orders": "total_orders", "name": "restaurant_name"}


def _desc_with_ties(sort_col: str) -> list[Column]:
    ties = [c for c in ("restaurant_name", "city") if c != sort_col]
    return [F.col(sort_col).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]]


def _performance_columns(mart: DataFrame) -> DataFrame:
    return mart.select(
        "restaurant_name",
        "city",
        "total_orders",
        "total_revenue",
        aov("total_revenue", "total_orders").alias("avg_order_value"),
    )


PERFORMANCE_ORDER = [("total_revenue", True), ("restaurant_name", False), ("city", False)]


def performance_after(mart: DataFrame, last: tuple, size: int = 10) -> DataFrame:
    """Q20 for a reader who goes on behind the row ``last`` (revenue, name, city)."""
    return rows_after(_performance_columns(mart), PERFORMANCE_ORDER, last, size)


def restaurants_filtered(
    mart: DataFrame, min_revenue: float = 0, sort: str = "revenue", limit=20
) -> DataFrame:
    """Q14: mart rows with revenue >= min, with AOV; sorted DESC by revenue,
    orders or city (whitelist); limit clamped to 1..500."""
    sort_col = SORT_COLUMNS_ALL_TIME.get(sort, "total_revenue")
    n = clamp(limit, 1, 500, 20)
    rows = mart.filter(F.col("total_revenue") >= F.lit(min_revenue))
    return _performance_columns(rows).orderBy(*_desc_with_ties(sort_col)).limit(n)


def _by_real_city(mart: DataFrame) -> DataFrame:
    return mart.groupBy(real_city("city").alias("city")).agg(
        F.sum("total_revenue").alias("revenue"),
        F.sum("total_orders").alias("orders"),
        F.count(F.lit(1)).alias("restaurant_count"),
    )


def cities_ranked(mart: DataFrame) -> DataFrame:
    """Q15: per real city: revenue, orders, number of mart rows."""
    return _by_real_city(mart).orderBy(
        F.col("revenue").desc_nulls_last(), F.col("city").asc_nulls_last()
    )


def breakdown_city(mart: DataFrame, k: int = 15) -> DataFrame:
    """Q16: top k real cities by revenue."""
    return (
        mart.groupBy(real_city("city").alias("label"))
        .agg(F.sum("total_revenue").alias("revenue"), F.sum("total_orders").alias("orders"))
        .orderBy(F.col("revenue").desc_nulls_last(), F.col("label").asc_nulls_last())
        .limit(k)
    )


def breakdown_area(mart: DataFrame, city: str, k: int = 20) -> DataFrame:
    """Q17: inside one real city, top k areas by revenue."""
    return (
        in_city(mart, city)
        .groupBy(area("city").alias("label"))
        .agg(F.sum("total_revenue").alias("revenue"), F.sum("total_orders").alias("orders"))
        .orderBy(F.col("revenue").desc_nulls_last(), F.col("label").asc_nulls_last())
        .limit(k)
    )


def cuisine_revenue(
    mart: DataFrame, restaurants: DataFrame, city: str | None = None, k: int = 10
) -> DataFrame:
    """Q18: revenue by cuisine, mart LEFT JOIN restaurants ON name.

    Reference behaviour kept on purpose: the join is on the name only, so
    a mart row's revenue counts once per restaurant row with that name;
    groups are the raw cuisine values (blank, NULL and padded values stay
    apart) and only the label is cleaned to ``'Unspecified'``.

    Computed without materialising the name join: revenue is summed per
    name and restaurant rows are counted per (name, cuisine); each pair of
    those contributes ``revenue x rows``. This equals the sum over the
    joined rows, but the join sees one row per name on the left and one
    per (name, cuisine) on the right, so a name shared by millions of rows
    does not produce millions-squared pairs.
    """
    per_name = in_city(mart, city).groupBy("restaurant_name").agg(
        F.sum("total_revenue").alias("name_revenue")
    )
    per_cuisine = restaurants.groupBy("restaurant_name", "cuisine").agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    joined = per_name.join(per_cuisine, "restaurant_name", "left")
    contribution = F.col("name_revenue") * F.coalesce(F.col("n_rows"), F.lit(1))
    label = F.coalesce(F.nullif(F.trim(F.col("cuisine")), F.lit("")), F.lit("Unspecified"))
    return (
        joined.groupBy("cuisine")
        .agg(F.sum(contribution).alias("revenue"))
        .select(label.alias("cuisine"), "revenue")
        .orderBy(F.col("revenue").desc_nulls_last(), F.col("cuisine").asc_nulls_last())
        .limit(k)
    )


def rating_distribution(restaurants: DataFrame, city: str | None = None) -> DataFrame:
    """Q19: restaurants per rating bucket, NULL ratings left out, empty
    buckets absent, in bucket order."""
    r = in_city(restaurants, city).filter(F.col("rating").isNotNull())
    return (
        r.groupBy(
            rating_bucket("rating").alias("bucket"), rating_sort_order("rating").alias("sort_order")
        )
        .agg(F.count(F.lit(1)).alias("restaurant_count"))
        .orderBy("sort_order")
        .select("bucket", "restaurant_count")
    )


def performance_listing(mart: DataFrame, city: str | None = None, sort: str = "revenue"):
    """Q20 rows before paging, with their total order."""
    sort_col = SORT_COLUMNS_TABLE.get(sort, "total_revenue")
    return _performance_columns(in_city(mart, city)), _desc_with_ties(sort_col)


def performance_page(
    mart: DataFrame, page: Page, city: str | None = None, sort: str = "revenue"
) -> DataFrame:
    """Q20: one page of mart rows with AOV, sorted DESC by revenue, orders
    or name, optionally in one real city."""
    rows, order = performance_listing(mart, city, sort)
    return page_rows(rows, order, page)
