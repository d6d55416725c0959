"""Gold marts.

``mart_orders`` is the hub every dashboard query reads. It is computed as
*aggregate, then join*: orders are summed per ``restaurant_id`` first
(partial aggregation runs map-side, so a restaurant that holds a third of
all orders still sends one row per map task through the shuffle), and only
the per-restaurant totals meet the restaurant table. The sums equal those
of join-then-aggregate because every (order, restaurant row) pair
contributes the same addend either way. FLOAT amounts summed in DOUBLE are
exact while a total stays below about 2^53 times the smallest addend's last
bit (tens of billions here); beyond that the last digits of a total depend on
the order of addition, and answers that are shown are rounded outermost.

No broadcast hint: the restaurant side grows with the data, so the join
strategy is left to Catalyst's size estimate and AQE's runtime statistics
(broadcast while small, sort-merge beyond).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _orders_per_restaurant(orders: DataFrame) -> DataFrame:
    return orders.groupBy("restaurant_id").agg(
        F.count("order_id").alias("n_orders"),
        F.sum("order_amount").alias("revenue"),
    )


def mart_orders(orders: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Per (restaurant_name, city): ``COUNT(order_id)`` and
    ``SUM(order_amount)`` over the inner join on ``restaurant_id``."""
    return mart_orders_of(_orders_per_restaurant(orders), restaurants)


def mart_orders_of(per_id: DataFrame, restaurants: DataFrame) -> DataFrame:
    """P3 from ``restaurant_id, n_orders, revenue``, one row per restaurant."""
    r = restaurants.select("restaurant_id", "restaurant_name", "city")
    return (
        per_id.join(r, "restaurant_id")
        .groupBy("restaurant_name", "city")
        .agg(
            F.sum("n_orders").alias("total_orders"),
            F.sum("revenue").alias("total_revenue"),
        )
    )


def mart_city_restaurant_stats(restaurants: DataFrame) -> DataFrame:
    """Per non-NULL raw city: restaurant count, mean rating and mean
    cost, both rounded to 2."""
    return (
        restaurants.filter(F.col("city").isNotNull())
        .groupBy("city")
        .agg(
            F.count("restaurant_id").alias("total_restaurants"),
            F.round(F.avg("rating"), 2).alias("avg_rating"),
            F.round(F.avg("cost_for_two"), 2).alias("avg_cost_for_two"),
        )
    )


def mart_city_order_stats(orders: DataFrame, restaurants: DataFrame) -> DataFrame:
    """P5: per raw city: distinct restaurants with orders, orders, revenue.

    Built from the order/restaurant join before the name grouping (the
    mart has no id left). Orders are again summed per id first; the
    distinct count is then a count of distinct ids among the per-id rows.
    """
    return mart_city_order_stats_of(_orders_per_restaurant(orders), restaurants)


def mart_city_order_stats_of(per_id: DataFrame, restaurants: DataFrame) -> DataFrame:
    """P5 from ``restaurant_id, n_orders, revenue``, one row per restaurant."""
    r = restaurants.select("restaurant_id", "city")
    return (
        per_id.join(r, "restaurant_id")
        .groupBy("city")
        .agg(
            F.countDistinct("restaurant_id").alias("restaurant_count"),
            F.sum("n_orders").alias("total_orders"),
            F.sum("revenue").alias("total_revenue"),
        )
    )
