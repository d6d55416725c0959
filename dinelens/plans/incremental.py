"""Marts kept up to date by loads instead of rebuilt.

Orders are summed per day and restaurant when they arrive, and these partial
sums are the stored table: one partition a day, rows ``restaurant_id, load_id,
n_orders, revenue``. A load reads and rewrites the days that it touches, by
dynamic partition overwrite, and no others; late orders are simply orders of
an earlier day. The marts merge the partial sums when they are read, so a
query reads one row per day, restaurant and load instead of every order.

A load has an id. Running it again replaces its own rows, so a retry after a
crash adds nothing twice, and a corrected load takes back what it had brought:
days that it no longer has keep an empty row of it. A job's partitions are
exchanged when it commits; one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dinelens.operators import marts
from dinelens.schemas import ORDER_DAYS
from dinelens.sources import catalog


def daily_sums(orders: DataFrame, load_id: str) -> DataFrame:
    """A load's partial sums of staged orders."""
    return (
        orders.groupBy("order_date", "restaurant_id")
        .agg(F.count("order_id").alias("n_orders"), F.sum("order_amount").alias("revenue"))
        .select("restaurant_id", F.lit(load_id).alias("load_id"), "n_orders", "revenue", "order_date")
    )


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ORDER_DAYS).parquet(path)


def load_orders(orders: DataFrame, path: str, load_id: str) -> None:
    """Add the staged orders of one load to the table at ``path``."""
    spark = orders.sparkSession
    rows = daily_sums(orders, load_id)
    if catalog._exists(spark, path):
        old = read_days(spark, path)
        mine = F.col("load_id") == load_id
        before = old.filter(mine).select("order_date").distinct()
        touched = rows.select("order_date").unionByName(before).distinct().withColumnRenamed("order_date", "_day")
        others = old.filter(~mine).join(touched, F.col("order_date").eqNullSafe(F.col("_day")), "left_semi")
        empty = before.select(
            F.lit(None).cast("long").alias("restaurant_id"),
            F.lit(load_id).alias("load_id"),
            F.lit(0).cast("long").alias("n_orders"),
            F.lit(None).cast("double").alias("revenue"),
            "order_date",
        )
        rows = rows.unionByName(others).unionByName(empty)
    writer = rows.repartition("order_date").write.mode("overwrite").partitionBy("order_date")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def orders_per_restaurant(days: DataFrame) -> DataFrame:
    """The merged sums: ``restaurant_id, n_orders, revenue``."""
    sums = days.groupBy("restaurant_id").agg(F.sum("n_orders").alias("n_orders"), F.sum("revenue").alias("revenue"))
    return sums.filter(F.col("n_orders") > 0)


def mart_orders(days: DataFrame, restaurants: DataFrame) -> DataFrame:
    """P3 from the stored days."""
    return marts.mart_orders_of(orders_per_restaurant(days), restaurants)


def mart_city_order_stats(days: DataFrame, restaurants: DataFrame) -> DataFrame:
    """P5 from the stored days."""
    return marts.mart_city_order_stats_of(orders_per_restaurant(days), restaurants)
