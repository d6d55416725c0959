"""Typed schemas of the bronze, silver and gold tables."""

from pyspark.sql import types as T

S, I, L, F32, D, DT, TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.FloatType(),
    T.DoubleType(),
    T.DateType(),
    T.TimestampType(),
)


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Bronze: raw tables as delivered, text columns.
RAW_RESTAURANTS = _struct(
    ("id", S), ("name", S), ("city", S), ("rating", S), ("cost", S), ("cuisine", S)
)
RAW_ORDERS = _struct(
    ("order_id", S),
    ("r_id", S),
    ("user_id", S),
    ("order_date", S),
    ("order_status", S),
    ("sales_amount", S),
    ("restaurant_city", S),
)
RAW_REVIEWS = _struct(("review_id", L), ("restaurant_id", S), ("comment", S), ("rating", I))

# Silver.
STG_RESTAURANTS = _struct(
    ("restaurant_id", L),
    ("restaurant_name", S),
    ("city", S),
    ("rating", F32),
    ("cost_for_two", I),
    ("cuisine", S),
)
STG_ORDERS = _struct(
    ("order_id", L),
    ("restaurant_id", L),
    ("user_id", L),
    ("order_date", DT),
    ("order_status", S),
    ("order_amount", F32),
)

# Gold.
MART_ORDERS = _struct(
    ("restaurant_name", S), ("city", S), ("total_orders", L), ("total_revenue", D)
)
# Partial sums of the incremental marts; ``order_date`` is the partition.
ORDER_DAYS = _struct(("restaurant_id", L), ("load_id", S), ("n_orders", L), ("revenue", D), ("order_date", DT))
GOLD_REVIEW_SENTIMENTS = _struct(
    ("review_id", L),
    ("original_text", S),
    ("sentiment", S),
    ("topics", S),
    ("summary", S),
    ("processed_at", TS),
)
GOLD_RESTAURANT_INSIGHTS = _struct(
    ("restaurant_id", S),
    ("restaurant_name", S),
    ("city", S),
    ("review_count", I),
    ("positive_count", I),
    ("negative_count", I),
    ("neutral_count", I),
    ("top_negative_themes", S),
    ("top_positive_themes", S),
    ("summary", S),
    ("analyzed_at", TS),
)
