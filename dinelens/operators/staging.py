"""Silver layer: typed, renamed columns.

Pure ``DataFrame -> DataFrame`` projections; no shuffle. ``strict=True``
keeps the reference behaviour (a text that is not a number fails the job,
like an ANSI cast); ``strict=False`` uses ``try_cast`` and yields NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinelens.functions.cleaning import clean_cost, clean_rating


def _cast(c: str, t: str, strict: bool):
    col = F.col(c)
    return col.cast(t) if strict else col.try_cast(t)


def stg_restaurants(raw: DataFrame, strict: bool = True) -> DataFrame:
    """``id -> restaurant_id BIGINT``, ``name -> restaurant_name``, rating
    ``'--'`` -> NULL else FLOAT, cost ``'₹ 200'`` -> 200 INT."""
    return raw.select(
        _cast("id", "bigint", strict).alias("restaurant_id"),
        F.col("name").alias("restaurant_name"),
        F.col("city"),
        clean_rating("rating", strict).alias("rating"),
        clean_cost("cost", strict).alias("cost_for_two"),
        F.col("cuisine"),
    )


def stg_restaurants_typed(frame: DataFrame) -> DataFrame:
    """Input already named ``restaurant_id, restaurant_name, city,
    cuisine, rating, cost_for_two``; only rating and cost are cast. A
    fractional cost is rounded half to even before the INTEGER cast."""
    cost = F.col("cost_for_two")
    if dict(frame.dtypes)["cost_for_two"] in ("float", "double"):
        cost = F.bround(cost)
    return frame.select(
        "restaurant_id",
        "restaurant_name",
        "city",
        "cuisine",
        F.col("rating").cast("float").alias("rating"),
        cost.cast("int").alias("cost_for_two"),
    )


def stg_orders(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Ids to BIGINT, date to DATE, amount to FLOAT;
    ``r_id -> restaurant_id``, ``sales_amount -> order_amount``.

    Ids are wider than the INT of the original tables: order ids pass 2^31
    long before the data is large, and an INT cast would fail the job.

    Only the columns present in ``raw`` are produced, so a caller that
    needs fewer columns can hand in a narrower raw frame.
    """
    spec = [
        ("order_id", "order_id", "bigint"),
        ("r_id", "restaurant_id", "bigint"),
        ("user_id", "user_id", "bigint"),
        ("order_date", "order_date", "date"),
        ("order_status", "order_status", None),
        ("sales_amount", "order_amount", "float"),
    ]
    cols = []
    for src, dst, typ in spec:
        if src not in raw.columns:
            continue
        cols.append((_cast(src, typ, strict) if typ else F.col(src)).alias(dst))
    return raw.select(*cols)


def _rejected(raw_col: str, cleaned):
    return F.col(raw_col).isNotNull() & cleaned.isNull()


def restaurant_rejects(raw: DataFrame) -> DataFrame:
    """H17, lenient mode: one row counting raw restaurant values that the
    lenient casts turned into NULL (``'--'`` ratings are not rejects)."""
    rating = clean_rating("rating", strict=False)
    rating_bad = _rejected("rating", rating) & (F.col("rating") != F.lit("--"))
    return raw.agg(
        F.count_if(_rejected("id", F.col("id").try_cast("bigint"))).alias("id_rejects"),
        F.count_if(rating_bad).alias("rating_rejects"),
        F.count_if(_rejected("cost", clean_cost("cost", strict=False))).alias("cost_rejects"),
    )


def order_rejects(raw: DataFrame) -> DataFrame:
    """H17, lenient mode: raw order values that do not cast, per column."""
    spec = [("order_id", "bigint"), ("r_id", "bigint"), ("user_id", "bigint"), ("order_date", "date"), ("sales_amount", "float")]
    present = [(c, t) for c, t in spec if c in raw.columns]
    return raw.agg(
        *[F.count_if(_rejected(c, F.col(c).try_cast(t))).alias(f"{c}_rejects") for c, t in present]
    )
