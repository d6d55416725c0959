"""Unit tests on literals for the shared expressions."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from dinelens.functions import (
    aov,
    area,
    clean_cost,
    clean_rating,
    rating_bucket,
    real_city,
    rx_search,
    split_list,
    strip_ws,
)
from dinelens.operators.reviews import parse_review_reply
from dinelens.operators.insights import parse_insight_reply


def one(spark, col, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(col(F.col("v")).alias("out")).first()["out"]


@pytest.mark.parametrize(
    "text,city,ar",
    [
        ("Jayanagar,Bangalore", "Bangalore", "Jayanagar"),
        ("Kolkata", "Kolkata", "Kolkata"),
        ("a,b,c", "b", "a"),
        ("a,", "", "a"),
        (" Salt Lake , Kolkata ", "Kolkata", "Salt Lake"),
        (None, None, None),
    ],
)
def test_real_city_and_area(spark, text, city, ar):  # H11
    assert one(spark, real_city, text) == city
    assert one(spark, area, text) == ar


def test_clean_rating_and_cost(spark):  # P1, H17
    assert one(spark, clean_rating, "--") is None
    assert abs(one(spark, clean_rating, "4.1") - 4.1) < 1e-6
    assert one(spark, clean_cost, "₹ 200") == 200
    assert one(spark, lambda c: clean_rating(c, strict=False), "new") is None
    assert one(spark, lambda c: clean_cost(c, strict=False), "₹200") is None
    with pytest.raises(Exception):
        one(spark, clean_cost, "1,200")


def test_strip_and_split(spark):  # E5, E17 white space
    assert one(spark, strip_ws, " \t Delivery \n") == "Delivery"
    assert one(spark, split_list, "Packaging,, Delivery ") == ["Packaging", "Delivery"]
    assert one(spark, split_list, "") == []
    assert one(spark, split_list, None) is None


def test_search_is_regex_case_insensitive(spark):  # H10
    df = spark.createDataFrame([("Merchant 12",), ("merchant 7",), (None,)], "n string")
    hits = [r.n for r in df.filter(rx_search("n", "chant [1-4]")).collect()]
    assert hits == ["Merchant 12"]
    assert df.filter(rx_search("n", "MERCHANT", literal=True)).count() == 2
    with pytest.raises(Exception):
        df.filter(rx_search("n", "(")).collect()


def test_rating_compare_in_float(spark):  # H7
    df = spark.createDataFrame([(4.1,)], "r float")
    assert df.filter(F.col("r") >= F.lit(4.1).cast("float")).count() == 1
    assert df.filter(F.col("r") >= F.lit(4.1)).count() == 0


def test_rating_bucket_bounds(spark):
    df = spark.createDataFrame([(1.9,), (2.0,), (3.99,), (4.0,), (4.5,), (5.0,)], "r float")
    got = [r.b for r in df.select(rating_bucket("r").alias("b")).collect()]
    assert got == ["< 2.0", "2.0 - 3.0", "3.0 - 4.0", "4.0 - 4.5", "4.5+", "4.5+"]


def test_aov_zero_orders_is_null(spark):
    df = spark.createDataFrame([(10.0, 0), (10.0, 3)], "rev double, n long")
    assert [r.a for r in df.select(aov("rev", "n").alias("a")).collect()] == [None, 3.33]


def test_nulls_last_on_ascending_sort(spark):  # H4
    df = spark.createDataFrame([("b",), (None,), ("a",)], "c string")
    assert [r.c for r in df.orderBy(F.col("c").asc_nulls_last()).collect()] == ["a", "b", None]


def test_parse_review_reply_cases(spark):  # E7
    rows = [
        (1, '<think>x</think>```json\n{"sentiment": "Positive", "topics": "A, B", "summary": "ok"}\n```'),
        (2, '{"sentiment": "Negative"}'),
        (3, "not json"),
        (4, '{"sentiment": null, "topics": "T"}'),
        (5, "[1, 2]"),
        (6, None),
        (7, '{"a": 1} trailing'),
    ]
    df = spark.createDataFrame(rows, "review_id int, response string")
    got = {r.review_id: r for r in parse_review_reply(df).collect()}
    assert (got[1].ok, got[1].sentiment, got[1].topics, got[1].summary) == (True, "Positive", "A, B", "ok")
    assert (got[2].ok, got[2].topics, got[2].summary) == (True, "General", "No summary")
    assert not got[3].ok and not got[5].ok and not got[6].ok and not got[7].ok
    assert got[4].ok and got[4].sentiment is None and got[4].summary == "No summary"


def test_parse_insight_reply_cases(spark):  # E14
    rows = [
        ("1", '<think>{plan}</think>```json\n{"positive_count": 3, "negative_count": 1, "neutral_count": 2, '
         '"top_negative_themes": ["a", "b", "c", "d", "e"], "top_positive_themes": [], "summary": "s"}\n```'),
        ("2", 'Sure! {"positive_count": 1} hope this helps'),
        ("3", "Rate limit reached"),
    ]
    df = spark.createDataFrame(rows, "restaurant_id string, response string")
    got = {r.restaurant_id: r for r in parse_insight_reply(df, max_themes=4).collect()}
    r1 = got["1"]
    assert r1.ok and (r1.positive_count, r1.negative_count, r1.neutral_count) == (3, 1, 2)
    assert r1.top_negative_themes == "a, b, c, d" and r1.top_positive_themes == "" and r1.summary == "s"
    r2 = got["2"]
    assert r2.ok and r2.positive_count == 1 and r2.negative_count == 0 and r2.summary == ""
    assert not got["3"].ok


def test_lenient_staging_counts_rejects(spark):  # H17
    from dinelens.operators.staging import order_rejects, restaurant_rejects, stg_restaurants

    raw = spark.createDataFrame(
        [("1", "A", "X", "4.1", "₹ 200", "c"), ("x", "B", "Y", "--", "₹200", None), ("3", "C", "Z", "new", "1,200", "d")],
        "id string, name string, city string, rating string, cost string, cuisine string",
    )
    got = restaurant_rejects(raw).first()
    assert (got.id_rejects, got.rating_rejects, got.cost_rejects) == (1, 1, 2)
    assert stg_restaurants(raw, strict=False).count() == 3
    orders = spark.createDataFrame([("1", "2", "3", "2020-01-02", "9.5"), ("a", "2", "3", "bad", "9")],
                                   "order_id string, r_id string, user_id string, order_date string, sales_amount string")
    o = order_rejects(orders).first()
    assert (o.order_id_rejects, o.order_date_rejects, o.sales_amount_rejects) == (1, 1, 0)
