"""The probe values of FIXTURES.md section 3 at sf0.01."""

from pyspark.sql import functions as F

from dinelens.functions.places import real_city
from dinelens.operators import insights, revenue, reviews
from dinelens.plans.registry import REGISTRY


def test_restaurant_probe(wh_mid):
    r = wh_mid.raw_restaurants
    got = r.agg(
        F.count("*"),
        F.count("city"),
        F.countDistinct("city"),
        F.count_if(F.col("rating") == "--"),
        F.countDistinct("name"),
    ).first()
    assert tuple(got) == (100, 91, 28, 11, 50)


def test_order_probe(wh_mid):
    o = wh_mid.raw_orders()
    got = o.agg(F.count("*"), F.count("order_date"), F.count("sales_amount"), F.count("restaurant_city")).first()
    assert tuple(got) == (60000, 59367, 59360, 54659)


def test_review_and_reply_probe(wh_mid):
    rv = wh_mid.raw_reviews()
    got = rv.agg(F.count("*"), F.count("comment"), F.count("rating"), F.countDistinct("restaurant_id")).first()
    assert tuple(got) == (1000, 980, 399, 32)
    parsed = reviews.parse_review_reply(wh_mid.review_responses)
    assert parsed.count() == 956 and parsed.filter(~F.col("ok")).count() == 110
    counts = {r.sentiment: r["count"] for r in reviews.sentiment_counts(parsed.filter("ok")).collect()}
    assert counts == {"Positive": 239, "Negative": 7, "Neutral": 575, None: 25}


def test_review_volume_probe(wh_mid):
    vol = insights.review_volume(wh_mid.stg_restaurants, wh_mid.raw_reviews(), 5, None)
    got = vol.agg(F.count("*"), F.min("review_count"), F.max("review_count")).first()
    assert tuple(got) == (29, 6, 57)


def test_mart_probe_exact_sum(wh_mid):  # H6
    got = wh_mid.mart_orders.agg(F.count("*"), F.sum("total_revenue")).first()
    assert got[0] == 98 and got[1] == 3149251466.520569
    names = wh_mid.mart_orders.groupBy("restaurant_name").count().filter("count > 1").count()
    assert names == 48


def test_monthly_probe(wh_mid):  # H6, Q13
    monthly = revenue.trend(wh_mid.raw_orders(["order_date", "sales_amount"]), "monthly", False, None)
    assert monthly.count() == 83
    assert revenue.trend_summary(monthly).first()["total_revenue"] == 3116278752.61


def test_rating_and_city_probe(wh_mid):
    buckets = [r.restaurant_count for r in revenue.rating_distribution(wh_mid.stg_restaurants).collect()]
    assert buckets == [22, 22, 22, 10, 13]
    per_city = {
        r.c: r["count"]
        for r in wh_mid.stg_restaurants.groupBy(real_city("city").alias("c")).count().collect()
    }
    assert per_city == {"AFRICA": 13, "AMERICA": 24, "ASIA": 19, "EUROPE": 14, "MIDDLE EAST": 21, None: 9}


def test_topic_and_cuisine_probe(wh_mid):  # E5, H1, H2
    topics = {r.topic: r["count"] for r in REGISTRY["topic_counts"](wh_mid).collect()}
    assert topics == {
        "Delivery": 386,
        "Food Quality": 374,
        "Service": 254,
        "Packaging": 156,
        "Price": 144,
        "General": 62,
    }
    first_two = [r.cuisine for r in REGISTRY["cuisine_revenue"](wh_mid).collect()][:2]
    assert first_two == ["Unspecified", "Unspecified"]
