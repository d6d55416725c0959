"""Properties across queries, and the rewrites checked against brute force."""

from pyspark.sql import functions as F

from dinelens.functions.metrics import aov
from dinelens.operators import insights, marts, revenue
from dinelens.operators.explorer import orders_listing
from dinelens.operators.paging import page_params
from dinelens.plans.registry import REGISTRY


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_city_revenue_sums_to_kpi_revenue(wh_mid):
    total = revenue.kpis(wh_mid.mart_orders, wh_mid.stg_restaurants).first()["total_revenue"]
    by_city = revenue.cities_ranked(wh_mid.mart_orders).agg(F.sum("revenue")).first()[0]
    assert abs(total - by_city) < 1e-6 * total


def test_breakdown_is_prefix_of_ranking(wh_mid):
    ranked = [(r.city, r.revenue) for r in revenue.cities_ranked(wh_mid.mart_orders).collect()]
    top = [(r.label, r.revenue) for r in revenue.breakdown_city(wh_mid.mart_orders).collect()]
    assert top == ranked[: len(top)]


def test_pages_concatenate_to_listing(wh_mid):
    listing = orders_listing(wh_mid.mart_orders)
    whole = [tuple(r) for r in listing.rows.orderBy(*listing.order).collect()]
    size = 7
    pages = []
    for p in range(1, len(whole) // size + 2):
        pages += [tuple(r) for r in listing.page(page_params(p, size)).collect()]
    assert pages == whole
    info = listing.info(page_params(1, size)).first()
    assert info.total_count == len(whole) and info.total_pages == -(-len(whole) // size)


def _brute_mart(orders, restaurants):
    j = orders.join(restaurants, "restaurant_id")
    return j.groupBy("restaurant_name", "city").agg(
        F.count("order_id").alias("total_orders"), F.sum("order_amount").alias("total_revenue")
    )


def test_mart_equals_join_then_aggregate(wh_mid):
    fast = wh_mid.mart_orders
    slow = _brute_mart(wh_mid.orders_for_marts, wh_mid.stg_restaurants)
    assert rows(fast, "restaurant_name", "city") == rows(slow, "restaurant_name", "city")


def test_mart_with_one_hot_restaurant(wh_mid):
    """A third of all orders on one restaurant: same result as brute force."""
    o = wh_mid.orders_for_marts.withColumn(
        "restaurant_id",
        F.when(F.col("order_id") % 3 == 0, F.lit(7)).otherwise(F.col("restaurant_id")),
    )
    fast = marts.mart_orders(o, wh_mid.stg_restaurants)
    slow = _brute_mart(o, wh_mid.stg_restaurants)
    assert rows(fast, "restaurant_name", "city") == rows(slow, "restaurant_name", "city")


def test_cuisine_revenue_equals_name_join(wh_mid):
    m, r = wh_mid.mart_orders, wh_mid.stg_restaurants
    joined = m.alias("o").join(r.alias("r"), F.col("r.restaurant_name") == F.col("o.restaurant_name"), "left")
    label = F.coalesce(F.nullif(F.trim(F.col("r.cuisine")), F.lit("")), F.lit("Unspecified"))
    slow = (
        joined.groupBy(F.col("r.cuisine"))
        .agg(F.sum("o.total_revenue").alias("revenue"))
        .select(label.alias("cuisine"), "revenue")
    )
    fast = revenue.cuisine_revenue(m, r, k=1000)
    assert sorted(rows(fast)) == sorted(rows(slow))


def test_review_sample_keeps_lowest_ids(wh_mid):
    raw = wh_mid.raw_reviews()
    s = insights.review_sample(raw, cap=30)
    per = s.groupBy("restaurant_id").agg(F.count("*").alias("n"), F.max("rn").alias("m"))
    assert per.filter((F.col("n") > 30) | (F.col("n") != F.col("m"))).count() == 0
    kept = {r.review_id for r in s.filter(F.col("restaurant_id") == "8").collect()}
    expect = {
        r.review_id
        for r in raw.filter((F.col("restaurant_id") == "8") & F.col("comment").isNotNull() & (F.trim("comment") != ""))
        .orderBy("review_id")
        .limit(30)
        .collect()
    }
    assert kept == expect


def test_insight_review_count_is_all_comments(wh_mid):
    built = REGISTRY["insights_build"](wh_mid)
    vol = insights.review_volume(wh_mid.stg_restaurants, wh_mid.raw_reviews(), 5, None)
    pairs = built.join(vol.select(F.col("restaurant_id").cast("string").alias("restaurant_id"),
                                  F.col("review_count").alias("n_all")), "restaurant_id")
    bad = pairs.filter(F.col("review_count") != F.col("n_all"))
    assert bad.count() == 0 and pairs.count() == built.count()


def test_aov_of_listing_rows(wh_mid):
    listing = orders_listing(wh_mid.mart_orders)
    check = listing.rows.filter(
        F.col("avg_order_value") != aov("total_revenue", "total_orders")
    )
    assert check.count() == 0


def test_review_sample_with_one_hot_restaurant(wh_mid):
    """A third of all reviews on one restaurant: still the 30 lowest ids
    there, and the other restaurants untouched."""
    raw = wh_mid.raw_reviews().withColumn(
        "restaurant_id",
        F.when(F.col("review_id") % 3 == 0, F.lit("8")).otherwise(F.col("restaurant_id")),
    )
    s = insights.review_sample(raw, cap=30)
    hot = [r.review_id for r in s.filter(F.col("restaurant_id") == "8").orderBy("rn").collect()]
    expect = [
        r.review_id
        for r in raw.filter((F.col("restaurant_id") == "8") & F.col("comment").isNotNull() & (F.trim("comment") != ""))
        .orderBy("review_id")
        .limit(30)
        .collect()
    ]
    assert hot == expect and len(hot) == 30
    assert s.groupBy("restaurant_id").count().filter("count > 30").count() == 0


def test_review_pages_with_late_texts_equal_plain_pages(wh_mid):
    from dinelens.operators import reviews
    from dinelens.operators.explorer import reviews_listing
    from dinelens.operators.paging import page_rows

    gold = wh_mid.gold_review_sentiments
    for search in (None, "the"):
        for texts in (None, wh_mid.gold_review_texts):
            listing = reviews_listing(gold, None, search, texts=texts)
            for page in (page_params(1, 10), page_params(4, 7), page_params(1, 500)):
                late = [tuple(r) for r in listing.page(page).collect()]
                plain = [tuple(r) for r in page_rows(listing.rows, listing.order, page).collect()]
                assert late == plain and len(late) == page.size
            head = [tuple(r) for r in listing.head(50).collect()]
            assert head == [tuple(r) for r in listing.rows.orderBy(*listing.order).limit(50).collect()]
    plain = gold.orderBy("review_id").limit(10).select("original_text", "sentiment", "summary")
    for texts in (None, wh_mid.gold_review_texts):
        assert rows(reviews.sample_reviews(gold, 10, texts)) == rows(plain)


def test_gold_texts_are_the_gold_text_column(wh_mid):
    gold = wh_mid.gold_review_sentiments.select("review_id", "original_text")
    texts = wh_mid.gold_review_texts.join(gold.select("review_id"), "review_id", "left_semi")
    assert rows(texts, "review_id") == rows(gold, "review_id")


def test_fallback_is_all_reviews_and_batches_are_top_k(wh_mid):
    from dinelens.operators import reviews
    from dinelens.operators.explorer import reviews_fallback

    raw = wh_mid.raw_reviews()
    plain = raw.select("review_id", "comment", "rating").orderBy("review_id")
    assert rows(reviews_fallback(raw).orderBy("review_id")) == rows(plain)
    cand = reviews.enrich_candidates(raw)
    for n in (1, 100, 10_000):
        plain = cand.orderBy("review_id").limit(n)
        assert rows(reviews.enrich_candidates(raw, batch_size=n)) == rows(plain)


def test_stg_orders_count_equals_its_mart_columns_count(wh_mid):
    # table_counts counts stg_orders without its 1:1 user_id lookup
    assert wh_mid.stg_orders.count() == wh_mid.orders_for_marts.count()
