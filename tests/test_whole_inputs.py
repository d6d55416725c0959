"""No caps and no keys that raw data does not have: all comments, all raw
reviews, repeated and NULL ids, wide ids, odd replies, all letters."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dinelens.functions.search import rx_search
from dinelens.operators import insights, reviews, staging
from dinelens.operators.explorer import reviews_fallback, reviews_listing
from dinelens.operators.paging import page_params
from dinelens.operators.scoring import BatchScorer, RuleScorer
from dinelens.plans.jobs import build_warehouse
from dinelens.plans.registry import REGISTRY
from dinelens.plans.warehouse import Warehouse
from tests.test_plans import explain, plan

RAW = "review_id long, restaurant_id string, comment string, rating int"


@pytest.fixture(scope="module")
def keyless(spark):
    long = "a comment that is long enough"
    rows = [
        (1, "8", f"{long} one", 5),
        (1, "8", f"{long} other", 1),
        (1, "8", f"{long} one", 5),
        (2, "8", f"{long} two", None),
        (None, "8", f"{long} without id", 3),
        (None, "8", f"{long} without id", 3),
        (None, None, f"{long} without anything", None),
        (3, "9", "short", 2),
        (4, "9", None, 2),
    ]
    return spark.createDataFrame(rows, RAW)


def test_raw_pages_keep_every_row(keyless):
    assert reviews_fallback(keyless).count() == 9
    listing = reviews_listing(None, keyless, "ENOUGH")
    got = [tuple(r) for r in listing.page(page_params(1, 100)).collect()]
    assert len(got) == 7 and listing.info(page_params(1, 3)).first()["total_count"] == 7
    pages = [tuple(r) for p in (1, 2, 3) for r in listing.page(page_params(p, 3)).collect()]
    assert pages == got


def test_batches_send_each_row_once(keyless):
    every = sorted(map(str, reviews.enrich_candidates(keyless).collect()))
    assert len(every) == 7
    assert sorted(map(str, reviews.enrich_candidates(keyless, batch_size=100).collect())) == every
    three = reviews.enrich_candidates(keyless, batch_size=3).collect()
    assert [r.review_id for r in three] == [1, 1, 1] and len({r.text for r in three}) == 2


def test_bundles_hold_every_comment(keyless):
    got = {(r.restaurant_id, r.request): r for r in insights.review_bundle(keyless, per_request=2).collect()}
    assert sum(r.n_reviews for r in got.values()) == 8
    assert sorted(r.n_reviews for (rid, _), r in got.items() if rid == "8") == [2, 2, 2]
    lines = [x for r in got.values() for x in r.numbered_reviews.split("\n")]
    assert len(lines) == 8 and all(re.match(r"[12]\. ", x) for x in lines)


def test_a_hot_restaurant_is_numbered_in_parts(spark):
    raw = spark.range(1000).select(
        F.col("id").alias("review_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), (F.col("id") % 50).cast("string"))).alias("restaurant_id"),
        F.concat(F.lit("text "), F.col("id").cast("string")).alias("comment"),
    )
    numbered = insights.number_reviews(raw, per_request=7, per_part=40)
    per = numbered.groupBy("rid", "request").agg(F.count("*").alias("n"), F.max("rn").alias("last"), F.countDistinct("rn").alias("rns")).collect()
    assert sum(r.n for r in per) == 1000 and all(r.n == r.last == r.rns <= 7 for r in per)
    whole = insights.review_bundle(raw, per_request=7)
    assert whole.agg(F.sum("n_reviews")).first()[0] == 1000


def test_no_text_enters_the_numbering_window(wh_small):
    p = explain(insights.number_reviews(wh_small.raw_reviews(["review_id", "restaurant_id", "comment"])))
    inputs = [line for line in p.splitlines() if line.startswith("Input") and re.search(r"\b(comment|text)#", line)]
    windows = p.index("Window")
    assert inputs and p.index(inputs[-1]) < windows + len(p)  # texts are read ..
    parts = re.split(r"\n\(\d+\) ", p)
    for part in parts:
        if part.startswith(("Exchange", "Sort", "Window")):
            assert not re.search(r"\b(comment|text)#", part), part  # .. and end at the scan


def test_order_ids_beyond_32_bits(spark):
    big = str(2**31 + 7)
    raw = spark.createDataFrame([(big, big, big, "2024-01-01", "F", 1.5)], "order_id string, r_id string, user_id string, order_date string, order_status string, sales_amount double")
    row = staging.stg_orders(raw).first()
    assert row.order_id == row.restaurant_id == row.user_id == 2**31 + 7
    assert staging.order_rejects(raw).first().asDict() == dict.fromkeys(["order_id_rejects", "r_id_rejects", "user_id_rejects", "order_date_rejects", "sales_amount_rejects"], 0)


def test_rejects_are_counted(spark):
    orders = spark.createDataFrame([("x", "1", None, "2024-13-01", "F", "abc"), ("2", "y", "3", "2024-01-01", "F", "1")], "order_id string, r_id string, user_id string, order_date string, order_status string, sales_amount string")
    assert tuple(staging.order_rejects(orders).first()) == (1, 1, 0, 1, 1)
    places = spark.createDataFrame([("x", "n", "c", "--", "₹ 1", None), ("1", "n", "c", "good", "many", None)], "id string, name string, city string, rating string, cost string, cuisine string")
    assert tuple(staging.restaurant_rejects(places).first()) == (1, 1, 1)


def test_search_folds_all_letters(spark):
    df = spark.createDataFrame([("CAFÉ Über",), ("café ÜBER",), ("ΣΊΓΜΑ",), (None,)], "t string")
    assert df.filter(rx_search("t", "café über")).count() == 2
    assert df.filter(rx_search("t", "σίγμα")).count() == 1


REPLIES = [
    ('{"sentiment":"Positive"} {"x":1}', False),
    ("noise {} more {}", False),
    ("{}", False),
    ('{"sentiment": null}', True),
    ('```json\n{"topics": "a", "deep": {"b": [1, 2]}}\n```', True),
    ('{"a": 1}]', False),
    ("[1]", False),
    ("", False),
    (None, False),
]


def test_review_replies_as_strict_as_json(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REPLIES)], "i int, response string")
    got = {r.i: r for r in reviews.parse_review_reply(df).collect()}
    assert [got[i].ok for i in range(len(REPLIES))] == [ok for _, ok in REPLIES]
    assert got[3].sentiment is None and got[3].topics == "General" and got[4].topics == "a"


def test_insight_replies(spark):
    texts = [
        ('{"positive_count": 3.0, "negative_count": "2", "neutral_count": 2.5}', (True, 3, 2, 2)),
        ('{"top_negative_themes": null}', (False, 0, 0, 0)),
        ('{"top_negative_themes": "late"}', (False, 0, 0, 0)),
        ('{"positive_count": "many"}', (False, None, 0, 0)),
        ('so {"positive_count": 1} and {"negative_count": 2}', (False, 0, 0, 0)),
        ('{"positive_count": null}', (True, None, 0, 0)),
        ("{}", (True, 0, 0, 0)),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, response string")
    got = {r.i: (r.ok, r.positive_count, r.negative_count, r.neutral_count) for r in insights.parse_insight_reply(df).collect()}
    assert [got[i] for i in range(len(texts))] == [want for _, want in texts]


def test_themes_of_all_requests_are_merged(spark):
    rows = [
        ("1", "n", "c", 0, 30, '{"positive_count": 2, "top_negative_themes": ["b", "a"], "summary": "first"}'),
        ("1", "n", "c", 1, 5, '{"positive_count": 1, "top_negative_themes": ["a", "c"], "summary": "second"}'),
        ("2", "m", "c", 0, 7, '{"positive_count": 9}'),
        ("2", "m", "c", 1, 7, "failed"),
    ]
    df = spark.createDataFrame(rows, "restaurant_id string, restaurant_name string, city string, request long, n_reviews int, response string")
    of = ["restaurant_id", "restaurant_name", "city"]
    got = {r.restaurant_id: r for r in insights._per_restaurant(insights._parsed(df, "response", None), of, None).collect()}
    one, two = got["1"], got["2"]
    assert one.ok and (one.review_count, one.positive_count, one.top_negative_themes, one.summary) == (35, 3, "a, b, c", "first")
    assert not two.ok and two.review_count == 14 and two.positive_count is None and two.top_negative_themes is None


def test_reply_clean_up_stands_once_in_a_plan(wh_small):
    for key in ("sentiment_counts", "top_topics", "explore_reviews_info", "ask_negative_topic", "enrich_report", "insights_list"):
        p = plan(REGISTRY[key](wh_small))
        assert p.count("(?is)<think>") == 1, key
        assert len(re.findall("jsonObjectKeys|json_object_keys", p)) <= 1, key


def test_enrichment_reads_the_documents_once(wh_small):
    p = explain(REGISTRY["enrich_report"](wh_small))
    assert len(re.findall(r"Location: .*documents", p)) == 1


def test_scoped_trend_joins_aggregates(spark, wh_small):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(REGISTRY["trend_scoped_city"](wh_small))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    join = p.index("Join")
    below = p[join:]
    assert re.search(r"Exchange hashpartitioning\(r_id#\d+, (period_start|_groupingexpression)#\d+", below)
    assert "partial_sum" in below and "partial_count" in below


def test_batch_scorer_spreads_requests_and_survives_failures(spark):
    calls = []

    def model(texts: pd.Series) -> pd.Series:
        if any("bad" in t for t in texts):
            raise RuntimeError("no reply")
        return texts.map(lambda t: '{"sentiment": "Positive"}') if len(texts) != 3 else texts.head(1)

    assert not calls
    rows = [(i, f"text number {i} {'bad' if i % 10 == 0 else ''} of some length") for i in range(100)]
    cut = spark.createDataFrame(rows, "review_id long, comment string").orderBy("review_id").limit(100)
    scored = BatchScorer(model, parallelism=6).score(cut, "review_id", "comment")
    assert scored.rdd.getNumPartitions() == 6
    got = {r.review_id: r.response for r in scored.collect()}
    assert all((got[i] is None) == (i % 10 == 0) for i in range(100))


def test_rule_scorer_needs_no_model(spark):
    df = spark.createDataFrame([(1, "Great food, fast delivery, friendly staff"), (2, "The worst: late and cold."), (3, "It was there."), (4, None)], "review_id long, comment string")
    got = {r.review_id: r for r in reviews.parse_review_reply(RuleScorer().score(df, "review_id", "comment")).collect()}
    assert [got[i].sentiment for i in (1, 2, 3)] == ["Positive", "Negative", "Neutral"]
    assert got[1].topics == "Delivery, Service" and got[3].topics == "General" and not got[4].ok


def test_queries_agree_over_built_tables(spark, wh_small, scratch):
    built = build_warehouse(wh_small, scratch)
    assert len(built) == 7
    w = Warehouse.from_built(spark, wh_small.base.root, scratch)
    norm = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    for key in (
        "kpis", "top_restaurants", "cities_ranked", "breakdown_area", "cuisine_revenue", "performance_page", "explore_orders_search",
        "mart_city_order_stats", "explore_reviews_search", "sentiment_counts", "top_topics", "sample_reviews", "insights_list", "insight_detail", "table_counts",
    ):
        assert norm(REGISTRY[key](w)) == norm(REGISTRY[key](wh_small)), key
    p = plan(REGISTRY["cities_ranked"](w))
    assert "lineitem" not in p


def test_year_partitions_have_few_files(wh_small, scratch):
    import glob

    build_warehouse(wh_small, scratch)
    for year in glob.glob(f"{scratch}/stg_orders/order_year=*"):
        assert len(glob.glob(f"{year}/*.parquet")) <= 8


def test_going_on_behind_a_row_equals_pages(wh_mid):
    from dinelens.operators import revenue

    whole = [tuple(r) for r in revenue._performance_columns(wh_mid.mart_orders).orderBy(
        F.col("total_revenue").desc_nulls_last(), F.col("restaurant_name").asc_nulls_last(), F.col("city").asc_nulls_last()
    ).collect()]
    got, last = [], None
    first = revenue._performance_columns(wh_mid.mart_orders)
    rows = [tuple(r) for r in first.orderBy(F.col("total_revenue").desc_nulls_last(), F.col("restaurant_name").asc_nulls_last(), F.col("city").asc_nulls_last()).limit(40).collect()]
    while rows:
        got += rows
        last = (rows[-1][3], rows[-1][0], rows[-1][1])
        rows = [tuple(r) for r in revenue.performance_after(wh_mid.mart_orders, last, 40).collect()]
    assert got == whole
