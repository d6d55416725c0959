"""Physical plan shapes: the properties that matter at scale."""

import re

from dinelens.plans.registry import REGISTRY


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_is_take_ordered(wh_small):
    for key in ("top_restaurants", "restaurant_detail", "performance_page", "explore_restaurants"):
        assert "TakeOrderedAndProject" in plan(REGISTRY[key](wh_small)), key


def test_mart_aggregates_before_the_join(wh_small):
    p = plan(wh_small.mart_orders)
    # orders are reduced per restaurant id map-side before any exchange
    assert "partial_count(order_id" in p and "partial_sum(order_amount" in p
    assert "Exchange hashpartitioning(restaurant_id" in p
    assert re.search(r"HashAggregate\(keys=\[restaurant_id#\d+L?\], functions=\[partial_count\(order_id", p)


def explain(df) -> str:
    jvm = df.sparkSession._jvm
    mode = jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_scan_prunes_columns_and_pushes_filters(wh_small):
    text = explain(REGISTRY["trend_monthly"](wh_small))
    schemas = [line for line in text.splitlines() if line.startswith("ReadSchema: struct<l_")]
    assert schemas == [
        "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_extendedprice:double,l_shipdate:timestamp_ntz>"
    ]
    text = explain(REGISTRY["explore_reviews_raw"](wh_small))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_review_sample_limits_before_shuffle(wh_small):
    p = plan(REGISTRY["review_sample"](wh_small))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_cuisine_revenue_never_joins_rows_by_name(wh_small):
    p = plan(REGISTRY["cuisine_revenue"](wh_small))
    # both sides of the name join are aggregates (one row per name / per
    # (name, cuisine)), never the raw mart rows against raw restaurants
    assert p.count("HashAggregate") >= 6


# The learned scorer looks its weights up in numpy, by a Pandas UDF over hashed features.
PANDAS_UDF_KEYS = {"enrich_reviews_learned", "learned_held_out"}


def test_no_python_in_registered_queries(wh_small):
    for key in REGISTRY.keys() - PANDAS_UDF_KEYS:
        p = plan(REGISTRY[key](wh_small))
        for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
            assert node not in p, (key, node)


def test_review_pages_cut_before_texts_join(wh_small):
    text_col = r"\b(review|original_text|comment|text)#"
    for key in (
        "explore_reviews",
        "explore_reviews_search",
        "sample_reviews",
    ):
        p = plan(REGISTRY[key](wh_small))
        cuts = re.findall(r"TakeOrderedAndProject\(limit=\d+.*?output=\[([^\]]*)\]", p)
        assert len(cuts) == 2, key
        # the inner cut (the rows that meet the texts) holds no text column
        assert not re.search(text_col, cuts[1]), (key, cuts)
        assert re.search(text_col, cuts[0]), (key, cuts)


def _shuffle_inputs(df) -> list[str]:
    """The ``Input`` line of every shuffle (not broadcast) exchange."""
    lines = explain(df).splitlines()
    out = []
    for i, line in enumerate(lines):
        if re.match(r"^\(\d+\) Exchange\b", line):
            out += [l for l in lines[i + 1 : i + 4] if l.startswith("Input")]
    return out


def test_no_text_is_shuffled_without_auto_broadcast(spark, wh_small):
    # as on a cluster where every table is far above the broadcast threshold
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for key in (
            "explore_reviews",
            "explore_reviews_search",
            "sample_reviews",
            "enrich_candidates_batch",
            "review_volume",
        ):
            inputs = _shuffle_inputs(REGISTRY[key](wh_small))
            for line in inputs:
                assert not re.search(r"\b(review|original_text|comment|text)#", line), (key, line)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_bounded_broadcast_only_below_the_bound(wh_small):
    from dinelens.operators.paging import MAX_BROADCAST_ROWS, bounded_broadcast

    df = wh_small.raw_reviews(["review_id"]).limit(5)

    def hinted(d):
        return "broadcast" in d._jdf.queryExecution().analyzed().toString().lower()

    assert hinted(bounded_broadcast(df, 5))
    assert not hinted(bounded_broadcast(df, MAX_BROADCAST_ROWS + 1))
    assert not hinted(bounded_broadcast(df, None))
