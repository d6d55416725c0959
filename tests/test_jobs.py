"""Write jobs: CSV ingest, materialise, idempotent append, the two review
pipelines (batch and streaming), guarded SQL."""

import os

import pandas as pd
from pyspark.sql import functions as F

from dinelens import schemas
from dinelens.operators import adhoc, reviews, staging
from dinelens.operators.scoring import BatchScorer, RecordedReplies
from dinelens.plans import jobs
from dinelens.sources import catalog
from dinelens.streaming.incremental import start_review_enrichment


def test_ingest_csv_roundtrip(spark, wh_small, scratch):  # A1, H18
    path = os.path.join(scratch, "restaurant_csv")
    (
        wh_small.raw_restaurants.write.option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    back = catalog.ingest_csv(spark, path, schemas.RAW_RESTAURANTS)
    assert back.schema == schemas.RAW_RESTAURANTS
    # CSV cannot tell an empty string from a missing value: both read as NULL.
    norm = wh_small.raw_restaurants.withColumn("cuisine", F.nullif("cuisine", F.lit("")))
    assert sorted(back.collect()) == sorted(norm.collect())
    assert staging.stg_restaurants(back).count() == wh_small.stg_restaurants.count()


def test_materialize_and_scan(spark, wh_small, scratch):  # A2, A3
    path = os.path.join(scratch, "mart")
    n = catalog.materialize(wh_small.mart_orders, path).count()
    assert n == wh_small.mart_orders.count()
    again = catalog.materialize(wh_small.mart_orders, path)  # replace, not append
    assert again.count() == n
    assert catalog.scan(spark, path).count() == n


def test_build_warehouse_partitions_orders(spark, wh_small, scratch):
    tables = jobs.build_warehouse(wh_small, scratch)
    assert tables["stg_orders"].count() == wh_small.stg_orders.count()
    years = [d for d in os.listdir(os.path.join(scratch, "stg_orders")) if d.startswith("order_year=")]
    assert len(years) >= 5


def test_ensure_and_append_new_is_idempotent(spark, scratch):  # A4, A5
    path = os.path.join(scratch, "gold")
    t = catalog.ensure_table(spark, path, schemas.GOLD_REVIEW_SENTIMENTS)
    assert t.count() == 0 and t.schema == schemas.GOLD_REVIEW_SENTIMENTS
    rows = spark.createDataFrame(
        [(1, "a", "Positive", "x", "s", None), (1, "a", "Positive", "x", "s", None), (2, "b", "Neutral", "y", "t", None)],
        schemas.GOLD_REVIEW_SENTIMENTS,
    )
    assert catalog.append_new(rows, path, "review_id") == 2
    assert catalog.append_new(rows, path, "review_id") == 0
    assert spark.read.parquet(path).count() == 2


def test_catalog_table_append(spark, scratch):  # A4, A5 on catalog tables
    catalog.ensure_database(spark, "gold")
    name = "gold.gold_review_sentiments_t"
    t = catalog.ensure_catalog_table(spark, name, schemas.GOLD_REVIEW_SENTIMENTS, os.path.join(scratch, "t"))
    assert t.count() == 0
    rows = spark.createDataFrame(
        [(1, "a", "Positive", "x", "s", None), (2, "b", "Neutral", "y", "t", None)],
        schemas.GOLD_REVIEW_SENTIMENTS,
    )
    assert catalog.append_new(rows, name, "review_id") == 2
    assert catalog.append_new(rows, name, "review_id") == 0
    assert spark.table(name).count() == 2
    src, df = catalog.enriched_or_raw(spark, name, rows)
    assert src == "enriched" and df.count() == 2
    spark.sql(f"DROP TABLE {name}")


def test_enriched_or_raw(spark, wh_small, scratch):  # A8, E3
    src, df = catalog.enriched_or_raw(spark, os.path.join(scratch, "nope"), wh_small.raw_reviews())
    assert src == "raw"
    src, df = catalog.enriched_or_raw(spark, "no_such_table_here", wh_small.raw_reviews())
    assert src == "raw"


def test_review_enrichment_job_resumes(spark, wh_small, scratch):  # E6, E8, E9, H9
    gold = os.path.join(scratch, "gold_review_sentiments")
    raw = wh_small.raw_reviews(["review_id", "restaurant_id", "comment"])
    scorer = RecordedReplies(wh_small.review_responses)
    first = jobs.run_review_enrichment(raw, gold, scorer, batch_size=100)
    assert first.processed == 100 and first.appended == 100 - first.failed
    second = jobs.run_review_enrichment(raw, gold, scorer, batch_size=None)
    total = spark.read.parquet(gold)
    assert total.count() == wh_small.gold_review_sentiments.count()
    assert total.select("review_id").distinct().count() == total.count()
    third = jobs.run_review_enrichment(raw, gold, scorer, batch_size=None)
    # only the malformed replies are tried again, and they fail again
    assert third.appended == 0 and third.processed == third.failed
    assert second.appended + first.appended == total.count()


def test_batch_scorer_runs_python_on_batches(spark, wh_small):  # E8 pluggable scorer
    def model(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: '{"sentiment": "%s"}' % ("Positive" if "the" in t else "Neutral"))

    out = reviews.enrich_reviews(wh_small.raw_reviews(), BatchScorer(model))
    counts = {r.sentiment: r["count"] for r in reviews.sentiment_counts(reviews.sentiment_rows(out)).collect()}
    assert sum(counts.values()) == out.count() and set(counts) <= {"Positive", "Neutral"}
    assert out.filter(F.col("topics") != "General").count() == 0


def test_insights_job_resumes(spark, wh_small, scratch):  # E11, E15
    path = os.path.join(scratch, "gold_restaurant_insights")
    raw = wh_small.raw_reviews(["review_id", "restaurant_id", "comment"])
    scorer = RecordedReplies(wh_small.insight_responses)
    first = jobs.run_restaurant_insights(wh_small.stg_restaurants, raw, path, scorer, top_n=3)
    assert first.processed == 3
    jobs.run_restaurant_insights(wh_small.stg_restaurants, raw, path, scorer, top_n=None)
    table = spark.read.parquet(path)
    assert table.count() == wh_small.gold_restaurant_insights.count()
    assert table.filter(F.col("analyzed_at").isNull()).count() == 0
    again = jobs.run_restaurant_insights(wh_small.stg_restaurants, raw, path, scorer, top_n=None)
    assert again.appended == 0 and again.processed == again.failed


def test_streaming_enrichment_picks_up_new_files(spark, wh_small, scratch):
    raw_dir = os.path.join(scratch, "raw_reviews")
    gold = os.path.join(scratch, "gold")
    ckpt = os.path.join(scratch, "ckpt")
    raw = wh_small.raw_reviews()
    scorer = RecordedReplies(wh_small.review_responses)
    raw.filter("review_id < 100").write.parquet(os.path.join(raw_dir, "part1"))
    q = start_review_enrichment(spark, raw_dir + "/*", gold, scorer, checkpoint_location=ckpt)
    q.awaitTermination()
    n1 = spark.read.parquet(gold).count()
    raw.filter("review_id >= 100").write.parquet(os.path.join(raw_dir, "part2"))
    q = start_review_enrichment(spark, raw_dir + "/*", gold, scorer, checkpoint_location=ckpt)
    q.awaitTermination()
    n2 = spark.read.parquet(gold).count()
    assert 0 < n1 < n2 == wh_small.gold_review_sentiments.count()


def test_guard_refuses_writes_and_non_select(spark, wh_small):  # G1, H19
    views = wh_small.views()
    for text in (
        "SELECT 1;",
        "select 'please delete me' AS x",
        "WITH t AS (SELECT city FROM mart_orders) SELECT count(*) AS n FROM t",
        "SELECT city FROM mart_orders UNION SELECT city FROM stg_restaurants ORDER BY city LIMIT 3",
        "SELECT * FROM mart_orders WHERE total_orders > (SELECT avg(total_orders) FROM mart_orders)",
        "SELECT col FROM explode(array(1, 2))",
    ):
        assert adhoc.guarded_sql(spark, text, views).ok, text
    for text in (
        "SELECT * FROM mart_orders; DROP TABLE mart_orders",
        "DROP VIEW mart_orders",
        "INSERT INTO mart_orders SELECT * FROM mart_orders",
        "CREATE TABLE x AS SELECT 1",
        "SET spark.sql.ansi.enabled=false",
        "SHOW TABLES",
        "EXPLAIN SELECT 1",
        "SELECT * FROM text.`/etc/hostname`",
        "SELECT * FROM mart_orders WHERE city IN (SELECT value FROM text.`/etc/hostname`)",
        "WITH t AS (SELECT * FROM csv.`/etc/passwd`) SELECT * FROM t",
        "SELECT (SELECT max(value) FROM text.`/etc/hostname`) AS x",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
        "SELECT x FROM (SELECT Try_Reflect('java.lang.System', 'getProperty', 'user.home') AS x)",
        "SELECT * FROM no_such_view",
        "FROM mart_orders INSERT OVERWRITE DIRECTORY '/tmp/x' SELECT *",
        "not sql at all",
        "",
    ):
        got = adhoc.guarded_sql(spark, text, views)
        assert not got.ok and got.frame is None and got.error, text
    bad = adhoc.guarded_sql(spark, "SELECT nope FROM mart_orders", wh_small.views())
    assert not bad.ok and bad.error
    good = adhoc.guarded_sql(spark, "SELECT COUNT(*) AS n FROM mart_orders", wh_small.views())
    assert good.ok and good.columns == ["n"] and good.frame.first()["n"] == wh_small.mart_orders.count()
    many = adhoc.guarded_sql(spark, "SELECT * FROM raw_orders", wh_small.views())
    rows, more = many.fetch(max_rows=5)
    assert len(rows) == 5 and more


def test_bucketed_review_tables_join_without_shuffle(spark, wh_small, scratch):  # A3
    texts = wh_small.raw_reviews(["review_id", "comment"])
    labels = wh_small.raw_reviews(["review_id", "rating"])
    a = catalog.materialize_bucketed(texts, "bkt_review_texts", "review_id", 4, f"{scratch}/a")
    b = catalog.materialize_bucketed(labels, "bkt_review_labels", "review_id", 4, f"{scratch}/b")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = a.join(b, "review_id")
        pending = a.join(b.select("review_id"), "review_id", "left_anti")
        for df in (joined, pending):
            p = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in p and "Exchange" not in p, p
        assert sorted(joined.collect()) == sorted(texts.join(labels, "review_id").collect())
        assert pending.count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS bkt_review_texts")
        spark.sql("DROP TABLE IF EXISTS bkt_review_labels")
