"""Incremental marts, the append ledger and the quarantining ingest: crashes, replays, late and bad rows."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dinelens.operators import marts, reviews
from dinelens.operators.scoring import RuleScorer
from dinelens.plans import incremental
from dinelens.sources import catalog, ledger, quarantine
from dinelens.streaming.incremental import enrich_micro_batch_once

ORDERS = "order_id long, restaurant_id long, order_date date, order_amount float"


def orders(spark, rows):
    df = spark.createDataFrame(rows, "order_id long, restaurant_id long, day string, order_amount float")
    return df.withColumn("order_date", F.col("day").cast("date")).drop("day")


def files(path):
    return {(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_days_equal_a_rebuild_and_only_touched_days_are_rewritten(spark, scratch):
    path = f"{scratch}/days"
    restaurants = spark.createDataFrame([(1, "a", "X"), (2, "b", "X"), (3, "a", None)], "restaurant_id long, restaurant_name string, city string")
    first = [(1, 1, "2024-01-01", 5.0), (2, 2, "2024-01-02", None), (3, 3, None, 2.5), (4, 1, "2024-01-02", 1.0), (None, 1, "2024-01-01", 4.0)]
    late = [(5, 1, "2024-01-01", 7.0), (6, 9, "2024-01-03", 1.0), (7, 3, None, 1.5)]

    def check(rows):
        got = sorted(map(tuple, incremental.mart_orders(incremental.read_days(spark, path), restaurants).collect()), key=str)
        assert got == sorted(map(tuple, marts.mart_orders(orders(spark, rows), restaurants).collect()), key=str)

    incremental.load_orders(orders(spark, first), path, "one")
    check(first)
    before = files(path)
    incremental.load_orders(orders(spark, late), path, "two")
    check(first + late)
    kept = {k for k, v in files(path).items() if before.get(k) == v}
    assert kept == {k for k in before if "order_date=2024-01-02" in k[0]} and kept
    incremental.load_orders(orders(spark, late), path, "two")  # again
    check(first + late)
    incremental.load_orders(orders(spark, late[:1]), path, "two")  # corrected: two days fewer
    check(first + late[:1])
    incremental.load_orders(orders(spark, []), path, "two")
    check(first)


def batch(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "review_id long")


def table(spark, target):
    rows = ledger.read_table(spark, target, T.StructType.fromDDL("review_id long")).collect()
    return sorted(((r["review_id"], r["batch_id"]) for r in rows), key=str)


def test_a_replay_adds_nothing_nulls_included(spark, scratch):
    target = f"{scratch}/gold"
    assert table(spark, target) == []
    assert ledger.append_batch(batch(spark, 1, None, 2, 2), target, "review_id", 0) == 3
    assert ledger.append_batch(batch(spark, 2, None, 3), target, "review_id", 1) == 1
    want = sorted([(1, 0), (2, 0), (None, 0), (3, 1)], key=str)
    assert table(spark, target) == want
    for number, ids in enumerate([(1, None, 2, 2), (2, None, 3)]):
        ledger.append_batch(batch(spark, *ids), target, "review_id", number)
    assert table(spark, target) == want
    assert ledger.append_batch(batch(spark), target, "review_id", 2) == 0
    assert ledger.append_batch(batch(spark, 1, None), target, "review_id", 3) == 0
    assert [len(r["files"]) > 0 for r in ledger.batches(spark, target).orderBy("batch_id").collect()] == [True, True, False, False]


def test_a_crash_between_write_and_record(spark, scratch):
    target = f"{scratch}/gold"
    ledger.append_batch(batch(spark, 1), target, "review_id", 0)
    ledger.write_batch(batch(spark, 1, 5, None), target, ["review_id"], 1)  # the job dies here
    assert table(spark, target) == [(1, 0)]
    assert ledger.append_batch(batch(spark, 1, 5, None), target, "review_id", 1) == 2
    assert table(spark, target) == sorted([(1, 0), (5, 1), (None, 1)], key=str)


def test_stream_batches_are_enriched_once(spark, scratch):
    target = f"{scratch}/gold"
    raw = spark.createDataFrame([(1, "good and tasty food"), (None, "cold and late again"), (1, "good and tasty food")], "review_id long, comment string")
    assert enrich_micro_batch_once(raw, target, RuleScorer(), 0) == 2
    assert enrich_micro_batch_once(raw, target, RuleScorer(), 0) == 2
    assert enrich_micro_batch_once(raw, target, RuleScorer(), 1) == 0


def test_reviews_without_id_are_sent_once(spark):
    raw = spark.createDataFrame([(None, "long enough text"), (4, "long enough text")], "review_id long, comment string")
    assert reviews.enrich_candidates(raw, done=raw.filter("review_id IS NULL")).collect() == [(4, "long enough text")]


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(text)


SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("c", T.DoubleType())])


def test_quarantine_by_header_names(spark, scratch):
    write(scratch, "one.csv", "a,b,c\n1,x,1.5\nbad,y,2\n3,z\n\n4,\"q, q\",\n5,five,5,5\n")
    write(scratch, "two.csv", "﻿c,extra,b,a\n0.5,e, pad ,7\nno,e,w,also no\n")
    write(scratch, "lacks.csv", "a,c\n1,2\n3,4\n")
    write(scratch, "twice.csv", "a,b,c,a\n1,2,3,4\n")
    found = quarantine.ingest(spark, scratch, SCHEMA)
    assert sorted(map(tuple, found.rows.collect())) == [(1, "x", 1.5), (4, "q, q", None), (7, " pad ", 0.5)]
    rejects = sorted((r["file"].rsplit("/", 1)[1], r["record"], r["reason"]) for r in found.rejects.collect())
    assert rejects == [
        ("lacks.csv", 1, "header lacks: b"), ("lacks.csv", 2, "header lacks: b"),
        ("one.csv", 2, "bad value: a"), ("one.csv", 3, "wrong number of fields"), ("one.csv", 5, "wrong number of fields"),
        ("twice.csv", 1, "header repeats: a"), ("two.csv", 2, "bad value: a, c"),
    ]
    # the same whichever columns are read
    assert found.rows.count() == 3 and found.rows.select("a").count() == 3 and found.rejects.count() == 7
    assert {r["text"] for r in found.rejects.filter("record = 3").collect()} == {"3,z"}


def test_records_are_numbered_over_splits(spark, scratch):
    write(scratch, "big.csv", "a,b,c\n" + "".join(f"{i if i % 1000 else 'x'},{'t' * 40},1\n" for i in range(1, 20001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        found = quarantine.ingest(spark, scratch, SCHEMA)
        assert found.rows.rdd.getNumPartitions() > 3
        assert sorted(r["record"] for r in found.rejects.collect()) == list(range(1000, 20001, 1000))
        assert found.rows.count() == 19980
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_quoted_line_breaks(spark, scratch):
    write(scratch, "m.csv", 'a,b,c\n1,"two\nlines",3\nx,"y\nz",1\n')
    found = quarantine.ingest(spark, scratch, SCHEMA, multi_line=True)
    assert [tuple(r) for r in found.rows.collect()] == [(1, "two\nlines", 3.0)]
    assert [(r["record"], r["reason"]) for r in found.rejects.collect()] == [(2, "bad value: a")]


def test_ingest_csv_matches_names_and_fails_on_others(spark, scratch):
    write(f"{scratch}/ok", "f.csv", "b,a\nB1,A1\n")
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    assert [tuple(r) for r in catalog.ingest_csv(spark, f"{scratch}/ok", schema).collect()] == [("A1", "B1")]
    with pytest.raises(ValueError, match="lacks"):
        catalog.ingest_csv(spark, f"{scratch}/ok", T.StructType.fromDDL("a string, z string"))
