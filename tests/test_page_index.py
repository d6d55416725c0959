"""Pages at any depth, and distinct counts that merge."""

import re

import pytest
from pyspark.sql import functions as F

from dinelens.operators import distinct
from dinelens.operators.page_index import PageIndex
from dinelens.operators.paging import Page


def order():
    return [F.col("a").desc_nulls_last(), F.col("b").asc_nulls_last()]


@pytest.mark.parametrize("parts", [None, 6])
def test_every_page_is_the_sorted_rows_cut(spark, scratch, parts):
    # a third of the rows share the first column's value; some are NULL
    rows = [(None if i % 10 == 3 else 7 if i % 3 == 0 else i * 37 % 50, i if i % 50 else None) for i in range(203)]
    df = spark.createDataFrame(rows, "a long, b long")
    index = PageIndex.build(df, order(), f"{scratch}/pages", parts)
    want = [tuple(r) for r in df.orderBy(*order()).collect()]
    for size in (1, 10, 100):
        for page in {1, 2, 7, -(-203 // size), -(-203 // size) + 1, 10**6}:
            p = Page(page, size)
            got = [tuple(r) for r in index.page(p).collect()]
            # rows that are equal in the order's columns are equal here
            assert got == [(p.offset + 1 + i, *r) for i, r in enumerate(want[p.offset : p.offset + size])]
    assert index.info(Page(2, 10)).first().asDict() == {"total_count": 203, "total_pages": 21, "page": 2, "page_size": 10}


def test_an_empty_listing_has_one_empty_page(spark, scratch):
    index = PageIndex.build(spark.createDataFrame([], "a long, b long"), order(), f"{scratch}/pages")
    assert index.page(Page(1, 10)).collect() == []
    assert index.info(Page(1, 10)).first().asDict() == {"total_count": 0, "total_pages": 1, "page": 1, "page_size": 10}


def test_a_page_reads_its_partitions_only(spark, scratch):
    df = spark.range(10_000).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"))
    index = PageIndex.build(df, order(), f"{scratch}/pages", 8)
    deep = index.page(Page(900, 10))
    plan = deep._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[([^\]]*)", plan)[1]
    assert "_part" in filters and "GreaterThanOrEqual(_place" in plan and "Exchange" not in plan
    read = deep.select(F.input_file_name().alias("f")).distinct().count()
    assert read <= 2


def test_sketches_of_days_merge(spark):
    n = 60_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 == 1, F.lit(None)).otherwise("cool").alias("city"),
        F.date_add(F.lit("2024-01-01"), (F.col("id") % 40).cast("int")).alias("day"),
        F.when(F.col("id") % 11 > 0, F.col("id") % 9_001).alias("user"),
    )
    days = distinct.daily_sketches(rows, ["city"], "day", "user")
    exact = {r["city"]: (r["n"], r["u"]) for r in rows.groupBy("city").agg(F.count("user").alias("n"), F.countDistinct("user").alias("u")).collect()}
    got = {r["city"]: r for r in distinct.merged(days, ["city"]).collect()}
    assert set(got) == set(exact) == {"hot", "cool", None}
    for city, (count, users) in exact.items():
        assert got[city]["n_rows"] == count
        assert abs(got[city]["distinct_estimate"] - users) <= 4 * distinct.STANDARD_ERROR * users + 1
    # A sum over days counts a user once a day; the union doesn't.
    assert distinct.merged(days, ["city", "day"]).agg(F.sum("distinct_estimate")).first()[0] > 2 * sum(u for _, u in exact.values())
    none = distinct.merged(distinct.daily_sketches(rows.limit(0), ["city"], "day", "user"), ["city"])
    assert none.collect() == []
