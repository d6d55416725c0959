"""Registered queries: key -> ``fn(Warehouse) -> DataFrame``.

One key per job/query of the inventory, with the parameter values of
FIXTURES.md section 5 (real city ``EUROPE``, min revenue 30,000,000, min
rating 4.1, search ``chant [1-4]`` / ``the``, page 2 of size 3, page 1 of
size 500 clamped to 100, restaurant ``8``). Timestamps are left out of the
returned frames.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dinelens.functions.places import real_city
from dinelens.operators import adhoc, distinct, explorer, insights, learned, revenue, reviews, staging, themes
from dinelens.operators.page_index import PageIndex
from dinelens.operators.paging import Page, page_params
from dinelens.operators.scoring import RecordedReplies, RuleScorer
from dinelens.operators.text_index import TextIndex
from dinelens.plans import incremental
from dinelens.plans.warehouse import Warehouse
from dinelens.session import scratch_path
from dinelens.sources import catalog, ledger, quarantine

CITY = "EUROPE"
MIN_REVENUE = 30_000_000
MIN_RATING = 4.1
NAME_SEARCH = "chant [1-4]"
REVIEW_SEARCH = "the"
RARE_SEARCHES = ("thorr[a-z]+nd", "ünge(n|r)? |AN[DT] T?HE[ .]", "a[qx]u")
RESTAURANT_ID = "8"
PAGE_2_OF_3 = page_params(2, 3)
PAGE_WIDE = page_params(1, 500)  # clamped to 100
GUARDED_SQL_TEXT = (
    "SELECT city, ROUND(SUM(total_revenue), 2) AS revenue, SUM(total_orders) AS orders "
    "FROM mart_orders GROUP BY city ORDER BY revenue DESC, city ASC"
)

Query = Callable[[Warehouse], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        if name in REGISTRY:
            raise KeyError(f"duplicate query key {name}")
        REGISTRY[name] = fn
        return fn

    return deco


def _add(name: str, fn: Query) -> None:
    register(name)(fn)


def _raw_reviews(w: Warehouse) -> DataFrame:
    return w.raw_reviews()


def _review_texts(w: Warehouse) -> DataFrame:
    """``review_id, comment`` straight from the text table (no rating join)."""
    return w.raw_reviews(["review_id", "comment"])


def _commented_reviews(w: Warehouse) -> DataFrame:
    """The review columns the insight job reads (no rating join)."""
    return w.raw_reviews(["review_id", "restaurant_id", "comment"])


# ------------------------------------------------------------ A: sources
_add("scan_raw_restaurants", lambda w: w.raw_restaurants)
_add("scan_raw_orders", lambda w: w.raw_orders())
_add("scan_raw_reviews", lambda w: w.raw_reviews())
_add("table_counts", lambda w: catalog.table_counts(_count_tables(w)))
_add("export_json", lambda w: explorer.export_json(revenue.cities_ranked(w.mart_orders)))


_add("export_json_parsed", lambda w: _parsed_json(revenue.cities_ranked(w.mart_orders)))
_add("ingest_csv_lines", lambda w: _csv_lines(w.raw_restaurants))
_add("append_new_rows", lambda w: _append_new_rows(w))
_add("append_new_rows_nulls", lambda w: _append_new_rows_nulls(w))
_add("append_ledger", lambda w: _append_ledger(w))
_add("ingest_quarantine", lambda w: _quarantine(w).rows)
_add("ingest_rejects", lambda w: _reject_lines(w))
_add("source_choice", lambda w: _source_choice(w))


def _parsed_json(df: DataFrame) -> DataFrame:
    """A6 read back, so that numbers and not their spelling are compared."""
    row = F.from_json("json", df.schema)
    return explorer.export_json(df).select(row.alias("r")).select("r.*")


def _csv_lines(df: DataFrame) -> DataFrame:
    """A1 over the table's rows as CSV lines."""
    lines = df.select(F.to_csv(F.struct(*df.columns), catalog.csv_options()).alias("line"))
    return catalog.parse_csv_lines(lines, "line", df.schema)


def _append_new_rows(w: Warehouse) -> DataFrame:
    """A5: every id twice, those divisible by three in the table already."""
    ids = w.raw_reviews(["review_id"])
    rows = ids.select(F.floor(F.col("review_id") / 2).alias("review_id"))
    return catalog.new_rows(rows, ids.filter("review_id % 3 = 0"), ["review_id"])


def _append_new_rows_nulls(w: Warehouse) -> DataFrame:
    """A5 with ids that are missing, in the rows and in the table."""
    ids = w.raw_reviews(["review_id"])
    rows = ids.select(F.when(F.col("review_id") % 5 != 0, F.floor(F.col("review_id") / 2)).alias("review_id"))
    table = ids.filter("review_id % 3 = 0").select(F.when(F.col("review_id") != 0, F.col("review_id")).alias("review_id"))
    return catalog.new_rows(rows, table, ["review_id"])


def _append_ledger(w: Warehouse) -> DataFrame:
    """A5 in batches: overlapping ids with NULLs, a crash before the record, and every batch run twice."""
    target = scratch_path(w.spark, "ledger")
    ids = w.raw_reviews(["review_id"])
    key = F.when(F.col("review_id") % 7 != 3, F.floor(F.col("review_id") / 2)).alias("review_id")
    rounds = [ids.filter(F.col("review_id") % 3 == r).select(key) for r in range(3)]
    ledger.write_batch(rounds[0], target, ["review_id"], 0)
    for _ in range(2):
        for number, rows in enumerate(rounds):
            ledger.append_batch(rows, target, "review_id", number)
    return ledger.read_table(w.spark, target, rounds[0].schema)


def _csv_files(w: Warehouse) -> tuple[str, DataFrame]:
    """The restaurants as CSV files: two headers, bad ids, and records with too many or too few fields."""
    path = scratch_path(w.spark, "csv")
    k = F.col("id").cast("bigint")
    given = w.raw_restaurants.select("*", k.alias("k")).withColumn("id", F.when(k % 10 == 1, F.concat(F.lit("x"), "id")).otherwise(F.col("id")))
    orders = (["id", "name", "city", "rating", "cost", "cuisine"], ["note", "cuisine", "rating", "city", "name", "id", "cost"])
    for place, names in enumerate(orders):
        mine = given.filter(F.pmod("k", F.lit(2)) == place).withColumn("note", F.lit("n, n"))
        line = F.to_csv(F.struct(*names), catalog.csv_options())
        line = F.when(F.col("k") % 10 == 2, F.concat(line, F.lit(",more"))).when(F.col("k") % 10 == 3, F.lit("alone")).otherwise(line)
        lines = mine.select("k", line.alias("value")).unionByName(w.spark.createDataFrame([(-1, ",".join(names))], "k long, value string"))
        lines.coalesce(1).sortWithinPartitions("k").select("value").write.text(f"{path}/{place}")
    return f"{path}/*", given


QUARANTINE_SCHEMA = "id bigint, name string, city string, rating string, cost string, cuisine string"


def _quarantine(w: Warehouse) -> quarantine.Ingest:
    path, given = _csv_files(w)
    return quarantine.ingest(w.spark, path, T.StructType.fromDDL(QUARANTINE_SCHEMA))


def _reject_lines(w: Warehouse) -> DataFrame:
    """The rejects, by their file's folder and their number in it."""
    folder = F.regexp_extract("file", r"/(\d)/[^/]*$", 1).cast("int").alias("folder")
    return _quarantine(w).rejects.select(folder, "record", "reason")


def _city_month_users(w: Warehouse) -> DataFrame:
    """Users of a real city per month from stored daily sketches, held against the exact count."""
    orders = staging.stg_orders(w.raw_orders(["order_id", "r_id", "user_id", "order_date"]))
    places = w.stg_restaurants.select("restaurant_id", real_city("city").alias("city"))
    rows = orders.join(places, "restaurant_id").select("city", "order_date", "user_id")
    path = scratch_path(w.spark, "user-sketches")
    distinct.daily_sketches(rows, ["city"], "order_date", "user_id").write.parquet(path)
    month = F.date_trunc("month", "order_date").cast("date").alias("month")
    found = distinct.merged(w.spark.read.parquet(path), ["city", month])
    exact = rows.groupBy("city", month).agg(F.countDistinct("user_id").alias("users"))
    both = found.withColumnsRenamed({"city": "_city", "month": "_month"}).join(exact, F.col("city").eqNullSafe(F.col("_city")) & F.col("month").eqNullSafe(F.col("_month")))
    return both.select("city", "month", F.col("n_rows").alias("orders"), "users", distinct.within(F.col("distinct_estimate"), F.col("users")).alias("estimate_holds"))


def _order_days(w: Warehouse) -> DataFrame:
    """The stored days after a load, a load of late orders, and the second one once more."""
    path = scratch_path(w.spark, "order-days")
    orders = staging.stg_orders(w.raw_orders(["order_id", "r_id", "order_date", "sales_amount"]))
    late = F.col("order_id") % 5 == 0
    incremental.load_orders(orders.filter(~late), path, "first")
    for _ in range(2):
        incremental.load_orders(orders.filter(late), path, "late")
    return incremental.read_days(w.spark, path)


def _source_choice(w: Warehouse) -> DataFrame:
    """The labels are there, so they count as enriched; the other table is not."""
    raw = w.raw_reviews(["review_id"])
    parts = []
    for name in ("labels", "gold_review_sentiments"):
        source, rows = catalog.enriched_or_raw(w.spark, f"{w.base.root}/{name}.parquet", raw)
        parts.append(rows.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("wanted"), F.lit(source).alias("source"), "row_count"))
    return parts[0].unionByName(parts[1])


def _count_tables(w: Warehouse) -> dict[str, DataFrame]:
    # stg_orders is counted on its mart columns: the user_id lookup it
    # leaves out is a 1:1 left join (o_orderkey is the key of orders), so
    # the count is the same without a shuffle of every line-item key.
    return {
        "stg_restaurants": w.stg_restaurants,
        "stg_orders": w.orders_for_marts,
        "mart_orders": w.mart_orders,
        "gold_review_sentiments": w.gold_review_sentiments,
    }


# ------------------------------------------------------- B: staging/marts
_add("stg_restaurants", lambda w: w.stg_restaurants)
_add("stg_restaurants_typed", lambda w: w.stg_restaurants_typed)
_add("stg_orders", lambda w: w.stg_orders)
_add("mart_orders", lambda w: w.mart_orders)
_add("restaurant_rejects", lambda w: staging.restaurant_rejects(w.raw_restaurants))
_add(
    "order_rejects",
    # the columns it checks; the restaurant_city lookup (1:1) is left out
    lambda w: staging.order_rejects(
        w.raw_orders(["order_id", "r_id", "user_id", "order_date", "order_status", "sales_amount"])
    ),
)
# the same counts over values of which some are bad
_add("restaurant_rejects_lenient", lambda w: staging.restaurant_rejects(_bad_restaurants(w.raw_restaurants)))
_add("stg_restaurants_lenient", lambda w: staging.stg_restaurants(_bad_restaurants(w.raw_restaurants), strict=False))
_add("order_rejects_lenient", lambda w: staging.order_rejects(_bad_orders(w)))


def _bad_restaurants(raw: DataFrame) -> DataFrame:
    k = F.col("id").cast("bigint")
    return raw.withColumns(
        {
            "id": F.when(k % 10 == 1, F.concat(F.lit("x"), "id")).otherwise(F.col("id")),
            "rating": F.when(k % 10 == 2, F.lit("new")).otherwise(F.col("rating")),
            "cost": F.when(k % 10 == 3, F.lit("₹ many")).otherwise(F.col("cost")),
        }
    )


def _bad_orders(w: Warehouse) -> DataFrame:
    raw = w.raw_orders(["order_id", "r_id", "order_date", "sales_amount"])
    k = F.col("order_id").cast("bigint")
    return raw.withColumns(
        {
            "order_id": F.when(k % 100 == 11, F.lit("?")).otherwise(F.col("order_id")),
            "order_date": F.when(k % 100 == 12, F.lit("2024-13-45")).otherwise(F.col("order_date")),
            "sales_amount": F.when(k % 100 == 13, F.lit("1,5")).otherwise(F.col("sales_amount").cast("string")),
        }
    )


# the same marts from stored days: two loads, one of them late and repeated
_add("mart_orders_incremental", lambda w: incremental.mart_orders(_order_days(w), w.stg_restaurants))
_add("city_month_users_sketched", lambda w: _city_month_users(w))
_add("mart_city_order_stats_incremental", lambda w: incremental.mart_city_order_stats(_order_days(w), w.stg_restaurants))
_add("mart_city_restaurant_stats", lambda w: w.mart_city_restaurant_stats)
_add("mart_city_order_stats", lambda w: w.mart_city_order_stats)

# ------------------------------------------------------------ C: revenue
_add("kpis", lambda w: revenue.kpis(w.mart_orders, w.stg_restaurants))
_add("kpis_by_scope", lambda w: revenue.kpis_by_scope(w.mart_orders, w.stg_restaurants))
_add("kpis_by_scope_city", lambda w: revenue.kpis_by_scope(w.mart_orders, w.stg_restaurants, CITY))
_add("top_city_rows", lambda w: revenue.top_city_rows(w.mart_orders))
_add("top_restaurants", lambda w: revenue.top_restaurants(w.mart_orders))
_add("top_restaurants_city", lambda w: revenue.top_restaurants(w.mart_orders, CITY, 10))
_add("revenue_by_city", lambda w: revenue.revenue_by_city(w.mart_orders))
_add("revenue_share_top_cities", lambda w: revenue.revenue_share_top_cities(w.mart_orders))
_add("orders_vs_revenue", lambda w: revenue.orders_vs_revenue(w.mart_orders))
_add("restaurant_detail", lambda w: revenue.restaurant_detail(w.mart_orders))


def _trend_orders(w: Warehouse, city: str | None = None) -> DataFrame:
    cols = ["order_date", "sales_amount"] + (["r_id"] if city else [])
    return w.raw_orders(cols)


def _q9(w):
    return revenue.trend(_trend_orders(w), "monthly", newest_first=True, limit=20)


def _q10(w):
    return revenue.trend(_trend_orders(w), "yearly", newest_first=True, limit=20)


def _q11(w, period="monthly", city=None):
    return revenue.trend(_trend_orders(w, city), period, newest_first=False, limit=None, city=city, restaurants=w.raw_restaurants)


_add("trend_monthly", _q9)
_add("trend_yearly", _q10)
_add("trend_scoped", lambda w: _q11(w))
_add("trend_scoped_city", lambda w: _q11(w, "monthly", CITY))
_add("trend_scoped_yearly", lambda w: _q11(w, "yearly"))
_add("aov_trend", lambda w: revenue.aov_trend(_trend_orders(w)))
_add("aov_trend_city", lambda w: revenue.aov_trend(_trend_orders(w, CITY), city=CITY, restaurants=w.raw_restaurants))
_add("trend_summary_monthly", lambda w: revenue.trend_summary(_q9(w)))
_add("trend_summary_yearly", lambda w: revenue.trend_summary(_q10(w)))
_add("trend_summary_scoped_city", lambda w: revenue.trend_summary(_q11(w, "monthly", CITY)))
_add(
    "trend_summary_all_time",
    lambda w: revenue.trend_summary(revenue.restaurants_filtered(w.mart_orders, MIN_REVENUE)),
)
_add(
    "restaurants_filtered",
    lambda w: revenue.restaurants_filtered(w.mart_orders, MIN_REVENUE, "revenue", 20),
)
_add(
    "restaurants_filtered_by_city",
    lambda w: revenue.restaurants_filtered(w.mart_orders, MIN_REVENUE, "city", 20),
)
_add(
    "restaurants_filtered_by_orders",
    lambda w: revenue.restaurants_filtered(w.mart_orders, 0, "orders", 1000),
)
_add("cities_ranked", lambda w: revenue.cities_ranked(w.mart_orders))
_add("breakdown_city", lambda w: revenue.breakdown_city(w.mart_orders))
_add("breakdown_area", lambda w: revenue.breakdown_area(w.mart_orders, CITY))
_add("cuisine_revenue", lambda w: revenue.cuisine_revenue(w.mart_orders, w.stg_restaurants))
_add(
    "cuisine_revenue_city",
    lambda w: revenue.cuisine_revenue(w.mart_orders, w.stg_restaurants, CITY),
)
_add("rating_distribution", lambda w: revenue.rating_distribution(w.stg_restaurants))
_add("rating_distribution_city", lambda w: revenue.rating_distribution(w.stg_restaurants, CITY))
_add("performance_page", lambda w: revenue.performance_page(w.mart_orders, PAGE_2_OF_3))
_add(
    "performance_page_city",
    lambda w: revenue.performance_page(w.mart_orders, PAGE_WIDE, CITY),
)
_add(
    "performance_page_by_name",
    lambda w: revenue.performance_page(w.mart_orders, PAGE_2_OF_3, sort="name"),
)
# behind a row that is given by its values; it need not exist
_add(
    "performance_after",
    lambda w: revenue.performance_after(w.mart_orders, (float(MIN_REVENUE), "Merchant 3", None), 5),
)
_add(
    "performance_page_by_orders",
    lambda w: revenue.performance_page(w.mart_orders, PAGE_2_OF_3, sort="orders"),
)

# ------------------------------------------------------------ D: explorer


def _rest_listing(w, **kw):
    return explorer.restaurants_listing(w.stg_restaurants, **kw)


_add("explore_restaurants", lambda w: explorer.explore_restaurants(w.stg_restaurants, PAGE_2_OF_3))
_add(
    "explore_restaurants_search",
    lambda w: explorer.explore_restaurants(w.stg_restaurants, PAGE_WIDE, search=NAME_SEARCH),
)
_add(
    "explore_restaurants_rating",
    lambda w: explorer.explore_restaurants(w.stg_restaurants, PAGE_WIDE, min_rating=MIN_RATING),
)
_add(
    "explore_restaurants_rating0",
    lambda w: explorer.explore_restaurants(w.stg_restaurants, PAGE_WIDE, min_rating=0.0),
)
_add(
    "explore_restaurants_city",
    lambda w: explorer.explore_restaurants(w.stg_restaurants, PAGE_WIDE, city=CITY),
)
_add(
    "explore_restaurants_head",
    lambda w: _rest_listing(w, search=NAME_SEARCH).head(500).drop("restaurant_id"),
)
_add(
    "explore_restaurants_info",
    lambda w: _rest_listing(w, search=NAME_SEARCH, min_rating=MIN_RATING).info(PAGE_2_OF_3),
)
_add("explore_orders", lambda w: explorer.explore_orders(w.mart_orders, PAGE_2_OF_3))
_add(
    "explore_orders_filtered",
    lambda w: explorer.explore_orders(w.mart_orders, PAGE_WIDE, min_revenue=MIN_REVENUE),
)
_add(
    "explore_orders_search",
    lambda w: explorer.explore_orders(w.mart_orders, PAGE_WIDE, search=NAME_SEARCH, min_orders=1),
)
_add(
    "explore_orders_cities",
    lambda w: explorer.explore_orders(
        w.mart_orders, PAGE_WIDE, cities=["ARGENTINA, AMERICA", "EUROPE", "FRANCE, EUROPE"]
    ),
)
_add("explore_orders_city", lambda w: explorer.explore_orders(w.mart_orders, PAGE_WIDE, city=CITY))
_add(
    "explore_orders_info",
    lambda w: explorer.orders_listing(w.mart_orders, min_revenue=MIN_REVENUE).info(PAGE_2_OF_3),
)


def _gold_reviews(w: Warehouse, search: str | None = None):
    return explorer.reviews_listing(
        w.gold_review_sentiments, None, search, texts=w.gold_review_texts
    )


_add(
    "explore_reviews",
    lambda w: _gold_reviews(w).page(PAGE_2_OF_3),
)
_add(
    "explore_reviews_search",
    lambda w: _gold_reviews(w, REVIEW_SEARCH).page(PAGE_WIDE),
)
_add(
    "explore_reviews_raw",
    lambda w: explorer.reviews_listing(None, _raw_reviews(w), REVIEW_SEARCH).page(PAGE_WIDE),
)
_add(
    "explore_reviews_info",
    lambda w: _gold_reviews(w, REVIEW_SEARCH).info(PAGE_2_OF_3),
)


def _index(rows: DataFrame, text: str) -> TextIndex:
    """An index over the rows, written for this run."""
    return TextIndex.build(rows, text, scratch_path(rows.sparkSession, "text-index"))


# the same searches as above, through an index
_add(
    "explore_reviews_search_index",
    lambda w: explorer.reviews_listing(
        w.gold_review_sentiments, None, REVIEW_SEARCH, index=_index(w.gold_review_sentiments, "original_text")
    ).page(PAGE_WIDE),
)
_add(
    "explore_restaurants_search_index",
    lambda w: explorer.explore_restaurants(
        w.stg_restaurants, PAGE_WIDE, search=NAME_SEARCH, index=_index(w.stg_restaurants, "restaurant_name")
    ),
)
_add(
    "explore_orders_search_index",
    lambda w: explorer.explore_orders(
        w.mart_orders, PAGE_WIDE, search=NAME_SEARCH, min_orders=1, index=_index(w.mart_orders, "restaurant_name")
    ),
)
# whole results of a rare pattern, of alternatives, and of one that no trigram can narrow
_add("review_matches_index", lambda w: _matches(w, RARE_SEARCHES))


def _matches(w: Warehouse, patterns: tuple[str, ...]) -> DataFrame:
    index = _index(w.gold_review_texts, "original_text")
    parts = [index.search(p).select(F.lit(p).alias("pattern"), "review_id") for p in patterns]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ------------------------------------------------- D4: pages at any depth
ANY_PAGES = (Page(1, 7), Page(3, 7), Page(20, 7), Page(1_000, 7))  # the last lies beyond small tables' end


def _pages(index: PageIndex) -> DataFrame:
    out = [index.page(p).select(F.lit(p.page).alias("page"), "*") for p in ANY_PAGES]
    return reduce(DataFrame.unionByName, out)


def _orders_by_amount(w: Warehouse) -> PageIndex:
    rows = staging.stg_orders(w.raw_orders(["order_id", "r_id", "order_date", "sales_amount"]))
    rows = rows.select("order_id", "restaurant_id", "order_date", "order_amount")
    order = [F.col("order_amount").desc_nulls_last(), F.col("order_date").asc_nulls_last(), F.col("restaurant_id").asc_nulls_last(), F.col("order_id").asc_nulls_last()]
    return PageIndex.build(rows, order, scratch_path(w.spark, "page-index"))


def _marts_by_revenue(w: Warehouse) -> PageIndex:
    listing = explorer.orders_listing(w.mart_orders)
    return PageIndex.build(listing.rows, listing.order, scratch_path(w.spark, "page-index"))


_add("order_pages_index", lambda w: _pages(_orders_by_amount(w)))
_add("explore_orders_pages_index", lambda w: _pages(_marts_by_revenue(w)))
_add("explore_orders_pages_index_info", lambda w: _marts_by_revenue(w).info(PAGE_2_OF_3))

_add("distinct_cities", lambda w: explorer.distinct_cities(w.mart_orders))
_add("distinct_real_cities", lambda w: explorer.distinct_real_cities(w.mart_orders))

# ------------------------------------------------------------- E: reviews
_add("sentiment_counts", lambda w: reviews.sentiment_counts(w.gold_review_sentiments))
_add(
    "sentiment_summary",
    lambda w: reviews.sentiment_summary(w.gold_review_sentiments, w.raw_reviews(["review_id"])),
)
_add(
    "sentiment_summary_raw",
    lambda w: reviews.sentiment_summary(None, w.raw_reviews(["review_id"])),
)
_add(
    "reviews_fallback",
    lambda w: explorer.reviews_fallback(_raw_reviews(w)),
)
_add(
    "sample_reviews",
    lambda w: reviews.sample_reviews(w.gold_review_sentiments, texts=w.gold_review_texts),
)
_add("top_topics", lambda w: reviews.top_topics(w.gold_review_sentiments, 15))
_add("topic_counts", lambda w: reviews.topic_counts(w.gold_review_sentiments))
_add("enrich_candidates", lambda w: reviews.enrich_candidates(_review_texts(w)))


def _first_batch_done(w: Warehouse) -> DataFrame:
    # The scenario: an earlier run took one batch of 100.
    first = reviews.enrich_reviews(_review_texts(w), w.review_scorer, batch_size=reviews.ENRICH_BATCH)
    return reviews.sentiment_rows(first, with_timestamp=False)


_add(
    "enrich_candidates_resume",
    lambda w: reviews.enrich_candidates(_review_texts(w), done=_first_batch_done(w)),
)
_add(
    "enrich_candidates_batch",
    lambda w: reviews.enrich_candidates(_review_texts(w), batch_size=reviews.ENRICH_BATCH),
)
_add("parse_review_reply", lambda w: reviews.parse_review_reply(w.review_responses))
_add("enrich_reviews", lambda w: w.review_enrichment)
_add("enrich_report", lambda w: reviews.enrich_report(w.review_enrichment))
_add("enrich_reviews_rules", lambda w: reviews.enrich_reviews(_review_texts(w), RuleScorer()))
def _learned(w: Warehouse) -> learned.SentimentModel:
    return learned.train(w.raw_reviews(["comment", "rating"]))


_add("enrich_reviews_learned", lambda w: reviews.enrich_reviews(_review_texts(w), learned.LearnedScorer(_learned(w))))
_add("learned_held_out", lambda w: learned.held_out(w.raw_reviews(["comment", "rating"]), _learned(w)))
_add(
    "review_volume",
    lambda w: insights.review_volume(w.stg_restaurants, _commented_reviews(w), 5, 50),
)
_add(
    "review_volume_all",
    lambda w: insights.review_volume(w.stg_restaurants, _commented_reviews(w), 5, None),
)


def _pending(w: Warehouse) -> DataFrame:
    vol = insights.qualifying_restaurants(w.stg_restaurants, _commented_reviews(w), 5)
    # The scenario: an earlier run has analysed the restaurants with an even id.
    even = w.stg_restaurants.filter(F.col("restaurant_id") % 2 == 0)
    first_run = insights.insights_build(even, _commented_reviews(w), RecordedReplies(w.insight_responses))
    return insights.pending_restaurants(vol, insights.insight_rows(first_run, False))


_add("pending_restaurants", _pending)
_add("review_sample", lambda w: insights.review_sample(_commented_reviews(w), 30))
_add("review_bundle", lambda w: insights.review_bundle(_commented_reviews(w)))
_add("parse_insight_reply", lambda w: insights.parse_insight_reply(w.insight_responses, max_themes=4))
_add("restaurant_themes", lambda w: themes.restaurant_themes(w.stg_restaurants, _commented_reviews(w)))
_add("insights_build", lambda w: w.insight_build)
_add("insights_report", lambda w: insights.insights_report(w.insight_build))
_add("insights_list", lambda w: insights.insights_list(w.gold_restaurant_insights, page_params(1, None, 20)))
_add(
    "insights_list_search",
    lambda w: insights.insights_list(w.gold_restaurant_insights, PAGE_WIDE, NAME_SEARCH),
)
_add(
    "insights_list_info",
    lambda w: insights.insights_list_info(w.gold_restaurant_insights, page_params(1, None, 20)),
)
_add("insight_detail", lambda w: insights.insight_detail(w.gold_restaurant_insights, RESTAURANT_ID))

# ---------------------------------------------------------- G: ad-hoc SQL


def _guarded(w: Warehouse) -> DataFrame:
    res = adhoc.guarded_sql(w.spark, GUARDED_SQL_TEXT, w.views())
    if not res.ok:
        raise RuntimeError(res.error)
    return res.frame


_add("guarded_sql", _guarded)
_add("ask_city_totals", lambda w: adhoc.ask_city_totals(w.mart_orders, w.stg_restaurants, CITY))
_add("ask_negative_topic", lambda w: reviews.negative_topic_count(w.gold_review_sentiments))
_add("ask_top_rated_cities", lambda w: adhoc.ask_top_rated_cities(w.stg_restaurants))
_add("ask_top_cities", lambda w: adhoc.ask_top_cities(w.mart_orders))
_add("ask_restaurant_count", lambda w: adhoc.ask_restaurant_count(w.stg_restaurants))
_add("ask_avg_order_value", lambda w: adhoc.ask_avg_order_value(w.mart_orders))


def queries() -> dict[str, Callable]:
    """Callables ``(spark, sf_dir) -> DataFrame`` for the driver."""

    def bind(fn: Query):
        return lambda spark, sf_dir: fn(Warehouse.shared(spark, sf_dir))

    return {name: bind(fn) for name, fn in REGISTRY.items()}


__all__ = ["REGISTRY", "queries"]
