"""Per-restaurant review insights.

The reference loops over restaurants on the driver and runs one query per
restaurant. Here the whole job is one plan over *all* comments:

* E10 counts non-blank comments per restaurant *before* joining the
  restaurant table (partial aggregation absorbs a hot restaurant);
* ``number_reviews`` numbers a restaurant's comments on narrow rows (id and a
  hash of the text) and cuts them into requests of 30; a restaurant with very
  many comments is numbered in parts, so none is one task's work;
* E13 joins the texts to their requests and concatenates each request's;
* the scorer runs once per request, E14 parses its reply, and the requests of
  a restaurant are added up.

E12, the sample of the first 30 comments, is a query of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dinelens.functions.cleaning import non_blank, split_list
from dinelens.functions.replies import (
    INSIGHT_COUNTS,
    INSIGHT_REPLY_SCHEMA,
    INSIGHT_THEMES,
    insight_fields,
    insight_object,
    once,
    parsed_object,
)
from dinelens.functions.search import rx_search
from dinelens.operators.paging import Page, page_info, page_rows
from dinelens.operators.scoring import Scorer

# Job constants of the insight run.
REVIEWS_PER_REQUEST = 30
MIN_REVIEWS = 5
TOP_N_RESTAURANTS = 50

# Comments of one restaurant that are numbered together.
REVIEWS_PER_PART = 10_000

INSIGHT_COLUMNS = [
    "restaurant_id",
    "restaurant_name",
    "city",
    "review_count",
    "positive_count",
    "negative_count",
    "neutral_count",
    "top_negative_themes",
    "top_positive_themes",
    "summary",
]


def _commented(reviews: DataFrame) -> DataFrame:
    return reviews.filter(non_blank("comment")).select(
        F.col("restaurant_id").cast("string").alias("rid"), "review_id", "comment"
    )


def qualifying_restaurants(
    restaurants: DataFrame, reviews: DataFrame, min_reviews: int = MIN_REVIEWS
) -> DataFrame:
    """Restaurants with at least ``min_reviews`` non-blank comments and their
    count (unordered). Comments are counted per restaurant id first, so the
    join only sees one row per reviewed restaurant."""
    per_rid = _commented(reviews).groupBy("rid").agg(F.count("comment").alias("n"))
    s = restaurants.select(
        "restaurant_id",
        "restaurant_name",
        "city",
        F.col("restaurant_id").cast("string").alias("rid"),
    )
    return (
        s.join(per_rid, "rid")
        .groupBy("restaurant_id", "restaurant_name", "city")
        .agg(F.sum("n").alias("review_count"))
        .filter(F.col("review_count") >= F.lit(min_reviews))
    )


def review_volume(
    restaurants: DataFrame,
    reviews: DataFrame,
    min_reviews: int = MIN_REVIEWS,
    top_n: int | None = TOP_N_RESTAURANTS,
) -> DataFrame:
    """Restaurants with at least ``min_reviews`` non-blank comments,
    most reviewed first (ties by id), at most ``top_n`` (None = all).
    Ids are matched as text on both sides."""
    out = qualifying_restaurants(restaurants, reviews, min_reviews).orderBy(
        F.col("review_count").desc(), F.col("restaurant_id").asc_nulls_last()
    )
    return out.limit(top_n) if top_n else out


def pending_restaurants(candidates: DataFrame, insights: DataFrame | None) -> DataFrame:
    """Candidates whose id (as text) is not in the insight table."""
    if insights is None:
        return candidates
    done = insights.select(F.col("restaurant_id").cast("string").alias("_done_id"))
    return candidates.join(
        done, candidates["restaurant_id"].cast("string") == done["_done_id"], "left_anti"
    )


def review_sample(reviews: DataFrame, cap: int = REVIEWS_PER_REQUEST) -> DataFrame:
    """Up to ``cap`` non-blank comments per restaurant (lowest review
    ids, ties by text): ``restaurant_id`` (text), ``rn``, ``review_id``,
    ``comment``.

    ``row_number() <= cap`` runs as a partial ``WindowGroupLimit`` before the
    shuffle: a task sends at most ``cap`` comments of a restaurant.
    """
    w = Window.partitionBy("rid").orderBy(F.col("review_id").asc_nulls_last(), "comment")
    sample = _commented(reviews).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= F.lit(cap))
    return sample.select(F.col("rid").alias("restaurant_id"), "rn", "review_id", "comment")


def number_reviews(
    reviews: DataFrame,
    per_request: int = REVIEWS_PER_REQUEST,
    per_part: int = REVIEWS_PER_PART,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Every non-blank comment's request: ``rid, review_id, text_hash, request, rn``.

    ``rn`` counts 1, 2, .. within a request, by review id. A restaurant with
    more than ``per_part`` comments is cut by a hash of id and text into parts
    first, whatever its ids are; request numbers are distinct within a restaurant. The
    texts stay behind: only their hashes are shuffled and sorted.
    """
    ids = reviews.filter(non_blank("comment")).select(
        F.col("restaurant_id").cast("string").alias("rid"),
        "review_id",
        F.xxhash64("comment").alias("text_hash"),
        *carry,
    )
    sizes = ids.groupBy("rid").agg(F.ceil(F.count(F.lit(1)) / per_part).alias("parts"))
    # ``sizes`` has one row per restaurant; AQE splits a hot one's rows.
    parted = ids.join(sizes.withColumnRenamed("rid", "_rid"), F.col("rid").eqNullSafe(F.col("_rid"))).drop("_rid")
    parted = parted.withColumn("part", F.pmod(F.xxhash64("review_id", "text_hash"), F.col("parts")))
    w = Window.partitionBy("rid", "part").orderBy(F.col("review_id").asc_nulls_last(), "text_hash")
    numbered = parted.withColumn("at", F.row_number().over(w) - 1)
    chunk = F.floor(F.col("at") / per_request)
    return numbered.select(
        "rid",
        "review_id",
        "text_hash",
        (F.col("part") + F.col("parts") * chunk).cast("bigint").alias("request"),
        (F.col("at") % per_request + 1).cast("int").alias("rn"),
        *carry,
    )


def review_bundle(reviews: DataFrame, only: DataFrame | None = None, per_request: int = REVIEWS_PER_REQUEST) -> DataFrame:
    """One text per request, ``"1. first\\n2. second..."``, over all
    comments: ``restaurant_id, request, n_reviews, numbered_reviews``.

    ``only`` (a frame with a text ``restaurant_id``) limits the restaurants.
    Raw reviews have no key; a comment is found again by restaurant, id and
    text hash, and rows equal in all three share one text.
    """
    if only is not None:
        keys = only.select(F.col("restaurant_id").cast("string").alias("_only")).distinct()
        reviews = reviews.join(keys, F.col("restaurant_id").cast("string") == F.col("_only"), "left_semi")
    numbered = number_reviews(reviews, per_request)
    texts = reviews.filter(non_blank("comment")).select(
        F.col("restaurant_id").cast("string").alias("trid"),
        F.col("review_id").alias("tid"),
        F.xxhash64("comment").alias("thash"),
        "comment",
    )
    texts = texts.dropDuplicates(["trid", "tid", "thash"])
    same = (
        F.col("rid").eqNullSafe(F.col("trid"))
        & F.col("review_id").eqNullSafe(F.col("tid"))
        & (F.col("text_hash") == F.col("thash"))
    )
    rows = numbered.join(texts, same)
    lines = F.transform(
        F.sort_array(F.collect_list(F.struct("rn", "comment"))),
        lambda x: F.concat(x["rn"].cast("string"), F.lit(". "), x["comment"]),
    )
    return rows.groupBy(F.col("rid").alias("restaurant_id"), "request").agg(
        F.count(F.lit(1)).cast("int").alias("n_reviews"),
        F.array_join(lines, "\n").alias("numbered_reviews"),
    )


def request_text(template: str, **columns: str):
    """A prompt: ``template`` with every ``{name}`` replaced by the column given for it."""
    out = F.lit(template)
    for name, column in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(F.col(column).cast("string"), F.lit("")))
    return out


# The caller's wording goes here; the reply must be the JSON object of E14.
DEFAULT_TEMPLATE = "{name}: {n} reviews\n{reviews}"


def _parsed(replies: DataFrame, response_col: str, max_themes: int | None) -> DataFrame:
    keep = [c for c in replies.columns if c != response_col]
    parsed = parsed_object(replies, keep, response_col, insight_object, INSIGHT_REPLY_SCHEMA)
    return once(parsed, keep, insight_fields(max_themes))


def parse_insight_reply(replies: DataFrame, response_col: str = "response", max_themes: int | None = None) -> DataFrame:
    """Reply -> ``ok`` and the insight fields; theme lists as text,
    with at most ``max_themes`` entries (default: all)."""
    out = _parsed(replies, response_col, max_themes)
    return out.select(*[F.array_join(c, ", ").alias(c) if c in INSIGHT_THEMES else F.col(c) for c in out.columns])


def insights_build(
    restaurants: DataFrame,
    reviews: DataFrame,
    scorer: Scorer,
    done: DataFrame | None = None,
    min_reviews: int = MIN_REVIEWS,
    top_n: int | None = None,
    per_request: int = REVIEWS_PER_REQUEST,
    max_themes: int | None = None,
    template: str = DEFAULT_TEMPLATE,
) -> DataFrame:
    """Insight rows for restaurants not analysed yet, with ``ok``.

    All comments of a restaurant are sent, ``per_request`` at a time. Its
    counts are the sums over the requests, its themes those of all replies,
    the most frequent first (ties by text; at most ``max_themes``), its
    summary that of the first request that has one. One failed request makes
    the restaurant a failure, to be sent again by the next run.
    """
    if top_n:
        chosen = review_volume(restaurants, reviews, min_reviews, top_n)
    else:  # every qualifying restaurant: no ordering needed
        chosen = qualifying_restaurants(restaurants, reviews, min_reviews)
    cands = pending_restaurants(chosen, done)
    cands = cands.select(F.col("restaurant_id").cast("string").alias("restaurant_id"), "restaurant_name", "city")
    requests = cands.join(review_bundle(reviews, only=cands, per_request=per_request), "restaurant_id")
    requests = requests.withColumn(
        "prompt", request_text(template, name="restaurant_name", n="n_reviews", reviews="numbered_reviews")
    ).withColumn("request_id", F.concat_ws("/", "restaurant_id", "request"))
    scored = scorer.score(requests, "request_id", "prompt")
    of = ["restaurant_id", "restaurant_name", "city"]
    parsed = _parsed(scored.select(*of, "request", "n_reviews", "response"), "response", max_themes)
    return _per_restaurant(parsed, of, max_themes)


def _per_restaurant(parsed: DataFrame, of: list[str], max_themes: int | None) -> DataFrame:
    """Add up the requests of each restaurant.

    A request becomes one row with its numbers and one for each theme, so
    that one grouped aggregation, combined before the shuffle, counts themes
    too: the parsed replies are read once, and a restaurant's themes meet
    only after equal ones have been counted.
    """
    none = F.lit(None)
    numbers = F.struct(
        none.cast("string").alias("kind"),
        none.cast("string").alias("theme"),
        F.col("n_reviews").alias("review_count"),
        *[F.col(c).alias(c) for c in INSIGHT_COUNTS],
        F.col("ok").alias("ok"),
        F.when(F.col("ok"), F.struct("request", "summary")).alias("first"),
    )

    def of_kind(kind: str):
        return F.transform(
            F.when(F.col("ok"), F.col(kind)),
            lambda t: F.struct(
                F.lit(kind).alias("kind"),
                t.alias("theme"),
                none.cast("int").alias("review_count"),
                *[none.cast("int").alias(c) for c in INSIGHT_COUNTS],
                none.cast("boolean").alias("ok"),
                none.cast("struct<request:bigint,summary:string>").alias("first"),
            ),
        )

    empty = F.slice(F.array(numbers), 1, 0)
    rows = F.concat(F.array(numbers), *[F.coalesce(of_kind(k), empty) for k in INSIGHT_THEMES])
    per_theme = (
        parsed.select(*of, F.inline(rows))
        .groupBy(*of, "kind", "theme")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("review_count").alias("review_count"),
            *[F.sum(c).alias(c) for c in INSIGHT_COUNTS],
            F.bool_and("ok").alias("ok"),
            F.min("first").alias("first"),
        )
    )

    def themes(kind: str):
        found = F.collect_list(F.when((F.col("kind") == kind) & F.col("theme").isNotNull(), F.struct((-F.col("n")).alias("n"), "theme")))
        names = F.transform(F.sort_array(found), lambda x: x["theme"])
        names = F.slice(names, 1, max_themes) if max_themes else names
        return F.when(F.bool_and("ok"), F.array_join(names, ", ")).alias(kind)

    return per_theme.groupBy(*of).agg(
        F.sum("review_count").cast("int").alias("review_count"),
        *[F.when(F.bool_and("ok"), F.sum(c)).cast("int").alias(c) for c in INSIGHT_COUNTS],
        *[themes(k) for k in INSIGHT_THEMES],
        F.when(F.bool_and("ok"), F.min("first")["summary"]).alias("summary"),
        F.coalesce(F.bool_and("ok"), F.lit(False)).alias("ok"),
    )


def insight_rows(built: DataFrame, with_timestamp: bool = True) -> DataFrame:
    ok = built.filter(F.col("ok")).select(*INSIGHT_COLUMNS)
    return ok.withColumn("analyzed_at", F.current_timestamp()) if with_timestamp else ok


def insights_report(built: DataFrame) -> DataFrame:
    return built.agg(
        F.count_if(F.col("ok")).alias("analyzed"),
        F.count_if(~F.col("ok")).alias("failed"),
    )


def insights_listing(insights: DataFrame, search: str | None = None):
    """E16 rows and order: most reviewed first, optional name search."""
    rows = insights.select(*INSIGHT_COLUMNS[:7])
    if search:
        rows = rows.filter(rx_search("restaurant_name", search))
    order = [
        F.col("review_count").desc_nulls_last(),
        F.col("restaurant_name").asc_nulls_last(),
        F.col("restaurant_id").asc_nulls_last(),
    ]
    return rows, order


def insights_list(insights: DataFrame, page: Page, search: str | None = None) -> DataFrame:
    rows, order = insights_listing(insights, search)
    return page_rows(rows, order, page)


def insights_list_info(insights: DataFrame, page: Page, search: str | None = None) -> DataFrame:
    rows, _ = insights_listing(insights, search)
    return page_info(rows, page)


def insight_detail(insights: DataFrame, restaurant_id) -> DataFrame:
    """One restaurant's insight; theme texts split into lists."""
    return insights.filter(F.col("restaurant_id") == F.lit(str(restaurant_id))).select(
        *INSIGHT_COLUMNS[:7],
        split_list("top_negative_themes").alias("negative_themes"),
        split_list("top_positive_themes").alias("positive_themes"),
        "summary",
    )
