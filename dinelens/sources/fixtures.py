"""Adapters from the driver's TPC-H-like tables to the raw food-order tables.

A supplier plays a restaurant, a line item an order, a document a review
(see FIXTURES.md for the same mapping as SQL). Each adapter only joins in
the tables its requested columns need: ``o_orderkey`` is the primary key
of ``orders``, ``s_suppkey`` of ``supplier`` and ``doc_id`` of ``labels``,
so their left joins are 1:1 lookups and leaving one out when its column is
not wanted does not change the rows.

The joins are left to Catalyst: ``nation`` and ``region`` are tiny and get
broadcast by the planner's own size check; the supplier lookup is broadcast
while it is small and becomes a sort-merge join (with AQE skew splitting)
once it is not.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinelens.operators.insights import number_reviews
from dinelens.operators.scoring import DerivedReplies
from dinelens.sources.driver import BaseTables

RAW_RESTAURANT_COLUMNS = ["id", "name", "city", "rating", "cost", "cuisine"]
RAW_ORDER_COLUMNS = [
    "order_id",
    "r_id",
    "user_id",
    "order_date",
    "order_status",
    "sales_amount",
    "restaurant_city",
]
RAW_REVIEW_COLUMNS = ["review_id", "restaurant_id", "comment", "rating"]

# Cuisine per supplier key modulo 7 (NULL, blank, padded and
# comma-holding values on purpose).
CUISINES = [None, "", " Indian", "Indian", "Chinese", "Pizza,Fast Food", "South Indian"]


def _s(c: Column) -> Column:
    return c.cast("string")


def _supplier_places(t: BaseTables) -> DataFrame:
    """``s_suppkey`` with its nation and region names."""
    s = t.supplier.select("s_suppkey", "s_nationkey")
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    r = t.region.select("r_regionkey", "r_name")
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)


def _city(k: Column) -> Column:
    return (
        F.when(k % 11 == 3, F.lit(None).cast("string"))
        .when(k % 5 == 4, F.col("r_name"))
        .otherwise(F.concat(F.col("n_name"), F.lit(", "), F.col("r_name")))
    )


def _cuisine(k: Column) -> Column:
    m = k % 7
    expr = F.when(m == 0, F.lit(None).cast("string"))
    for i, value in enumerate(CUISINES[1:], start=1):
        expr = expr.when(m == i, F.lit(value))
    return expr


def _rating_text(k: Column) -> Column:
    return F.when(k % 9 == 2, F.lit("--")).otherwise(
        F.concat(_s(1 + (k * 7) % 4), F.lit("."), _s((k * 3) % 10))
    )


def _name(k: Column) -> Column:
    return F.concat(F.lit("Merchant "), _s(F.floor(k / 2).cast("bigint")))


def raw_restaurants(t: BaseTables) -> DataFrame:
    """``id, name, city, rating, cost, cuisine`` — all text."""
    k = F.col("s_suppkey")
    return _supplier_places(t).select(
        _s(k).alias("id"),
        _name(k).alias("name"),
        _city(k).alias("city"),
        _rating_text(k).alias("rating"),
        F.concat(F.lit("₹ "), _s(100 + 50 * (k % 12))).alias("cost"),
        _cuisine(k).alias("cuisine"),
    )


def restaurants_typed_input(t: BaseTables) -> DataFrame:
    """Restaurant rows that already carry business names and numbers, as a
    CSV reader with inferred types would hand them over: id BIGINT, rating
    DOUBLE (``'--'`` read as missing), cost_for_two DOUBLE with halves."""
    k = F.col("s_suppkey")
    rating = _rating_text(k)
    return _supplier_places(t).select(
        k.alias("restaurant_id"),
        _name(k).alias("restaurant_name"),
        _city(k).alias("city"),
        _cuisine(k).alias("cuisine"),
        F.when(rating == F.lit("--"), F.lit(None).cast("double"))
        .otherwise(rating.cast("double"))
        .alias("rating"),
        ((100 + 50 * (k % 12)).cast("double") + (k % 5) * F.lit(0.5)).alias("cost_for_two"),
    )


def raw_orders(t: BaseTables, columns: Iterable[str] | None = None) -> DataFrame:
    """One raw order per line item.

    ``columns`` restricts the output (and the joins) to what a caller needs.
    """
    want = list(columns) if columns is not None else list(RAW_ORDER_COLUMNS)
    unknown = set(want) - set(RAW_ORDER_COLUMNS)
    if unknown:
        raise ValueError(f"unknown raw order columns: {sorted(unknown)}")
    li = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_linestatus", "l_extendedprice"
    )
    if "user_id" in want:
        o = t.orders.select("o_orderkey", "o_custkey")
        li = li.join(o, li.l_orderkey == o.o_orderkey, "left")
    if "restaurant_city" in want:
        k = F.col("s_suppkey")
        places = _supplier_places(t).select(k.alias("city_key"), _city(k).alias("restaurant_city"))
        li = li.join(places, li.l_suppkey == places.city_key, "left")
    ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
    exprs = {
        "order_id": _s(ok * 8 + ln),
        "r_id": _s(F.col("l_suppkey")),
        "user_id": _s(F.col("o_custkey")),
        "order_date": F.when(ok % 89 == 0, F.lit(None).cast("string")).otherwise(
            _s(F.col("l_shipdate").cast("date"))
        ),
        "order_status": F.col("l_linestatus"),
        "sales_amount": F.when((ok + ln) % 97 == 0, F.lit(None).cast("double")).otherwise(
            F.col("l_extendedprice")
        ),
        "restaurant_city": F.col("restaurant_city"),
    }
    return li.select(*[exprs[c].alias(c) for c in want])


def raw_reviews(t: BaseTables, columns: Iterable[str] | None = None) -> DataFrame:
    """One raw review per document; ``labels`` give the star rating."""
    want = list(columns) if columns is not None else list(RAW_REVIEW_COLUMNS)
    d = t.documents.select("doc_id", "text")
    if "rating" in want:
        lab = t.labels.select(F.col("doc_id").alias("label_id"), "quality", "toxic")
        d = d.join(lab, d.doc_id == lab.label_id, "left")
    k = F.col("doc_id")
    exprs = {
        "review_id": k,
        "restaurant_id": _s(F.floor(F.sqrt(k)).cast("bigint")),
        "comment": F.when(k % 50 == 7, F.lit(None).cast("string"))
        .when(k % 50 == 9, F.lit("   "))
        .otherwise(F.col("text")),
        "rating": _star_rating() if "rating" in want else F.lit(None),
    }
    return d.select(*[exprs[c].alias(c) for c in want])


# Recorded topic strings per review id modulo 4.
RECORDED_TOPICS = [
    "Delivery, Food Quality",
    "Packaging,, Delivery ",
    "Service",
    "Food Quality, Price",
]


# Odd replies by review id modulo 40: two objects, an empty
# object, a null field, text after the object, an object in an array.
ODD_REVIEW_REPLIES = {
    11: '{"sentiment": "Positive"} {"x": 1}',
    17: "{}",
    23: '{"sentiment": null, "topics": "Service", "extra": [1, {"y": 2}]}',
    29: '{"sentiment": "Negative"} as asked',
    37: '[{"sentiment": "Negative"}]',
}


def _star_rating() -> Column:
    """1..5 stars from a label row's ``quality`` and ``toxic``; NULL without one."""
    q = F.col("quality")
    return F.when(q.isNull(), F.lit(None).cast("int")).otherwise(1 + 2 * q + 2 * (1 - F.col("toxic")))


def _review_reply(rid: Column, rating: Column) -> Column:
    """The recorded reply to one review: fenced JSON after a ``<think>``
    block, some without ``topics``, some malformed (``ODD_REVIEW_REPLIES``)."""
    sentiment = (
        F.when(rating >= 4, F.lit("Positive"))
        .when(rating <= 2, F.lit("Negative"))
        .otherwise(F.lit("Neutral"))
    )
    m4 = rid % 4
    topics = F.when(m4 == 0, F.lit(RECORDED_TOPICS[0]))
    for i in (1, 2, 3):
        topics = topics.when(m4 == i, F.lit(RECORDED_TOPICS[i]))
    topics_part = F.when(rid % 13 == 0, F.lit("")).otherwise(
        F.concat(F.lit(', "topics": "'), topics, F.lit('"'))
    )
    reply = F.concat(
        F.lit('<think>x</think>```json\n{"sentiment": "'),
        sentiment,
        F.lit('"'),
        topics_part,
        F.lit(', "summary": "s'),
        _s(rid % 17),
        F.lit('"}\n```'),
    )
    odd = F.when(rid % 40 == 3, F.lit("not json"))
    for at, text in ODD_REVIEW_REPLIES.items():
        odd = odd.when(rid % 40 == at, F.lit(text))
    return odd.otherwise(reply)


def review_responses(t: BaseTables) -> DataFrame:
    """Recorded model replies for every review long enough to be scored."""
    rv = raw_reviews(t, ["review_id", "comment", "rating"])
    rv = rv.filter(F.col("comment").isNotNull() & (F.length("comment") >= 15))
    return rv.select("review_id", _review_reply(F.col("review_id"), F.col("rating")).alias("response"))


def review_replay(t: BaseTables) -> DerivedReplies:
    """A scorer with the same replies: the labels are joined to the requests
    once and the reply is built from that row."""
    facts = t.labels.select(F.col("doc_id").alias("label_id"), "quality", "toxic")
    return DerivedReplies(facts, "label_id", lambda rid: _review_reply(rid, _star_rating()))


# Recorded theme lists (0, 2 and 6 entries).
THEMES_NEGATIVE = [
    [],
    ["late delivery", "cold food"],
    ["late delivery", "cold food", "rude staff", "wrong order", "high price", "small portions"],
]
THEMES_POSITIVE = [
    ["great taste", "fast delivery"],
    ["great taste", "fast delivery", "good packaging", "polite staff", "fair price", "big portions"],
    [],
]


def _json_list(items: list[str]) -> str:
    return "[" + ", ".join(f'"{x}"' for x in items) + "]"


# Odd replies by restaurant id modulo 11: themes that are null
# or a text, counts written as decimals and texts, a count that is no number.
ODD_INSIGHT_REPLIES = {
    1: '{"positive_count": 1, "top_negative_themes": null}',
    2: '{"positive_count": 1, "top_positive_themes": "great taste"}',
    3: '{"positive_count": 3.0, "negative_count": "2", "neutral_count": 1.6, "top_negative_themes": ["a", "b", "c", "d", "e"]}',
    5: '{"positive_count": "many"}',
    9: '{"positive_count": 1} then {"negative_count": 2}',
    10: "{}",
}


def insight_responses(t: BaseTables) -> DataFrame:
    """Recorded replies of the insight job, one per request (``request_id`` =
    restaurant id ``/`` request number): counts from the request's star
    ratings, theme arrays of 0/2/6 entries, a ``<think>`` block holding
    braces, some without ``summary``, every restaurant id ending in 4 a
    rate-limit message instead of JSON, and ``ODD_INSIGHT_REPLIES``."""
    rv = raw_reviews(t, ["review_id", "restaurant_id", "comment", "rating"])
    per = (
        number_reviews(rv, carry=("rating",))
        .groupBy(F.col("rid").alias("restaurant_id"), "request")
        .agg(
            F.count("*").alias("n"),
            F.count(F.when(F.col("rating") >= 4, 1)).alias("pos"),
            F.count(F.when(F.col("rating") <= 2, 1)).alias("neg"),
        )
    )
    k = F.col("restaurant_id").cast("bigint")

    def pick(lists: list[list[str]]) -> Column:
        m = (k + F.col("request")) % 3
        expr = F.when(m == 0, F.lit(_json_list(lists[0])))
        for i in (1, 2):
            expr = expr.when(m == i, F.lit(_json_list(lists[i])))
        return expr

    summary = F.when(k % 7 == 5, F.lit("")).otherwise(
        F.concat(F.lit(', "summary": "Restaurant '), F.col("restaurant_id"), F.lit(' verdict."'))
    )
    reply = F.concat(
        F.lit("<think>"),
        _s(F.col("n")),
        F.lit(" reviews {draft}</think>```json\n"),
        F.lit('{"positive_count": '),
        _s(F.col("pos")),
        F.lit(', "negative_count": '),
        _s(F.col("neg")),
        F.lit(', "neutral_count": '),
        _s(F.col("n") - F.col("pos") - F.col("neg")),
        F.lit(', "top_negative_themes": '),
        pick(THEMES_NEGATIVE),
        F.lit(', "top_positive_themes": '),
        pick(THEMES_POSITIVE),
        summary,
        F.lit("}\n```"),
    )
    response = F.when(k % 10 == 4, F.lit("Rate limit reached, try again later"))
    for at, text in ODD_INSIGHT_REPLIES.items():
        response = response.when(k % 11 == at, F.lit(text))
    return per.select(
        F.concat_ws("/", "restaurant_id", "request").alias("request_id"),
        "restaurant_id",
        "request",
        response.otherwise(reply).alias("response"),
    )
