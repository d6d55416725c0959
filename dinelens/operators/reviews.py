"""Review sentiment: enrichment and the queries over its gold table
(E1-E9, G3).

Enrichment is ``candidates -> scorer -> parse``: candidates are raw reviews
not yet in the gold table (a left-anti join on ``review_id``), with text of
at least 15 characters; the scorer returns one reply per review and the
parser turns replies into typed columns plus an ``ok`` flag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinelens.functions.cleaning import split_list
from dinelens.functions.replies import REVIEW_REPLY_SCHEMA, once, parsed_object, review_fields, review_object
from dinelens.operators.paging import attach_late
from dinelens.operators.scoring import Scorer

MIN_REVIEW_CHARS = 15
ENRICH_BATCH = 100
SENTIMENTS = ("Positive", "Negative", "Neutral")


def review_columns(columns: list[str]) -> tuple[str, str]:
    """(id column, text column) of a raw review table: ``comment``, else
    ``review_text``, else the 6th column; ``review_id``, else the 1st."""
    if "comment" in columns:
        text = "comment"
    elif "review_text" in columns:
        text = "review_text"
    elif len(columns) > 5:
        text = columns[5]
    else:
        raise ValueError(f"no review text column among {columns}")
    ident = "review_id" if "review_id" in columns else columns[0]
    return ident, text


def enrich_candidates(
    raw: DataFrame,
    done: DataFrame | None = None,
    batch_size: int | None = None,
    min_chars: int = MIN_REVIEW_CHARS,
) -> DataFrame:
    """``(review_id, text)`` of reviews still to enrich.

    Processed ids are removed *before* the batch is cut (a re-run moves on
    to the next reviews), and the batch is the lowest ids (ties by text), so
    runs are repeatable. ``batch_size=None`` takes every pending review. Ids
    are compared null-safely: the gold table keeps one row without an id, and
    once it is there no review without an id is sent again. Raw
    reviews have no key, so a batch is a plain filter and top-k: each row is
    sent once, however its id repeats.
    """
    ident, text = review_columns(raw.columns)
    r = raw.select(F.col(ident).alias("review_id"), F.col(text).cast("string").alias("text"))
    if done is not None:
        known = done.select(F.col("review_id").alias("_done_id"))
        r = r.join(known, F.col("review_id").eqNullSafe(F.col("_done_id")), "left_anti")
    r = r.filter(F.col("text").isNotNull() & (F.length("text") >= F.lit(min_chars)))
    if batch_size:
        r = r.orderBy(F.col("review_id").asc_nulls_last(), "text").limit(batch_size)
    return r


def parse_review_reply(replies: DataFrame, response_col: str = "response") -> DataFrame:
    """Reply text -> ``ok, sentiment, topics, summary``.

    Fences and ``<think>`` blocks are removed; the rest must be one JSON
    object with at least one key. Missing keys take the defaults ``Neutral``
    / ``General`` / ``No summary``; a key holding null stays NULL.
    """
    keep = [c for c in replies.columns if c != response_col]
    parsed = parsed_object(replies, keep, response_col, review_object, REVIEW_REPLY_SCHEMA)
    return once(parsed, keep, review_fields())


def enrich_reviews(
    raw: DataFrame,
    scorer: Scorer,
    done: DataFrame | None = None,
    batch_size: int | None = None,
) -> DataFrame:
    """Candidates, scored and parsed: ``review_id, original_text, ok,
    sentiment, topics, summary`` (failed replies have ``ok = false``)."""
    cand = enrich_candidates(raw, done, batch_size)
    scored = scorer.score(cand, "review_id", "text")
    parsed = parse_review_reply(scored)
    return parsed.select(
        "review_id",
        F.col("text").alias("original_text"),
        "ok",
        "sentiment",
        "topics",
        "summary",
    )


def sentiment_rows(enriched: DataFrame, with_timestamp: bool = True) -> DataFrame:
    """Rows for the gold table: the successful ones, stamped."""
    cols = ["review_id", "original_text", "sentiment", "topics", "summary"]
    ok = enriched.filter(F.col("ok")).select(*cols)
    return ok.withColumn("processed_at", F.current_timestamp()) if with_timestamp else ok


def enrich_report(enriched: DataFrame) -> DataFrame:
    """One row ``enriched, failed``."""
    return enriched.agg(
        F.count_if(F.col("ok")).alias("enriched"),
        F.count_if(~F.col("ok")).alias("failed"),
    )


def sentiment_counts(gold: DataFrame) -> DataFrame:
    """Rows per sentiment label."""
    return gold.groupBy("sentiment").agg(F.count(F.lit(1)).alias("count"))


def sentiment_summary(gold: DataFrame | None, raw: DataFrame) -> DataFrame:
    """One row ``enriched, positive, negative, neutral, raw_count``.

    With a gold table: its three label counts (zero-filled, other labels
    ignored) and NULL raw_count. Without: ``enriched = false``, zero counts
    and the number of raw reviews.
    """
    if gold is None:
        return raw.agg(
            F.lit(False).alias("enriched"),
            *[F.lit(0).cast("bigint").alias(s.lower()) for s in SENTIMENTS],
            F.count(F.lit(1)).alias("raw_count"),
        )
    return gold.agg(
        F.lit(True).alias("enriched"),
        *[F.count_if(F.col("sentiment") == F.lit(s)).alias(s.lower()) for s in SENTIMENTS],
        F.lit(None).cast("bigint").alias("raw_count"),
    )


def sample_reviews(gold: DataFrame, k: int = 10, texts: DataFrame | None = None) -> DataFrame:
    """K enriched reviews (lowest ids): text, sentiment, summary.

    The k ids are chosen on the narrow columns; their texts are joined
    afterwards from ``texts`` (``review_id, original_text``, by default the
    gold table), so only k texts are moved.
    """
    order = [F.col("review_id").asc_nulls_last()]
    cut = gold.select("review_id", "sentiment", "summary").orderBy(*order).limit(k)
    source = gold if texts is None else texts
    return attach_late(
        cut, source, "review_id", ["original_text"], order, k,
        ["original_text", "sentiment", "summary"],
    )


def topic_counts(gold: DataFrame) -> DataFrame:
    """Every topic mention: comma split, stripped, empties dropped."""
    return (
        gold.select(F.explode(split_list("topics")).alias("topic"))
        .groupBy("topic")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def top_topics(gold: DataFrame, k: int = 15) -> DataFrame:
    """E5: the k most frequent topics, ties by topic."""
    return (
        topic_counts(gold)
        .orderBy(F.col("count").desc(), F.col("topic").asc_nulls_last())
        .limit(k)
    )


def negative_topic_count(gold: DataFrame, topic: str = "delivery") -> DataFrame:
    """Negative reviews whose topics mention ``topic`` (ILIKE)."""
    hit = (F.col("sentiment") == F.lit("Negative")) & F.col("topics").ilike(f"%{topic}%")
    return gold.agg(F.count_if(F.coalesce(hit, F.lit(False))).alias("review_count"))
