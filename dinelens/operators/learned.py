"""A review scorer learned from star ratings (E7/E8 without a language model).

Features of a text are its distinct words and five marks of its shape (how
many words repeat, how many characters are no letters, capitals, repeated
lines, length of words), hashed into a fixed number of buckets. Training is one
grouped sum of reviews per mood and bucket over *all* rated reviews, combined
before the shuffle; at most ``3 x BUCKETS`` sums reach the driver. A bucket's
weight for a mood is its log-odds against the other moods, in thousandths, if
it lies ``least_z`` standard errors from zero. A review gets the mood with the
largest sum of weights.

Confidence is calibrated on reviews kept out of training: the lead over the
second mood falls into doubling bins, and a bin's confidence is its share of
right answers, not below that of a smaller lead. Folds are hashes of the text,
so copies of a review never stand on both sides.

All sums are integers: the same reviews give the same model on any cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from dinelens.functions.replies import once
from dinelens.operators.scoring import NOT_WORD, Scorer, rule_topics, rule_words

MOODS = ("Negative", "Neutral", "Positive")
BUCKETS = 1 << 16
FOLDS = 16
TRAIN_BELOW, CALIBRATE_BELOW = 12, 14  # folds 0-11 train, 12-13 calibrate, 14-15 are never learned from
LEAST_REVIEWS = 5
LEAST_Z = 6.0
BIN = 250  # a lead below this, in thousandths, is in the first bin
UNKNOWN = 333  # confidence, in thousandths, below all bins that were seen


def _hex(c: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(c), 1, digits), 16, 10).cast("int")


def fold(text: str | Column) -> Column:
    """0..15 by the text's hash."""
    return _hex(F.col(text) if isinstance(text, str) else text, 1)


def buckets(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` and the column ``buckets``: the hashed features of ``text`` (NULL for NULL)."""
    t = F.col(text)
    words = F.filter(F.split(F.lower(t), NOT_WORD, -1), lambda w: w != "")
    parts = once(df, keep, {"_t": t, "_w": words, "_l": F.split(t, "\n", -1)})
    n, chars = F.greatest(F.size("_w"), F.lit(1)), F.greatest(F.length("_t"), F.lit(1))

    def mark(name: str, part: Column, scale: int, whole: Column) -> Column:
        return F.concat(F.lit(f"#{name}:"), F.call_function("div", part * scale, whole).cast("string"))

    shape = F.array(
        mark("distinct", F.size(F.array_distinct("_w")), 20, n),
        mark("marks", F.length(F.regexp_replace("_t", r"[\p{L} \t\n\r]", "")), 40, chars),
        mark("capitals", F.length(F.regexp_replace("_t", r"[^\p{Lu}]", "")), 40, chars),
        mark("lines", F.size(F.array_distinct("_l")), 10, F.size("_l")),
        mark("letters", F.length(F.array_join("_w", "")), 2, n),
    )
    hashed = F.array_distinct(F.transform(F.array_union("_w", shape), lambda w: _hex(w, 4)))
    return once(parts, keep, {"buckets": F.when(F.col("_t").isNotNull(), hashed)})


def mood(rating: str) -> Column:
    """The place in ``MOODS`` of a star rating; NULL for NULL."""
    r = F.col(rating)
    return F.when(r <= 2, 0).when(r >= 4, 2).when(r.isNotNull(), 1)


def examples(reviews: DataFrame) -> DataFrame:
    """``label, fold, buckets`` of the reviews with a rating and a comment."""
    rated = reviews.filter(F.col("comment").isNotNull() & F.col("rating").isNotNull())
    narrow = rated.select(mood("rating").alias("label"), fold("comment").alias("fold"), "comment")
    return buckets(narrow, ["label", "fold"], "comment")


@dataclass
class SentimentModel:
    """Weights (thousandths) of every bucket and mood, their bases, and confidences by bin."""

    weights: np.ndarray
    base: np.ndarray
    confidence: np.ndarray

    def judge(self, lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Mood and lead over the second mood for each list of buckets; ties go to the first mood."""
        arrays = [np.asarray(x, np.int64) for x in lists]
        ends = np.cumsum([len(x) for x in arrays])
        sums = np.zeros((len(arrays) + 1, len(MOODS)), np.int64)
        if len(arrays) and ends[-1]:
            running = np.vstack([np.zeros((1, len(MOODS)), np.int64), np.cumsum(self.weights[np.concatenate(arrays)], axis=0)])
            sums[1:] = running[ends]
        scores = np.diff(sums, axis=0) + self.base
        order = np.sort(scores, axis=1)
        return scores.argmax(axis=1), order[:, -1] - order[:, -2]


def weights_of(counts: np.ndarray, docs: np.ndarray, least_reviews: int = LEAST_REVIEWS, least_z: float = LEAST_Z) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bases from the reviews per bucket and mood, and per mood."""
    rest = counts.sum(axis=1, keepdims=True) - counts
    odds = np.log((counts + 0.5) / (docs + 1.0)) - np.log((rest + 0.5) / (docs.sum() - docs + 1.0))
    error = np.sqrt(1.0 / (counts + 0.5) + 1.0 / (rest + 0.5))
    good = (counts.sum(axis=1, keepdims=True) >= least_reviews) & (np.abs(odds) > least_z * error)
    base = np.log((docs + 1.0) / (docs.sum() - docs + 1.0))
    return np.where(good, _round(1000 * odds), 0), _round(1000 * base)


def _round(x: np.ndarray) -> np.ndarray:
    return (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype(np.int64)


def bins_of(lead: np.ndarray) -> np.ndarray:
    return np.array([int(x // BIN).bit_length() for x in lead], np.int64)


def train(reviews: DataFrame, least_reviews: int = LEAST_REVIEWS, least_z: float = LEAST_Z) -> SentimentModel:
    """Learn from the rated reviews (``comment, rating``) of the training and calibration folds."""
    rows = examples(reviews).filter(F.col("fold") < CALIBRATE_BELOW)
    learn = rows.filter(F.col("fold") < TRAIN_BELOW)
    # One sum for both: bucket -1 counts the reviews themselves.
    held = learn.select("label", F.explode(F.concat("buckets", F.array(F.lit(-1)))).alias("bucket"))
    sums = held.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("n")).toArrow()
    label, bucket, n = (sums.column(i).to_numpy() for i in range(3))
    counts, docs = np.zeros((BUCKETS, len(MOODS)), np.int64), np.zeros(len(MOODS), np.int64)
    real = bucket >= 0
    counts[bucket[real], label[real]] = n[real]
    docs[label[~real]] = n[~real]
    weights, base = weights_of(counts, docs, least_reviews, least_z)
    model = SentimentModel(weights, base, np.full(64, UNKNOWN, np.int64))

    judged = judgements(rows.filter(F.col("fold") >= TRAIN_BELOW), ["label"], model)
    seen = judged.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("mood")).alias("good"))
    best = UNKNOWN
    for r in sorted(seen.collect(), key=lambda r: r["bin"]):  # at most 64 bins
        best = max(best, 1000 * (r["good"] + 1) // (r["n"] + 2))
        model.confidence[r["bin"] :] = best
    return model


def judgements(rows: DataFrame, keep: list[str], model: SentimentModel) -> DataFrame:
    """``keep, mood, bin, confidence`` of rows with ``buckets``."""

    @pandas_udf("struct<mood: int, bin: int, confidence: int>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for lists in batches:
            place, lead = model.judge(lists)
            at = bins_of(lead)
            yield pd.DataFrame({"mood": place, "bin": at, "confidence": model.confidence[at]}).astype("int32")

    found = rows.withColumn("_j", judge(F.coalesce("buckets", F.array().cast("array<int>"))))
    return found.select(*keep, "_j.mood", "_j.bin", "_j.confidence")


class LearnedScorer(Scorer):
    """Replies by a trained ``SentimentModel``: mood, topics by word lists, calibrated confidence.

    The text's buckets are computed in the JVM; only they go to Python.
    """

    def __init__(self, model: SentimentModel):
        self.model = model

    def score(self, requests: DataFrame, key: str, text: str) -> DataFrame:
        keep = requests.columns
        judged = judgements(buckets(requests, keep, text), keep, self.model)
        name = F.element_at(F.array(*map(F.lit, MOODS)), F.col("mood") + 1)
        reply = F.struct(
            name.alias("sentiment"),
            F.col("_topics").alias("topics"),
            F.concat(F.lit("confidence "), F.col("confidence").cast("string"), F.lit("/1000")).alias("summary"),
        )
        topics = once(rule_words(judged, [*keep, "mood", "confidence"], text), [*keep, "mood", "confidence"], {"_topics": rule_topics()})
        return topics.select(*keep, F.when(F.col(text).isNotNull(), F.to_json(reply)).alias("response"))


def held_out(reviews: DataFrame, model: SentimentModel) -> DataFrame:
    """``rated, found, count`` over the reviews of the folds that nothing was learned from."""
    rows = examples(reviews).filter(F.col("fold") >= CALIBRATE_BELOW)
    names = F.array(*map(F.lit, MOODS))
    judged = judgements(rows, ["label"], model)
    pairs = judged.select(F.element_at(names, F.col("label") + 1).alias("rated"), F.element_at(names, F.col("mood") + 1).alias("found"))
    return pairs.groupBy("rated", "found").agg(F.count(F.lit(1)).alias("count"))
