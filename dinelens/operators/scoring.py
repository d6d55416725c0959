"""Pluggable scorers: turn request texts into model reply texts.

The reference sends each review (or each restaurant's reviews) to a hosted
language model. Here a scorer is any object with
``score(requests, key, text) -> requests + response``: it adds a string
column ``response`` to the request rows (NULL = no reply, reported as a
failure). Adding the column in place, instead of returning a separate
``(key, response)`` frame, means the request rows (which carry the review
texts) are never joined back to their replies.

* ``RuleScorer`` is the default for reviews without ratings: word lists, no model.
* ``learned.LearnedScorer`` is trained on the reviews that have a star rating.
* ``RecordedReplies`` left-joins replies recorded earlier (tests, replays);
  the request side streams and the reply table is the build side.
* ``DerivedReplies`` left-joins narrow facts and builds the reply from them.
* ``BatchScorer`` calls a Python function on Arrow batches.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dinelens.functions.replies import once

log = logging.getLogger(__name__)


class Scorer:
    def score(self, requests: DataFrame, key: str, text: str) -> DataFrame:  # pragma: no cover
        raise NotImplementedError


# Fixed values of the rules: words of either mood, and words of each topic.
GOOD_WORDS = ("good", "great", "tasty", "fresh", "friendly", "fast", "excellent", "love", "polite", "best")
BAD_WORDS = ("bad", "cold", "late", "rude", "stale", "slow", "worst", "disgusting", "worthless", "pathetic")
TOPIC_WORDS = {
    "Delivery": ("delivery", "late", "fast", "slow", "rider"),
    "Food Quality": ("cold", "stale", "fresh", "tasty", "taste", "disgusting"),
    "Service": ("rude", "friendly", "polite", "staff", "service"),
    "Price": ("price", "expensive", "cheap", "worthless"),
}
NOT_WORD = r"[^\p{L}\p{N}]+"


def rule_words(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` and ``_words``: the text in lower case, split once."""
    return once(df, keep, {"_words": F.split(F.lower(F.col(text)), NOT_WORD, -1)})


def rule_topics() -> Column:
    """Topics with a word among ``_words``, else ``General``."""
    found = [F.when(F.arrays_overlap("_words", F.array(*map(F.lit, of))), F.lit(t)) for t, of in TOPIC_WORDS.items()]
    return F.coalesce(F.nullif(F.concat_ws(", ", *found), F.lit("")), F.lit("General"))


class RuleScorer(Scorer):
    """Replies by rules, as native expressions: the mood with more words
    wins, topics are those with a word in the text."""

    def score(self, requests: DataFrame, key: str, text: str) -> DataFrame:
        def count(of: tuple[str, ...]) -> Column:
            return F.size(F.filter("_words", lambda w: w.isin(*of)))

        keep = requests.columns
        words = rule_words(requests, keep, text)
        found = once(words, keep, {"_good": count(GOOD_WORDS), "_bad": count(BAD_WORDS), "_topics": rule_topics()})
        good, bad = F.col("_good"), F.col("_bad")
        mood = F.when(good > bad, "Positive").when(bad > good, "Negative").otherwise("Neutral")
        summary = F.format_string("%d good and %d bad words", good, bad)
        reply = F.struct(mood.alias("sentiment"), F.col("_topics").alias("topics"), summary.alias("summary"))
        return found.select(*keep, F.when(F.col(text).isNotNull(), F.to_json(reply)).alias("response"))


class RecordedReplies(Scorer):
    """Replies looked up by key in a table ``(key, response)``."""

    def __init__(self, replies: DataFrame, response_col: str = "response"):
        self.replies = replies
        self.response_col = response_col

    def score(self, requests: DataFrame, key: str, text: str) -> DataFrame:
        replies = self.replies.select(
            F.col(key).alias("_reply_key"), F.col(self.response_col).alias("response")
        )
        joined = requests.join(replies, requests[key] == replies["_reply_key"], "left")
        return joined.drop("_reply_key")


class DerivedReplies(Scorer):
    """Replies built by ``reply(key column)`` from facts joined once to the
    requests; the facts' columns are at hand under the names given there."""

    def __init__(self, facts: DataFrame, fact_key: str, reply: Callable[[Column], Column]):
        self.facts, self.fact_key, self.reply = facts, fact_key, reply

    def score(self, requests: DataFrame, key: str, text: str) -> DataFrame:
        joined = requests.join(self.facts, requests[key] == self.facts[self.fact_key], "left")
        return joined.select(*[requests[c] for c in requests.columns], self.reply(requests[key]).alias("response"))


class BatchScorer(Scorer):
    """Replies computed by ``fn(pd.Series[str]) -> pd.Series[str]``.

    Runs in the Python workers of the executors over Arrow batches of
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows, so a client can
    batch, rate-limit and retry in ``fn``. The requests are spread over
    ``parallelism`` tasks first (a batch cut leaves them in one); ``None``
    takes the session's number of shuffle partitions.

    If ``fn`` raises, or returns another number of replies, the batch's rows
    are sent one by one, and rows that fail again get ``response = NULL``:
    a failure is reported per row and does not end the job.
    """

    def __init__(self, fn: Callable[[pd.Series], pd.Series], parallelism: int | None = None):
        self.fn = fn
        self.parallelism = parallelism

    def score(self, requests: DataFrame, key: str, text: str) -> DataFrame:
        fn = self.fn
        schema = T.StructType(
            requests.schema.fields + [T.StructField("response", T.StringType())]
        )

        def call(texts: pd.Series) -> list:
            replies = list(fn(texts))
            if len(replies) != len(texts):
                raise ValueError(f"{len(replies)} replies to {len(texts)} requests")
            return replies

        def one(text) -> str | None:
            try:
                return call(pd.Series([text], dtype=object))[0]
            except Exception as exc:
                log.warning("request failed: %s", exc)
                return None

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                texts = pdf[text].astype(object)
                try:
                    replies = call(texts)
                except Exception as exc:
                    log.warning("batch of %d failed (%s); sending its rows one by one", len(texts), exc)
                    replies = [one(t) for t in texts]
                yield pdf.assign(response=pd.Series(replies, index=pdf.index, dtype=object))

        n = self.parallelism or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return requests.repartition(n, key).mapInPandas(run, schema)
