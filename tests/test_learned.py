"""The learned scorer: better than the word lists on reviews it has not seen, calibrated, and sound on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dinelens.operators import learned, reviews
from dinelens.operators.scoring import RuleScorer
from dinelens.plans.warehouse import Warehouse

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def rated(spark):
    return Warehouse.from_dir(spark, SF).raw_reviews(["review_id", "comment", "rating"])


@pytest.fixture(scope="module")
def model(rated):
    return learned.train(rated)


def share_right(pairs):
    rows = [(r["rated"], r["found"], r["count"]) for r in pairs.collect()]
    return sum(n for a, b, n in rows if a == b) / sum(n for *_, n in rows)


def test_beats_the_word_lists_on_held_out_reviews(rated, model):
    kept = rated.filter(F.col("rating").isNotNull() & F.col("comment").isNotNull() & (learned.fold("comment") >= learned.CALIBRATE_BELOW))
    names = F.array(*map(F.lit, learned.MOODS))
    parsed = reviews.parse_review_reply(RuleScorer().score(kept, "review_id", "comment"))
    rules = parsed.select(F.element_at(names, learned.mood("rating") + 1).alias("rated"), F.col("sentiment").alias("found"))
    by_rules = share_right(rules.groupBy("rated", "found").agg(F.count(F.lit(1)).alias("count")))
    by_model = share_right(learned.held_out(rated, model))
    always = kept.groupBy("rating").count().agg(F.max("count") / F.sum("count")).first()[0]
    assert by_model > 0.85 and by_model > by_rules + 0.3 and by_model > always + 0.08


def test_confidence_is_calibrated(rated, model):
    rows = learned.examples(rated).filter(F.col("fold") >= learned.CALIBRATE_BELOW)
    judged = learned.judgements(rows, ["label"], model)
    claimed, right = judged.agg(F.avg(F.col("confidence") / 1000), F.avg((F.col("label") == F.col("mood")).cast("double"))).first()
    assert abs(claimed - right) < 0.06
    assert (np.diff(model.confidence) >= 0).all()


def test_weights_are_plain_log_odds(spark):
    rows = [("good food", 5)] * 40 + [("bad food", 1)] * 40 + [("plain", 3)] * 3
    df = spark.createDataFrame([(f"{t} x{i}", r) for i, (t, r) in enumerate(rows)], "comment string, rating int")
    found = learned.train(df, least_reviews=2, least_z=0.0)
    kept = [r for r in learned.examples(df).collect() if r["fold"] < learned.TRAIN_BELOW]
    good = spark.range(1).select(learned._hex(F.lit("good"), 4)).first()[0]
    n = sum(good in r["buckets"] and r["label"] == 2 for r in kept)
    d, total = sum(r["label"] == 2 for r in kept), len(kept)
    rest = sum(good in r["buckets"] for r in kept) - n
    want = 1000 * (np.log((n + 0.5) / (d + 1)) - np.log((rest + 0.5) / (total - d + 1)))
    assert abs(found.weights[good, 2] - want) <= 0.5


def test_odd_reviews(spark, model):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "  \n "), (3, "ÄÖ" * 9), (3, "ÄÖ" * 9)], "review_id long, text string")
    got = [(r["review_id"], r["response"] is None) for r in learned.LearnedScorer(model).score(df, "review_id", "text").collect()]
    assert sorted(got, key=str) == sorted([(1, True), (2, False), (None, False), (3, False), (3, False)], key=str)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "comment string, rating int")
    found = learned.train(empty)
    assert not found.weights.any() and (found.confidence == learned.UNKNOWN).all()


def test_a_text_is_split_once(spark):
    df = spark.createDataFrame([(1, "a b")], "review_id long, text string")
    plan = RuleScorer().score(df, "review_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
