"""Themes stand out against the rest of the city, whatever a restaurant's size."""

import pyarrow as pa

from dinelens.operators import themes
from dinelens.operators.themes import phrase_counts, restaurant_themes


def test_a_phrase_of_one_restaurant_stands_out(spark):
    restaurants = spark.createDataFrame([(1, "a", "X"), (2, "b", "X"), (3, "c", None), (4, "d", None)], "restaurant_id long, restaurant_name string, city string")
    rows = [("1", "Cold  food, late again")] * 6 + [("1", "the usual place")] * 20 + [("2", "the usual place")] * 30 + [("3", "hot soup")] * 5 + [("4", "hot tea")] * 5
    rows += [("9", "unknown place here")] * 9 + [("1", None), ("1", "  "), ("2", "one"), (None, "no restaurant")]
    reviews = spark.createDataFrame(rows, "restaurant_id string, comment string")
    got = {}
    for r in restaurant_themes(restaurants, reviews).orderBy("restaurant_id", "rank").collect():
        got.setdefault(r["restaurant_id"], []).append((r["theme"], r["reviews"], r["city_reviews"]))
    assert got["1"] == [("cold food", 6, 6), ("food late", 6, 6), ("late again", 6, 6)]
    assert got["3"] == [("hot soup", 5, 5)] and got["4"] == [("hot tea", 5, 5)] and "9" not in got
    assert restaurant_themes(restaurants, reviews.limit(0)).collect() == []


def test_a_review_counts_a_phrase_once(spark):
    reviews = spark.createDataFrame([("1", "a b a b"), ("1", "A-B"), ("1", "b")], "restaurant_id string, comment string")
    assert {(r["theme"], r["n"]) for r in phrase_counts(reviews).collect()} == {("a b", 2), ("b a", 1)}


def test_texts_are_read_once_and_stored_counts_make_the_themes(spark, tmp_path):
    restaurants = spark.createDataFrame([(1, "a", "X"), (2, "b", "X")], "restaurant_id long, restaurant_name string, city string")
    rows = [("1", "cold food")] * 4 + [("2", "hot soup")] * 4
    spark.createDataFrame(rows, "restaurant_id string, comment string").write.parquet(str(tmp_path / "reviews"))
    found = restaurant_themes(restaurants, spark.read.parquet(str(tmp_path / "reviews")))
    assert not [f for f in found.inputFiles() if "reviews" in f]
    assert {r["theme"] for r in found.collect()} == {"cold food", "hot soup"}


def test_sums_of_a_phrase_cross_batches():
    h = [1, 1, 1, 1, 1, 1, 2, 3]
    rows = [("a", "X", "p q"), ("b", "X", "p q"), ("c", "Y", "r s"), ("a", "X", "p q"), ("c", "Y", "p q"), ("c", "Y", "r s"), ("a", "X", themes.TOTAL), ("c", "Y", "t u")]
    # Two phrases of one hash, and one hash over several batches.
    table = pa.table([[r[i] for r in rows] for i in range(3)] + [[2] * 8, h], names=["rid", "place", "theme", "n", "h"])
    for size in (1, 2, 3, 8):
        got = [tuple(r.values()) for b in themes._summed(iter(table.to_batches(max_chunksize=size)), 3) for r in b.to_pylist()]
        assert sorted(got) == [("a", "X", "", 2, 2, 2), ("a", "X", "p q", 4, 6, 8), ("c", "Y", "r s", 4, 4, 4)]
