"""Themes of a restaurant without a model (E15): phrases that its reviews hold more often than the rest of its city.

Candidates are pairs of neighbouring words, once per review. Reviews are counted
per restaurant and phrase within the tasks that read them; these rows are dealt
by phrase once, and that shuffle serves the counts of a restaurant, a city and
of all. A task counts all mentions of a restaurant, too: a row with an empty
phrase, which goes the same way and becomes the totals. What may become a theme is
stored with the totals, so texts are read once. A phrase is scored by the
log-odds of restaurant against rest of the city, both pulled towards the
phrase's share overall by a prior worth ``PRIOR`` mentions, in standard errors.
The best phrases are cut by rank before they are shuffled.

A review counts if its comment isn't blank and its restaurant is known (ids as
text); restaurants without a city are compared with each other. Repeated rows
count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dinelens.functions.cleaning import non_blank
from dinelens.operators.scoring import NOT_WORD
from dinelens.session import scratch_path

PRIOR = 500.0
LEAST_REVIEWS = 3
TOP = 5


MAX_HELD = 2_000_000  # mentions held by a task before it writes their counts
AT_ONCE = 50_000  # rows of a batch written
TOTAL = ""  # no phrase: the row counts the mentions of all
ROWS = "rid string, place string, theme string, n long"


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _commented(reviews: DataFrame) -> DataFrame:
    """``rid, words``: the words of comments that aren't blank, a space between them."""
    rows = reviews.filter(non_blank("comment"))
    return rows.select(F.col("restaurant_id").cast("string").alias("rid"), F.regexp_replace(F.lower("comment"), NOT_WORD, " ").alias("words"))


def _mentions(rows: DataFrame) -> DataFrame:
    """``rid, place, theme, n`` of ``rid, place, words``: reviews with a phrase as tasks found them.

    The theme ``TOTAL`` counts the mentions of all phrases. A phrase is held as
    the numbers of its two words in one integer.
    """
    names = ["rid", "place", "theme", "n"]

    def flush(words: dict[str, int], held: dict[tuple, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        word = pa.array(list(words), pa.string())
        found = [np.unique(np.concatenate(keys), return_counts=True) for keys in held.values()]
        group = np.repeat(np.arange(len(found)), [len(k) for k, _ in found])
        key, n = (np.concatenate([f[i] for f in found]) for i in range(2))
        places = [pa.array([g[i] for g in held], pa.string()) for i in range(2)]
        for at in range(0, len(key), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            a, b = word.take(pa.array(key[part] >> 32)), word.take(pa.array(key[part] & 0xFFFFFFFF))
            of = pa.array(group[part])
            yield pa.RecordBatch.from_arrays([*(x.take(of) for x in places), pc.binary_join_element_wise(a, b, " "), pa.array(n[part], pa.int64())], names)
        totals = [int(c.sum()) for _, c in found]
        yield pa.RecordBatch.from_arrays([*places, pa.array([TOTAL] * len(totals), pa.string()), pa.array(totals, pa.int64())], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, int] = {}
        held: dict[tuple, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for rid, place, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                w = text.split()
                if len(w) < 2:
                    continue
                x = np.array([words.setdefault(v, len(words)) for v in w], np.int64)
                pairs = np.unique((x[:-1] << 32) | x[1:])
                held.setdefault((rid, place), []).append(pairs)
                size += len(pairs)
                if size > MAX_HELD:
                    yield from flush(words, held)
                    words, held, size = {}, {}, 0
        if held:
            yield from flush(words, held)

    return rows.select("rid", "place", "words").mapInArrow(count, ROWS)


def phrase_counts(reviews: DataFrame) -> DataFrame:
    """``rid, theme, n``: reviews of a restaurant that hold a phrase."""
    rows = _mentions(_commented(reviews).withColumn("place", F.lit(""))).filter(F.col("theme") != TOTAL)
    return rows.groupBy("rid", "theme").agg(F.sum("n").alias("n"))


def _summed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of ``rid, place, theme, n, h`` with equal hashes of a theme together: ``n`` added up, with the sums of the city and of all.

    Phrases that a restaurant has fewer than ``least`` times are left out; the rows of ``TOTAL`` stay.
    """
    names = ["rid", "place", "theme", "n", "n_place", "n_all"]

    def differs(codes: np.ndarray) -> np.ndarray:
        """Whether a row differs from the one before."""
        return np.append(True, codes[1:] != codes[:-1])

    def out(rows: pa.Table) -> pa.RecordBatch:
        columns = [rows.column(i).combine_chunks() for i in range(3)]
        rid, place, theme = (c.dictionary_encode().indices.to_numpy() for c in columns)
        order = np.lexsort((rid, place, theme))
        new = differs(theme[order])
        new_place = new | differs(place[order])
        at = np.flatnonzero(new_place | differs(rid[order]))
        sums = np.add.reduceat(rows.column(3).to_numpy()[order], at)
        of = []
        for starts in (new_place[at], new[at]):
            first = np.flatnonzero(starts)
            of.append(np.repeat(np.add.reduceat(sums, first), np.diff(np.append(first, len(at)))))
        at = order[at]
        keep = (sums >= least) | pc.equal(columns[2], TOTAL).to_numpy(zero_copy_only=False)[at]
        take = pa.array(at[keep])
        return pa.RecordBatch.from_arrays([*(c.take(take) for c in columns), *(pa.array(x[keep], pa.int64()) for x in (sums, *of))], names)

    held: list[pa.RecordBatch] = []  # rows of one hash, which may go on
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column(4).to_numpy()
        cuts = np.flatnonzero(differs(h))
        if h[0] == last:
            cuts = cuts[1:]
        if len(cuts):
            done = [*held, batch.slice(0, int(cuts[-1]))]
            held = []
            if sum(b.num_rows for b in done):
                yield out(pa.Table.from_batches(done))
        held.append(batch.slice(int(cuts[-1]) if len(cuts) else 0))
        last = h[-1]
    if held:
        yield out(pa.Table.from_batches(held))


def restaurant_themes(restaurants: DataFrame, reviews: DataFrame, top: int = TOP, least_reviews: int = LEAST_REVIEWS, prior: float = PRIOR) -> DataFrame:
    """``restaurant_id, rank, theme, reviews, city_reviews, score`` of the ``top`` phrases above the rest of the city."""
    places = restaurants.select(F.col("restaurant_id").cast("string").alias("rid"), F.coalesce("city", F.lit("")).alias("place")).distinct()
    # Stored, its real size is known: it is broadcast if it is small.
    rows = _mentions(_commented(reviews).join(_stored(places, "theme-places"), "rid"))
    # Sorting by one number is much faster than by texts.
    rows = rows.repartition("theme").select("rid", "place", "theme", "n", F.xxhash64("theme").alias("h")).sortWithinPartitions("h")
    kept = _stored(rows.mapInArrow(lambda b: _summed(b, least_reviews), f"{ROWS}, n_place long, n_all long"), "theme-counts")
    of_all = F.col("theme") == TOTAL
    totals = kept.filter(of_all).select("rid", "place", F.col("n").alias("all_rid"), F.col("n_place").alias("all_place"), F.col("n_all").cast("double").alias("total"))

    rows = kept.filter(~of_all & (F.col("n") >= least_reviews)).join(totals, ["rid", "place"])
    pull = F.lit(prior) * F.col("n_all") / F.col("total")
    other, all_other = F.col("n_place") - F.col("n"), F.col("all_place") - F.col("all_rid")
    mine, theirs = F.col("n") + pull, other + pull
    odds = F.log(mine / (F.col("all_rid") + F.lit(prior) - mine)) - F.log(theirs / (all_other + F.lit(prior) - theirs))
    score = F.round(odds / F.sqrt(F.lit(1.0) / mine + F.lit(1.0) / theirs), 6)
    scored = rows.select("rid", "theme", "n", "n_place", score.alias("score")).filter("score > 0")
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), "theme"))
    best = scored.withColumn("rank", rank).filter(F.col("rank") <= top)
    return best.select(F.col("rid").alias("restaurant_id"), "rank", "theme", F.col("n").alias("reviews"), F.col("n_place").alias("city_reviews"), "score")
