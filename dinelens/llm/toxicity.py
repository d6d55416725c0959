"""Operator 8: toxicity by nearest labelled examples under TF-IDF cosine.

Terms are words and the beginnings of longer words, so that inflected forms
meet. The vocabulary holds every term that labelled toxic training rows use
markedly more often; it is bounded by the sample it is learned from. Every document becomes a sparse count
vector over it in one pass (a narrow table); document frequencies are counted
over all documents.

The index holds at most ``MAX_EXAMPLES`` labelled training examples, so its size
does not grow with the corpus. An example is a distinct pair of id and text;
beyond the bound a hash sample of the ids is taken, then of their pairs, the
first pair of every id before the second ones, so no repeated id crowds out
others. Example
numbers are cut into blocks; every term keeps its largest weight per block. A
query adds these to an upper bound for each block, visits blocks by falling
bound and stops when no bound reaches the k-th best cosine: the result is the
exact top ``k``, ties broken by the example's number.

Votes weighted by cosine, smoothed with the base rate, are mapped to
probabilities by a monotone fit on left-out examples. Documents without any
term get the smoothed rate of examples without any term.

Labels, language, source and id are not inputs of a score. Held-out rows
(crc32 of the id as text, modulo 3, is 1) are never used to learn.

Defined cases: NULL text counts as empty and has no term; a NULL id is neither
held out nor learned from; repeated labels of an id count as their largest,
NULL labels are none; rows repeating an id get a row each; without labels of
either class every score is the smoothed base rate; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinelens.llm.common import materialise, text_or_empty

MAX_EXAMPLES = 30_000
MAX_CALIBRATION = 3000
LEAST_ROWS = 3
LEAST_RATIO = 2.0
PREFIXES = (4, 5, 6)
K = 15
BLOCK = 64
PRIOR_WEIGHT = 0.5
PREDICT_AT = 0.7
FLUSH = 200_000
CACHED = 2_000_000  # numbers that the remembered vectors of a worker hold

WORD = re.compile(r"[^\W_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def terms_of(word: str) -> list[str]:
    """The word, and ``^`` with its first letters if it is longer."""
    return [word, *("^" + word[:p] for p in PREFIXES if len(word) > p)]


def words_of(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


# ---------------------------------------------------------------- learning


def labelled_sample(docs: DataFrame, labels: DataFrame, max_examples: int) -> DataFrame:
    """``doc_id, t, text, toxic`` of at most ``max_examples`` distinct training pairs of id and text."""
    y = labels.filter(labels["toxic"].isNotNull() & labels["doc_id"].isNotNull())
    y = y.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    y = y.filter(~held_out(F.col("label_id")))
    n = y.count()
    share = F.abs(F.xxhash64("label_id", F.lit(11)) / F.lit(2.0**63)) <= min(1.0, max_examples / max(1, n))
    y = materialise(y.filter(share), "labels")
    rows = docs.select("doc_id", text_or_empty("text").alias("text"))
    rows = rows.join(F.broadcast(y), F.col("doc_id") == F.col("label_id"))  # about max_examples ids
    rows = rows.select("doc_id", F.xxhash64("text").alias("t"), "text", "toxic")
    pairs = materialise(rows.select("doc_id", "t").distinct(), "pairs")
    if pairs.count() > max_examples:
        pairs = pairs.select(F.xxhash64("doc_id", "t", F.lit(12)).alias("h"), "t", "doc_id")
        first = pairs.groupBy("doc_id").agg(F.min(F.struct("h", "t")).alias("x")).select(F.lit(0).alias("turn"), "x.h", "x.t", "doc_id")
        more = pairs.orderBy("h", "t", "doc_id").limit(max_examples).select(F.lit(1).alias("turn"), "h", "t", "doc_id")
        both = first.unionByName(more).groupBy("h", "t", "doc_id").agg(F.min("turn").alias("turn"))
        pairs = materialise(both.orderBy("turn", "h", "t", "doc_id").limit(max_examples), "chosen")
    chosen = pairs.select(F.col("doc_id").alias("pair_id"), F.col("t").alias("pair_t"))
    rows = rows.join(F.broadcast(chosen), (F.col("doc_id") == F.col("pair_id")) & (F.col("t") == F.col("pair_t")))  # at most max_examples
    return rows.groupBy("doc_id", "t").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows per term and class, combined within the task; flushed before they grow large."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        terms = [t for c in seen for t in c]
        toxic = [y for y, c in enumerate(seen) for _ in c]
        n = [v for c in seen for v in c.values()]
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(toxic, pa.int32()), pa.array(n, pa.int64())], ["term", "toxic", "n"])

    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen[int(y > 0)].update({t for w in words_of(text) for t in terms_of(w)})
            if len(seen[0]) + len(seen[1]) > FLUSH:
                yield out()
                seen[0].clear()
                seen[1].clear()
    if seen[0] or seen[1]:
        yield out()


def learn_terms(sample: DataFrame) -> tuple[list[str], int, int]:
    """The vocabulary, and the numbers of clean and toxic sample rows."""
    sizes = {r["y"]: r["n"] for r in sample.groupBy((F.col("toxic") > 0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(False, 0), sizes.get(True, 0)
    counted = sample.select("text", "toxic").mapInArrow(_term_rows, "term string, toxic int, n long")
    by_term = counted.groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("d1"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("d0")
    )
    rate1, rate0 = (F.col("d1") + 0.5) / (n1 + 1.0), (F.col("d0") + 0.5) / (n0 + 1.0)
    marked = by_term.filter((F.col("d1") >= LEAST_ROWS) & (rate1 > LEAST_RATIO * rate0))
    marked = marked.select("term", (F.col("d1") * F.ln(rate1 / rate0)).alias("gain"))
    best = marked.orderBy(F.desc("gain"), "term")
    return [r["term"] for r in best.collect()], n0, n1


class _Counter:
    """Counts of vocabulary terms in a text, remembering the terms of words seen before."""

    def __init__(self, place: dict[str, int]):
        self.place = place
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> tuple[list[int], list[int]]:
        known, place = self.known, self.place
        if len(known) > FLUSH:
            known.clear()
        counts: dict[int, int] = {}
        for w, n in words_of(text).items():
            found = known.get(w)
            if found is None:  # most words have no term
                found = known[w] = tuple(place[t] for t in terms_of(w) if t in place)
            for i in found:
                counts[i] = counts.get(i, 0) + n
        ids = sorted(counts)
        return ids, [counts[i] for i in ids]


def vectors(docs: DataFrame, terms: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, t, ids, tfs`` of every document and the columns ``keep``: the counts of vocabulary terms in its whole text."""
    number = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    rows = docs.select("doc_id", text_or_empty("text").alias("text"), *keep).select("doc_id", F.xxhash64("text").alias("t"), *keep, "text")
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _Counter(number.value)
        for batch in batches:
            found = [count(text) for text in batch.column("text").to_pylist()]
            ids, tfs = [i for i, _ in found], [n for _, n in found]
            columns = [*(batch.column(c) for c in names), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "ids", "tfs"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    return rows.mapInArrow(run, ", ".join([*kinds, "ids array<int>", "tfs array<int>"]))


class Index:
    """Block-max inverted index of the examples' unit vectors."""

    def __init__(self, idf: np.ndarray, examples: list[tuple[list[int], list[int]]], labels: list[int], names: list, block: int = BLOCK):
        self.idf, self.block = idf, block
        unit = [self.weights(ids, tfs) for ids, tfs in examples]
        # Examples with the same strongest term are neighbours, which makes bounds tight.
        order = sorted(range(len(unit)), key=lambda e: (int(unit[e][0][np.argmax(unit[e][1])]) if len(unit[e][0]) else -1, e))
        self.labels = np.array([labels[e] for e in order], float)
        self.names = [names[e] for e in order]
        self.n = len(order)
        self.blocks = -(-self.n // block) if self.n else 0
        post: dict[int, list[tuple[int, float]]] = {}
        for place, e in enumerate(order):
            for t, w in zip(*(x.tolist() for x in unit[e]), strict=True):
                post.setdefault(t, []).append((place, w))
        self.postings = {}
        for t, rows in post.items():
            at = np.array([p for p, _ in rows], np.int64)
            w = np.array([x for _, x in rows])
            b, first = np.unique(at // block, return_index=True)
            self.postings[t] = (at, w, b, np.append(first, len(at)), np.maximum.reduceat(w, first))
        self.own = [unit[e] for e in order]

    def weights(self, ids, tfs) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and the unit TF-IDF vector."""
        i = np.asarray(ids, np.int64)
        w = (1 + np.log(np.asarray(tfs, float))) * self.idf[i] if len(i) else np.zeros(0)
        norm = float(np.sqrt((w * w).sum()))
        return i, w / norm if norm else w

    def nearest(self, ids: np.ndarray, w: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the ``k`` nearest examples with a positive cosine, best first."""
        lists = [(x, q) for x, q in ((self.postings.get(t), q) for t, q in zip(ids.tolist(), w.tolist(), strict=True)) if x is not None]
        bound = np.zeros(self.blocks)
        for (_, _, b, _, most), q in lists:
            bound[b] += q * most
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        places, cosines = np.zeros(0, np.int64), np.zeros(0)
        at, take = 0, 8
        while at < len(order):
            if len(cosines) >= k and bound[order[at]] < cosines[k - 1] - 1e-9:
                break
            taken = np.zeros(self.blocks, bool)
            taken[order[at : at + take]] = True
            at, take = at + take, 4 * take
            score = np.zeros(self.n)
            for (p, pw, b, first, _), q in lists:
                here = taken[b]
                if here.any():
                    rows = np.repeat(here, np.diff(first))
                    score[p[rows]] += q * pw[rows]
            place = np.flatnonzero(score > 0)
            place = place[place != skip]
            places, cosines = np.concatenate([places, place]), np.concatenate([cosines, score[place]])
            best = np.lexsort((places, -np.round(cosines, 9)))[:k]
            places, cosines = places[best], cosines[best]
        return places, cosines


class Model:
    """Index, base rates and the map from votes to probabilities."""

    def __init__(self, index: Index, k: int = K, calibrate: int = MAX_CALIBRATION):
        self.index, self.k = index, k
        y = index.labels
        self.prior = float((y.sum() + 0.5) / (len(y) + 1.0)) if len(y) else 0.5
        bare = np.array([not len(x[0]) for x in index.own], bool)
        self.bare = float((y[bare].sum() + self.prior) / (bare.sum() + 1.0)) if bare.any() else self.prior
        self.knots = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        rows = [e for e in range(index.n) if not bare[e]]
        rows = rows[:: max(1, -(-len(rows) // calibrate))]
        if rows:
            votes = np.array([self.vote(*index.own[e], skip=e)[0] for e in rows])
            self.knots = monotone(votes, y[rows])

    def vote(self, ids: np.ndarray, w: np.ndarray, skip: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        places, cosines = self.index.nearest(ids, w, self.k, skip)
        raw = (cosines @ self.index.labels[places] + PRIOR_WEIGHT * self.prior) / (cosines.sum() + PRIOR_WEIGHT)
        return float(raw), places, cosines

    def score(self, ids, tfs) -> tuple[float, str]:
        """Calibrated score, and the three nearest examples as ``id:label:cosine``."""
        if not len(ids):
            return self.bare, ""
        raw, places, cosines = self.vote(*self.index.weights(ids, tfs))
        near = ",".join(f"{self.index.names[p]}:{int(self.index.labels[p])}:{c:.4f}" for p, c in zip(places[:3].tolist(), cosines[:3].tolist(), strict=True))
        return float(np.interp(raw, *self.knots)), near


def monotone(x: np.ndarray, y: np.ndarray, groups: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a non-decreasing map from votes to smoothed rates (pooled adjacent violators)."""
    order = np.argsort(x, kind="stable")
    bins = [b for b in np.array_split(order, min(groups, len(order))) if len(b)]
    pooled: list[list[float]] = []
    for b in bins:
        pooled.append([float(x[b].mean()) * len(b), float(y[b].sum()), float(len(b))])
        while len(pooled) > 1 and pooled[-2][1] / pooled[-2][2] >= pooled[-1][1] / pooled[-1][2]:
            last = pooled.pop()
            pooled[-1] = [a + c for a, c in zip(pooled[-1], last, strict=True)]
    at = np.array([p[0] / p[2] for p in pooled])
    rate = np.maximum.accumulate([(p[1] + 0.5 * min(1.0, p[0] / p[2])) / (p[2] + 0.5) for p in pooled])
    return np.concatenate([[min(0.0, at[0])], at, [max(1.0, at[-1])]]), np.concatenate([[rate[0]], rate, [rate[-1]]])


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, k: int = K) -> tuple[Model, DataFrame, list[str]]:
    """The model, the count vectors of all documents it was fitted beside, and the terms."""
    sample = materialise(labelled_sample(docs, labels, max_examples), "sample")
    terms, _, _ = learn_terms(sample)
    vecs = materialise(vectors(docs, terms), "vectors")
    n = vecs.count()
    df = vecs.select(F.explode("ids").alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    idf = np.full(len(terms), math.log(1 + n) + 1)
    for r in df.collect():
        idf[r["i"]] = math.log((1 + n) / (1 + r["n"])) + 1
    # At most max_examples rows.
    rows = vectors(sample, terms, keep=("toxic",)).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["t"], r["doc_id"]))
    index = Index(idf, [(r["ids"], r["tfs"]) for r in rows], [int(r["toxic"] > 0) for r in rows], [r["doc_id"] for r in rows])
    return Model(index, k), vecs, terms


# ----------------------------------------------------------------- scoring


class _Scorer:
    """``Model.score``, remembering the vectors seen before."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[bytes, tuple[float, str]] = {}
        self.size = 0

    def __call__(self, ids: list[int], tfs: list[int]) -> tuple[float, str]:
        # One term alone has the same unit vector for any count.
        key = np.array([*ids, *tfs] if len(ids) > 1 else ids, np.int32).tobytes()
        found = self.known.get(key)
        if found is None:
            self.size += len(key) // 4 + 64  # an entry's own share
            if self.size > CACHED:
                self.known.clear()
                self.size = len(key) // 4 + 64
            found = self.known[key] = self.model.score(ids, tfs)
        return found


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, t, held_out, score, predicted, evidence``."""
    model, vecs, _ = fit(docs.select("doc_id", "text"), labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _Scorer(shared.value)
        for batch in batches:
            out = [scored(ids, tfs) for ids, tfs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], pa.string())],
                ["doc_id", "t", "score", "evidence"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = vecs.mapInArrow(run, f"doc_id {kind}, t long, score double, evidence string")
    return scored.select(
        "doc_id", "t", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"), "evidence"
    )


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that ``score`` does not predict toxic.

    The model is fitted as for ``score``; then every row is scored where it
    lies and kept or not. No row is shuffled, whatever share of them is toxic.
    """
    model, _, terms = fit(docs.select("doc_id", "text"), labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast((model, {t: i for i, t in enumerate(terms)}))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, place = shared.value
        scored, count = _Scorer(model), _Counter(place)
        for batch in batches:
            keep = [scored(*count(text or ""))[0] < PREDICT_AT for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
