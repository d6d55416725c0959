import pickle
import random
import zlib

import numpy as np
import pytest

from dinelens.llm import toxicity


def corpus(n, seed=2):
    """Words of a small language; toxic rows also use inflected forms of a few stems."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    stems, ends = ["gruvva", "plonko"], ["m", "nt", "sch", "ra", "del", "ig", "lun"]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        for _ in range(rng.randint(2, 5) if toxic else 0):
            text.insert(rng.randint(0, len(text)), rng.choice(stems) + rng.choice(ends))
        docs.append((i, " ".join(text), "x", "y"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


DOCS, LABELS = "doc_id long, text string, score string, evidence string", "doc_id long, quality int, toxic int"


def test_held_out_accuracy_and_no_leak(spark):
    docs, labels = corpus(1500)
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    got = {r["doc_id"]: r for r in toxicity.score(d, y).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    right = sum(got[i]["predicted"] == truth[i] for i in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    # Held-out labels are not read: turning them over changes nothing.
    turned = [(i, q, 1 - t if i in set(held) else t) for i, q, t in labels]
    again = {r["doc_id"]: r["score"] for r in toxicity.score(d, spark.createDataFrame(turned, LABELS)).collect()}
    assert all(again[i] == r["score"] for i, r in got.items())
    evidence = {int(x.split(":")[0]) for r in got.values() for x in r["evidence"].split(",") if x}
    assert not evidence & set(held)
    kept = {r["doc_id"] for r in toxicity.without_toxic(d, y).collect()}
    assert kept == {i for i, r in got.items() if not r["predicted"]}


def test_nearest_is_exact():
    rng = np.random.default_rng(3)
    idf = rng.uniform(1, 6, 60)
    rows = []
    for _ in range(700):
        ids = np.sort(rng.choice(60, rng.integers(0, 6), replace=False))
        rows.append((ids.tolist(), rng.integers(1, 9, len(ids)).tolist()))
    index = toxicity.Index(idf, rows, [0] * 700, list(range(700)), block=16)
    dense = np.zeros((700, 60))
    for e, (i, w) in enumerate(index.own):
        dense[e, i] = w
    for e in range(0, 700, 7):
        ids, w = index.own[e]
        q = np.zeros(60)
        q[ids] = w
        cos = np.round(dense @ q, 9)
        want = [p for p in np.lexsort((np.arange(700), -cos)) if cos[p] > 0 and p != e][:10]
        got, c = index.nearest(ids, w, 10, skip=e)
        assert got.tolist() == want
        assert np.allclose(c, (dense @ q)[want])


def test_monotone_map():
    x = np.linspace(0, 1, 200)
    y = (np.random.default_rng(0).uniform(size=200) < x).astype(float)
    at, rate = toxicity.monotone(x, y)
    assert np.all(np.diff(at) >= 0) and np.all(np.diff(rate) >= 0) and 0 <= rate[0] and rate[-1] <= 1


@pytest.mark.parametrize("which", ["none", "odd"])
def test_odd_rows(spark, odd_documents, empty_documents, which):
    labels = spark.createDataFrame([] if which == "none" else [(1, 1, 0), (1, 1, 1), (2, None, None), (None, 1, 1), (9, 0, 0)], LABELS)
    got = toxicity.score(odd_documents, labels).collect()
    assert len(got) == odd_documents.count()
    assert all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty_documents, labels).count() == 0
    assert toxicity.without_toxic(odd_documents, labels).schema.names == odd_documents.schema.names


def test_every_marked_term_is_in_the_vocabulary(spark):
    # 400 words with their prefixes, each in three toxic rows only: many terms of little gain.
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abdeilmnorstu") for _ in range(9)) for _ in range(400)})
    rows = [(i, " ".join(["plain", *(words[i // 3 * 4 : i // 3 * 4 + 4] if i < 300 else [])])) for i in range(1200)]
    ids = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 3 != 1][:1200]
    docs = spark.createDataFrame([(ids[i], t, "", "") for i, t in rows], DOCS)
    labels = spark.createDataFrame([(ids[i], 1, int(i < 300)) for i, _ in rows], LABELS)
    assert len(words) == 400
    terms = toxicity.fit(docs, labels)[2]
    assert set(words) <= set(terms) and len(terms) >= 1200


def test_a_repeated_id_does_not_fill_the_sample(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1][:40]
    rows = [(i, f"text {i}", "", "") for i in ids for _ in range(3)] + [(ids[0], f"another text {j}", "", "") for j in range(300)]
    labels = spark.createDataFrame([(i, 1, 0) for i in ids], LABELS)
    got = toxicity.labelled_sample(spark.createDataFrame(rows, DOCS), labels, 50).collect()
    assert len(got) == 50 and {r["doc_id"] for r in got} == set(ids)
    assert len({(r["doc_id"], r["text"]) for r in got}) == 50
    # Below the bound nothing is left out.
    got = toxicity.labelled_sample(spark.createDataFrame(rows, DOCS), labels, 1000).collect()
    assert {(r["doc_id"], r["text"]) for r in got} == {(i, t) for i, t, _, _ in rows} and len(got) == 340


def test_remembered_vectors_are_bounded_by_their_size(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHED", 4000)

    class Model:
        @staticmethod
        def score(ids, tfs):
            return float(sum(ids) + sum(tfs)), ""

    scored = toxicity._Scorer(Model)
    for i in range(300):
        ids, tfs = list(range(1000 + i, 1200 + i)), [1] * 200
        assert scored(ids, tfs) == scored(ids, tfs) == Model.score(ids, tfs)
        assert len(pickle.dumps(scored.known)) <= 4 * toxicity.CACHED
    assert scored.known
    assert scored([3], [1]) == scored([3], [9]) and scored([], []) == Model.score([], [])
