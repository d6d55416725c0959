import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from dinelens.llm import simhash
from dinelens.llm.components import connected_components


def brute_fingerprint(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in folded + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, distance=3):
    """Smallest position reachable over links of at most ``distance`` bits."""
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    v = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= distance).tolist():
            a, b = root(i), root(i + 1 + j)
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_fingerprints_and_components(documents, odd_documents, empty_documents):
    for docs in (documents, odd_documents, empty_documents):
        rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0))
        fps = {t: brute_fingerprint(t) for t in {t for _, t in rows} if t is None or len(t) < 50_000}
        fps |= {t: simhash.fingerprint(t) for _, t in rows if t not in fps}
        comps = brute_components([fps[t] for _, t in rows])
        want = sorted(((d, f"{fps[t]:016x}", rows[c][0]) for (d, t), c in zip(rows, comps, strict=True)), key=repr)
        got = simhash.near_duplicates(docs)
        assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()), key=repr) == want
        kept = simhash.one_of_each(docs)
        assert kept.schema.names == docs.schema.names
        assert len({(r["doc_id"], r["text"]) for r in kept.collect()}) == len(set(comps))


def test_slices_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(f"w{i * 7919 % 1013}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SLICE", 64)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text)


def clustered(seed, clusters, members, spread):
    rng = random.Random(seed)
    out = set()
    for _ in range(clusters):
        center = rng.getrandbits(64)
        for _ in range(members):
            v = center
            for _ in range(rng.randint(0, spread)):
                v ^= 1 << rng.randrange(64)
            out.add(v)
    return sorted(out)


@pytest.mark.parametrize("thresholds", [None, [1, 0, 0], [1, 1], [2, 0], [0, 0, 0, 0], [2, 0, -1], [1, 0, 0, -1]])
@pytest.mark.parametrize("max_bucket", [4096, 16])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, thresholds, max_bucket):
    fps = clustered(3, 25, 30, 5)
    if thresholds:
        parts = simhash.group_bits(np.array(fps, np.uint64), len(thresholds))
        monkeypatch.setattr(simhash, "plan", lambda *_: (parts, thresholds))
    signed = [int(np.uint64(v).astype(np.int64)) for v in fps]
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = simhash.hamming_links(table, 3, max_bucket)
    pairs = [(r["a"], r["b"]) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in ((x % 2**64, y % 2**64) for x, y in pairs))
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    comps = brute_components(fps)
    groups = {}
    for v, c in zip(signed, comps, strict=True):
        groups.setdefault(c, []).append(v)
    for group in groups.values():
        assert {got.get(v, v) for v in group} == {min(group)}


def test_allocation_spends_the_whole_budget():
    sample = np.array(clustered(1, 40, 5, 4), np.uint64)
    for n in (1000, 10**6, 10**9, 10**12):
        groups, ts = simhash.plan(sample, n, 3)
        assert sorted(b for g in groups for b in g) == list(range(64))
        assert sum(t + 1 for t in ts) == 4
    assert len(simhash.plan(sample, 10**3, 3)[0]) > len(simhash.plan(sample, 10**12, 3)[0])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=40, unique=True), st.integers(0, 2))
def test_forest_of_a_bucket(values, base_bits):
    fps = np.array([v & 0xFF for v in values], np.uint64)
    fps = np.unique(fps)
    probe = np.zeros(len(fps), bool)
    comps = brute_components(fps.tolist())
    found = simhash.bucket_links(fps, probe, 3, block=7)
    assert len(found) == len(fps) - len(set(comps))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 400)]
    star = [(1000, i) for i in range(1001, 1400)]
    links = spark.createDataFrame([*chain, *star, (5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert {got[i] for i in range(0, 401)} == {0}
    assert {got[i] for i in range(1000, 1400)} == {1000}
    assert connected_components(links.limit(0)).count() == 0
