"""Spelling variants against brute force over all two words, and odd inputs."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dinelens.llm import queries, spelling

SF_SMALL = "/root/testdata/sf0.001"


def near(a, b):
    """One inserted, deleted or replaced code point, by trying each place."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least_chars=6, least_count=5, divisor=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % divisor == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_count}
    holes = defaultdict(set)  # two near words share a word with a hole, or one is the other's
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "?" + w[i + 1 :]].add(w)
            holes[w[:i] + w[i + 1 :]].add(w)
        holes[w].add(w)
    links = defaultdict(set)
    for group in holes.values():
        for a in group:
            links[a].update(b for b in group if near(a, b))
    form = {}
    for w, n in words.items():
        best = min(links[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n, len(links[w]), words.get(form[w])) for w, n in words.items())


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_equals_brute_force(spark, documents):
    want = brute([tuple(r) for r in documents.select("doc_id", "text").collect()])
    got = found(queries.queries()["op12_spelling_variants"](spark, SF_SMALL))
    assert got == want and sum(1 for r in got if r[1]) > 5


@pytest.mark.parametrize("levels,max_subtree", [(1, 7), (3, 10), (16, 40)])
def test_cells_and_depths_change_nothing(spark, documents, levels, max_subtree):
    rows = [tuple(r) for r in documents.select("doc_id", "text").limit(60).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(spelling.variants(docs, least_chars=4, least_count=1, divisor=7, levels=levels, max_subtree=max_subtree))
    assert got == brute(rows, 4, 1, 7)


def test_anagrams_chains_and_long_words(spark):
    long = "ab" * 300
    words = {"aabbab": 5, "ababab": 6, "bababa": 5, "kitten": 5, "sitten": 25, "sittin": 130, "sitting": 700, "Éclair": 5, "éclair": 25, long: 5, long + "a": 25, long[:50] + "z" + long[51:]: 5, long[:64]: 9, long[:65]: 9}
    rows = [(None, " ".join([w] * n)) for w, n in words.items()] + [(3, None), (4, ""), (None, None)]
    got = found(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), divisor=10**9))
    assert got == brute(rows, divisor=10**9)
    by = {r[0]: r for r in got}
    assert by["kitten"][1:3] == ("sitten", "sitting") and by["Éclair"][1] == "éclair" and by[long][4] == 2


def test_odd_documents(spark, odd_documents, empty_documents):
    rows = [tuple(r) for r in odd_documents.select("doc_id", "text").collect()]
    assert found(spelling.variants(odd_documents, 4, 1, 3)) == brute(rows, 4, 1, 3)
    assert found(spelling.variants(empty_documents)) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abÀ", min_size=1, max_size=6), min_size=1, max_size=12))
def test_verification(words):
    table = spelling.Letters(words)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    got = spelling.one_apart(table, table, i, j)
    assert got.tolist() == [near(words[a], words[b]) for a, b in zip(i, j, strict=True)]
    assert got.tolist() == [spelling._one_apart(words[a], words[b]) for a, b in zip(i, j, strict=True)]
