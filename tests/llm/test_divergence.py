"""The audit against DuckDB, against a plain Python version, and its odd inputs."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from dinelens.llm import divergence, queries

SF_SMALL = "/root/testdata/sf0.001"


def brute(rows, top=200):
    """The contract, literally: ``rows`` of (text, lang, source)."""
    lower = str.maketrans(divergence.UPPER, divergence.LOWER)
    docs = [([t.translate(lower) for t in re.findall(divergence.TERM, text or "")], lang or "", source or "") for text, lang, source in rows]
    df, groups = defaultdict(Counter), defaultdict(Counter)
    for terms, lang, source in docs:
        df[lang].update(set(terms))
        groups[lang, source].update(terms)
    out = []
    for lang in {lang for lang, _ in groups}:
        vocab = {t for t, n in df[lang].items() if n >= 3}
        sources = sorted(s for x, s in groups if x == lang)
        count = {s: {t: groups[lang, s][t] for t in vocab} for s in sources}
        whole = {t: sum(count[s][t] for s in sources) for t in vocab}

        def shares(of, v=len(vocab)):
            total = sum(of.values())
            return {t: 1 + 1000000000 * (c + 1) // (total + v) for t, c in of.items()}

        p, q = {s: shares(count[s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in vocab), o) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in vocab if count[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_query_equals_brute_force_and_duckdb(spark, documents):
    got = found(queries.queries()["op13_source_divergence"](spark, SF_SMALL))
    assert got == brute([tuple(r) for r in documents.select("text", "lang", "source").collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    sql = queries.oracle_sql()["op13_source_divergence"]
    assert got == sorted(con.execute(f"SELECT lang, source, part, item, value, rank FROM ({sql})").fetchall())


def test_three_documents_decide_over_flushes_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "MAX_HELD", 3)
    monkeypatch.setattr(divergence, "MAX_CELLS", 4)
    texts = [
        ("one, two three", "en", "a"), ("ONE. two; (four)", "en", "b"), ("one! five two/two", "en", "c"), ("two's one", "en", "c"),
        ("five, five5five", "en", "a"), ("four", "en", "a"), ("four four", "en", "d"),
        ("ÄRGER Ärger x ärger", "de", "a"), ("Ärger　x", "de", "b"), ("Ärger", "de", "b"), ("Ärger", "de", None),
        (None, None, None), ("", "fr", "a"), ("nur einmal", "fr", "b"), ("same", "", ""), ("same", "", ""), ("same", "", "z"),
    ]
    docs = spark.createDataFrame(texts, "text string, lang string, source string").repartition(4)
    assert found(divergence.audit(divergence.materialise(docs, "given"))) == brute(texts)


def test_odd_documents(spark, odd_documents, empty_documents):
    stored = divergence.materialise(odd_documents, "odd")
    rows = [tuple(r) for r in stored.select("text", "lang", "source").collect()]
    assert found(divergence.audit(stored)) == brute(rows)
    assert found(divergence.audit(empty_documents)) == []


def test_shares_beyond_long(spark):
    row = spark.range(1).select(divergence.share(divergence.F.lit(4 * 10**12), divergence.F.lit(9 * 10**12), divergence.F.lit(7)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (4 * 10**12 + 1) // (9 * 10**12 + 7)


@pytest.mark.parametrize("chunk,terms", [("It's", {"it": 1, "s": 1}), ("12-34", {}), ("a1A,a", {"a": 3}), ("É\u0085é", {"É\u0085é": 1})])
def test_chunk_terms(spark, chunk, terms):
    df = spark.createDataFrame([(chunk,), (chunk,)], "chunk string")
    assert {r["term"]: r["times"] for r in divergence.chunk_terms(df).collect()} == terms


def test_counts_of_chunks_are_added_up_once(spark):
    docs = spark.createDataFrame([("one two-two, two-two,", "en", s) for s in "abc"], "text string, lang string, source string")
    kept = divergence.kept_terms(divergence.chunk_counts(docs))
    plan = kept._jdf.queryExecution().toString()
    assert "Join" not in plan and plan.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].count("MapInArrow") == 1
    assert sorted((r["term"], r["source"], r["n"], r["n_lang"]) for r in kept.collect()) == [(t, s, n, 3 * n) for t, n in (("one", 1), ("two", 4)) for s in "abc"]
