import re

from dinelens.llm import decontaminate


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, items, t=0.8):
    out = {}
    sets = [(i, shingles(x)) for i, x in items]
    for d, x in docs:
        s = shingles(x)
        out.setdefault((d, x), sorted((i for i, q in sets if q and len(q & s) >= t * len(q) - 1e-9), key=lambda v: (v is not None, v or 0)))
    return out


ITEMS = [(1, "one two three four five six seven eight nine ten"), (2, "short item"), (3, None), (4, "..."), (None, "one two three four five six"), (5, "w1 w2 w3 w4 w5 w6")]


def test_matches_brute_force(spark, documents, odd_documents, empty_documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    extra = spark.createDataFrame(
        [
            (1, "zero one two three four five six seven eight nine ten"),
            (2, "ONE, two; three four five six seven eight nine TEN!"),
            (2, "one two three four five six seven eight"),
            (3, "one two three four five six seven"),
            (4, "Short item."),
            (5, "a short item in more words"),
        ],
        "doc_id long, text string",
    )
    for docs, its in ((documents, bench), (odd_documents, items), (extra, items), (empty_documents, bench), (extra, items.limit(0))):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        pairs = [(r["item_id"], r["text"]) for r in its.collect()]
        want = brute(rows, pairs)
        got = decontaminate.decontaminate(docs, its).collect()
        expected = sorted((d, len(want[d, x]), ",".join(str(i) for i in want[d, x] if i is not None)) for d, x in rows if d is not None)
        assert sorted((r["doc_id"], r["n_items"], r["item_ids"]) for r in got if r["doc_id"] is not None) == expected
        assert len(got) == len(rows)
        clean = decontaminate.clean_documents(docs, its)
        assert clean.schema.names == docs.schema.names
        assert sorted((r["doc_id"], r["text"] or "") for r in clean.collect() if r["doc_id"] is not None) == sorted((d, x or "") for d, x in rows if d is not None and not want[d, x])


def test_partial_overlap_at_the_threshold(spark):
    item = [f"a{i}" for i in range(14)]  # 10 shingles, 8 needed
    docs = [(k, " ".join(["x"] * 300 + item[:k] + ["y"] * 300)) for k in range(5, 15)]
    found = decontaminate.decontaminate(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    )
    assert {r["doc_id"] for r in found.collect() if r["contaminated"]} == {12, 13, 14}


def test_native(documents, spark, capsys):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    decontaminate.decontaminate(documents, bench).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
