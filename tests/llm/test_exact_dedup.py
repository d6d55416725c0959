import hashlib

from pyspark.sql import functions as F

from dinelens.llm import exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_matches_brute_force(documents, odd_documents, empty_documents):
    for docs in (documents, odd_documents, empty_documents):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert as_rows(exact_dedup.exact_groups(docs)) == brute(rows)


def test_colliding_hashes_keep_texts_apart(documents, odd_documents):
    weak = lambda text: F.unhex(F.hex(F.length(text) % 3))
    for docs in (documents, odd_documents):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert as_rows(exact_dedup.exact_groups(docs, hash128=weak)) == brute(rows)
        kept = exact_dedup.keep_one(docs, hash128=weak)
        assert kept.count() == len({t or "" for _, t in rows})


def test_keep_one_returns_whole_rows(odd_documents, empty_documents):
    kept = exact_dedup.keep_one(odd_documents)
    assert kept.schema.names == odd_documents.schema.names
    rows = {tuple(r) for r in odd_documents.collect()}
    got = [tuple(r) for r in kept.collect()]
    assert set(got) <= rows
    assert sorted(r[0] for r in got if r[0] is not None) == [2, 4, 5, 6, 7, 8, 9]
    assert exact_dedup.keep_one(empty_documents).count() == 0


def test_no_python_and_texts_shuffled_once(documents, capsys):
    exact_dedup.exact_groups(documents).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
