import corpus_pipeline
from dinelens.llm import exact_dedup, simhash
from dinelens.llm.common import materialise
from tests.llm.test_decontaminate import brute as brute_contained
from tests.llm.test_packing import check
from tests.llm.test_simhash import brute_components


def brute_stages(spark, docs, bench, kept_by_first):
    """What the filtering stages after the first leave, by brute force."""
    last = {}
    for r in kept_by_first:
        t = r["text"] or ""
        if t not in last or (r["doc_id"] is not None and (last[t] is None or r["doc_id"] > last[t])):
            last[t] = r["doc_id"]
    rows = sorted((d, t) for t, d in last.items())
    comps = brute_components([simhash.fingerprint(t) for _, t in rows])
    rows = [rows[i] for i in sorted(set(comps))]
    hit = brute_contained(rows, bench)
    return [(d, t) for d, t in rows if not hit[d, t]]


def test_stages_match_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = materialise(corpus_pipeline.STAGES[0][1](spark, docs, sf_dir), "first")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = brute_stages(spark, docs, bench, first.collect())
    here = first
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        here = materialise(stage(spark, here, sf_dir), name)
        assert here.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in here.collect()) == sorted(want)
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    from dinelens.llm.tokens import public_path

    check(rows, want, public_path("byte_bpe_50k.json"))


def test_stages_on_odd_rows(spark, odd_documents, empty_documents):
    sf_dir = "/root/testdata/sf0.001"
    for docs in (odd_documents, empty_documents):
        here = docs
        for name, stage in corpus_pipeline.STAGES:
            here = materialise(stage(spark, here, sf_dir), name)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert here.columns == docs.columns
        assert (here.count() > 0) == (docs.count() > 0)


def test_no_two_equal_texts_after_exact_dedup(spark, documents):
    kept = exact_dedup.keep_one(documents).collect()
    assert len({r["text"] for r in kept}) == len(kept)
