import zlib

import numpy as np

from dinelens.llm import language_id


def test_held_out_accuracy_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names, table = language_id.train_text(docs)
    got = {r["doc_id"]: r for r in language_id.identify(language_id.document_records(docs), names, table).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(got) == len(truth)
    assert np.mean([got[i]["lang"] == truth[i] for i in held]) >= 0.97


def small_model():
    codes = {x: language_id.trigram_codes(t) for x, t in (("aa", "lama mala amal"), ("bb", "tok kot otko"))}
    table = np.full((language_id.TABLE, 2), 1e-6)
    for k, c in enumerate(codes.values()):
        np.add.at(table[:, k], c, 0.1)
    return list(codes), np.log(table / table.sum(axis=0)).astype(np.float32)


PAGES = "page_id long, url string, html string, lang string"


def test_evidence_is_fused(spark):
    names, table = small_model()
    page = lambda lang, text: f"<html lang={lang}><script>tok tok tok</script><p>{text}</p></html>"
    rows = [(i, f"http://a.one/aa/{i}", page("aa", "lama mala amal"), "x") for i in range(40)]
    rows += [(100 + i, f"http://b.two/bb/{i}", page("bb", "tok kot otko"), "x") for i in range(40)]
    rows += [
        (200, "http://a.one/1", "<p></p>", None),  # the host decides
        (201, "http://c.one/bb/1", "", None),  # the address decides
        (202, None, page("bb", ""), None),  # the declaration decides
        (203, None, None, None),
        (203, None, None, None),
        (None, "no url", page("zz", "lama mala"), None),
    ]
    got = language_id.identify(language_id.page_records(spark.createDataFrame(rows, PAGES)), names, table)
    assert got.columns == ["page_id", "url", "lang", "probability", "text_lang"]
    found = {r["page_id"]: r["lang"] for r in got.collect()}
    assert got.count() == len(rows)
    assert {found[i] for i in range(40)} == {"aa"} and {found[100 + i] for i in range(40)} == {"bb"}
    assert found[200] == "aa" and found[201] == "bb" and found[202] == "bb" and found[None] == "aa"


def test_posterior_equals_brute_force(spark):
    names, table = small_model()
    texts = {"aa": "lama mala amal", "bb": "tok kot otko", "ab": "lama tok", "": ""}
    rows = []
    for i in range(60):
        text, lang = list(texts)[i % 4], ("aa", "bb", "")[i % 3]
        host = ("x.co.uk", "www.x.co.uk", "y.co.uk", "z.de", "1.2.3.4")[i % 5]
        rows.append((i, f"http://{host}/{('aa', 'bb', 'long')[i // 4 % 3]}/{i}", f"<html lang={lang}><p>{texts[text]}</p></html>", None))
    records = language_id.page_records(spark.createDataFrame(rows, PAGES))
    got = {r["page_id"]: r for r in language_id.identify(records, names, table).collect()}
    evidence = {r["page_id"]: r for r in records.collect()}
    assert {r["domain"] for r in evidence.values()} == {"x.co.uk", "y.co.uk", "z.de", "1.2.3.4"}
    assert {r["address"] for r in evidence.values()} >= {"co.uk/aa", "de/bb", "/aa"}

    def tempered(source):
        codes = language_id.trigram_codes(language_id.markup_text(source))
        total = table[codes].sum(axis=0, dtype=np.float64)
        return total * min(1.0, language_id.EVIDENCE / max(1, len(codes)))

    def soft(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    logs = {i: tempered(html) for i, _, html, _ in rows}
    p = {i: soft(x) for i, x in logs.items()}
    total = sum(p.values())
    prior = (total + language_id.SMOOTH) / (total.sum() + language_id.SMOOTH * 2)

    def summed(column, value):
        return sum(p[i] for i in p if evidence[i][column] == value)

    def smoothed(sums, around):
        return (sums + language_id.PULL * around) / (sums.sum() + language_id.PULL)

    for i in p:
        e = evidence[i]
        x = logs[i] + np.log(smoothed(summed("host", e["host"]), smoothed(summed("domain", e["domain"]), prior)))
        for column in ("declared", "address"):
            if e[column] is not None:
                kinds = len({r[column] for r in evidence.values()} - {None})
                x = x + np.log((summed(column, e[column]) + language_id.SMOOTH) / (total + language_id.SMOOTH * (kinds + 1)))
        want = soft(x)
        assert abs(got[i]["probability"] - want.max()) < 2e-6
        assert want[names.index(got[i]["lang"])] > want.max() - 1e-9


def test_every_language_of_the_sample_is_kept(spark):
    rows = [(i, f"l{i:03}", f"text {i} of its own") for i in range(700)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    names, table = language_id.train_text(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert names == [lang for _, lang, _ in rows] and len(names) > 256 and table.shape[1] == len(names)


def test_odd_rows(spark, odd_documents, empty_documents):
    names, table = language_id.train_text(odd_documents)
    got = language_id.identify(language_id.document_records(odd_documents), names, table)
    assert got.count() == odd_documents.count()
    assert language_id.identify(language_id.document_records(empty_documents), names, table).count() == 0
    names, table = language_id.train_text(empty_documents)
    assert names == []
    rows = language_id.identify(language_id.document_records(odd_documents), names, table).collect()
    assert len(rows) == 12 and all(r["lang"] is None for r in rows)
