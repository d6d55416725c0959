"""The registered queries of this folder: columns, and DuckDB where SQL can say it."""

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from dinelens.llm import queries

SF_SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op3_html_text": {"page_id", "url", "text", "n_chars"},
    "op6_simhash_near_dedup": {"doc_id", "fingerprint", "component_id"},
    "op7_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op8_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op9_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
}


def test_all_are_registered():
    registered = E.queries()
    assert set(queries.queries()) <= set(registered) and "pipeline" in registered
    assert [n for n in range(1, 14) if not any(k.startswith(f"op{n}_") for k in registered)] == []
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in E.oracle_sql()


@pytest.mark.parametrize("key", sorted(COLUMNS))
def test_columns_and_rows(spark, key):
    df = E.queries()[key](spark, SF_SMALL)
    assert set(df.columns) >= COLUMNS[key]
    table = "pages" if key == "op3_html_text" else "documents"
    assert df.count() >= spark.read.parquet(f"{SF_SMALL}/{table}.parquet").count()


@pytest.mark.parametrize("key", sorted(queries.oracle_sql()))
def test_matches_duckdb(spark, key):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    got = E.queries()[key](spark, SF_SMALL)
    columns = sorted(got.columns)
    found = con.execute(queries.oracle_sql()[key])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    want = sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == want
