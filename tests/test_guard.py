"""The guard of ad-hoc SQL: what is refused, however it is wrapped, and what still runs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dinelens.operators.adhoc import FUNCTIONS, guarded_sql, refusal


@pytest.fixture(scope="module")
def views(spark):
    return {"t": spark.range(100).selectExpr("id", "id % 7 AS k", "cast(id AS string) AS s"), "u": spark.range(5000).selectExpr("id AS uid")}


CALL = "reflect('java.lang.System', 'getProperty', 'user.name')"
WIDE = ", ".join(f"id AS a{i}" for i in range(60))
REFUSED = [
    f"SELECT {CALL} FROM t",
    f"SELECT {WIDE}, {CALL} FROM t",
    f"SELECT {WIDE} FROM t WHERE id IN (SELECT length({CALL}) FROM t)",
    f"SELECT {WIDE}, (SELECT max({CALL}) FROM t) AS x FROM t",
    f"WITH c AS (SELECT {WIDE}, {CALL} AS z FROM t) SELECT * FROM c",
    f"SELECT * FROM (SELECT {WIDE}, {CALL} AS z FROM t) q",
    f"SELECT id FROM t ORDER BY {CALL}",
    f"SELECT k, sum(id) FROM t GROUP BY k HAVING max({CALL}) = 'x'",
    f"SELECT max(id) OVER (PARTITION BY {CALL}) FROM t",
    f"SELECT CASE WHEN id > 1 THEN {CALL} END FROM t",
    f"SELECT id FROM t UNION ALL SELECT {CALL} FROM t",
    f"SELECT transform(array(id), x -> {CALL}) FROM t",
    "SELECT java_method('java.util.UUID', 'randomUUID') FROM t",
    "SELECT try_reflect('java.util.UUID', 'randomUUID') FROM t",
    "SELECT input_file_name() FROM t",
    "SELECT raise_error('x') FROM t",
    "SELECT spark_catalog.default.f(id) FROM t",
    "SELECT * FROM secret",
    "SELECT * FROM t WHERE id IN (SELECT id FROM secret)",
    "WITH t2 AS (SELECT * FROM secret) SELECT * FROM t2",
    "SELECT * FROM parquet.`/etc`",
    "SELECT * FROM read_files('/etc')",
    "SELECT * FROM t LATERAL VIEW json_tuple(s, 'a') j AS b",
    "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM t",
    "DROP TABLE t", "INSERT INTO t VALUES (1, 2, 'x')", "SET a=b", "SHOW TABLES", "SELECT 1; SELECT 2", "nonsense", "EXPLAIN SELECT 1",
]
ALLOWED = [
    "SELECT k, count(*), round(avg(id), 2) AS m FROM t GROUP BY k HAVING count(*) > 1 ORDER BY m DESC LIMIT 3",
    "WITH c AS (SELECT k FROM t) SELECT DISTINCT upper('reflect drop table') AS x, k FROM c",
    "SELECT a.id FROM t a JOIN u ON a.id = u.uid WHERE a.s LIKE '1%' AND EXISTS (SELECT 1 FROM u b WHERE b.uid = a.id)",
    "SELECT row_number() OVER (PARTITION BY k ORDER BY id) AS r, CAST(s AS int) + 1 AS n FROM t",
    "SELECT k, e FROM t LATERAL VIEW explode(split(s, '')) x AS e",
    "SELECT a.id, (SELECT max(uid) FROM u) AS m FROM t a CROSS JOIN (SELECT count(*) AS n FROM u) c",
    f"SELECT {WIDE} FROM t",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, views, sql):
    found = guarded_sql(spark, sql, views)
    assert not found.ok and found.frame is None


@pytest.mark.parametrize("sql", ALLOWED)
def test_allowed(spark, views, sql):
    found = guarded_sql(spark, sql, views)
    assert found.ok, found.error
    assert found.fetch()[0]


def test_joins_of_everything_and_large_reads(spark, views):
    for sql in ("SELECT * FROM u a, u b", "SELECT * FROM u a JOIN u b ON a.uid < b.uid", "SELECT count(*) FROM u a CROSS JOIN u b CROSS JOIN t"):
        assert "without an equality" in guarded_sql(spark, sql, views).error
    assert "bytes" in guarded_sql(spark, "SELECT * FROM u", views, max_bytes=10).error
    assert guarded_sql(spark, "SELECT * FROM u a JOIN u b ON a.uid = b.uid AND a.uid < 7", views).ok


WRAPS = [
    "SELECT {0} FROM t", "SELECT id FROM t WHERE {0} IS NOT NULL", "SELECT * FROM (SELECT {0} AS x FROM t) q", "WITH c AS (SELECT {0} AS x FROM t) SELECT x FROM c",
    "SELECT max({0}) FROM t GROUP BY k", "SELECT id FROM t WHERE EXISTS (SELECT 1 FROM u WHERE {0} = 'x')", "SELECT a.id FROM t a JOIN u b ON a.id = b.uid AND {0} = 'y'",
]
HIDES = ["{0}", "coalesce(NULL, {0})", "CASE WHEN k = 1 THEN {0} ELSE s END", "concat(s, {0})", "(SELECT max({0}) FROM t)", "cast({0} AS string)", "array({0})[0]"]


@settings(max_examples=40, deadline=None)
@given(st.sampled_from(WRAPS), st.lists(st.sampled_from(HIDES), min_size=1, max_size=3), st.sampled_from(["reflect('a.B', 'c')", "version()", "uuid()", "length(s)"]))
def test_a_call_is_found_wherever_it_is(spark, wrap, hides, call):
    inner = call
    for h in hides:
        inner = h.format(inner)
    why = refusal(spark, wrap.format(inner), ["t", "u"])
    if call == "length(s)":
        assert why is None
    else:
        assert why == f"function not allowed: {call.partition('(')[0]}"


def test_the_list_holds_no_way_out():
    assert not FUNCTIONS & {"reflect", "java_method", "try_reflect", "input_file_name", "raise_error", "from_avro", "xpath", "uuid", "rand", "current_user"}
