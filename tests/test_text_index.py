"""The search index finds what the scan finds, and reads less."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dinelens.functions.search import rx_search
from dinelens.operators import text_index
from dinelens.operators.text_index import TextIndex, pattern_grams

TEXTS = [
    "Great STRASSE food", "straße und Straße", "ABC abc aBc", "the cat sat", "The Cat", "tAb\tbed", "line\nbreak here",
    "Kelvin scale", "miſsion", "İzmir ızmir izmir", "日本語テキスト検索", "prices: $5.00 (net)", "a.b.c", "xyz" * 50, "", None, "ab", "ÀÉÎ àéî", "cot cut cat", "aaab", "aab",
]
PATTERNS = [
    "the", "cat|dog", "c[aou]t s", "strasse", "stra(ss|ß)e", "kelvin", "mission", "izmir", "日本語", "検索", r"\$5\.00", r"a\.b", "(xyz){3}", "abc?", "ab+c", "a{2,3}b", r"line\sbreak",
    "àéî", "É", "b.*k he", "^the", "here$", r"\bcat\b", "x*yzx", "[^a-z]net", "a.b.c", "cat sat|", "", r"\Qa.b\E", "(?s)line.break", "[a[b]]c", "izmir|elvin sc",
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, body string").repartition(3)


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    return TextIndex.build(rows, "body", str(tmp_path_factory.mktemp("index")), rows_per_part=4)


@pytest.mark.parametrize("literal", [False, True])
@pytest.mark.parametrize("pattern", PATTERNS)
def test_equals_the_scan(rows, index, pattern, literal):
    want = sorted(r["id"] for r in rows.filter(rx_search("body", pattern, literal)).collect())
    assert sorted(r["id"] for r in index.search(pattern, literal).collect()) == want


@settings(max_examples=25, deadline=None)
@given(st.text("abcAB.|?+*()[]{}1,\\ ^$", min_size=1, max_size=9))
def test_any_pattern_equals_the_scan(rows, index, pattern):
    try:
        want = sorted(r["id"] for r in rows.filter(rx_search("body", pattern)).collect())
    except Exception:
        return  # no regular expression
    assert sorted(r["id"] for r in index.search(pattern).collect()) == want


def test_trigrams_of_patterns():
    assert pattern_grams("the cat") == [{"the", "he ", "e c", " ca", "cat"}]
    assert pattern_grams("abcd?ef") == [{"abc"}]
    assert pattern_grams("abc+def") == [{"abc", "def"}]
    assert pattern_grams("one|two") == [{"one"}, {"two"}]
    assert pattern_grams("THİS") == [{"thi", "his"}]
    assert pattern_grams("(abc)def") == [{"def"}]
    for none in ("ab", "one|to", "a.b", "[abc]+", "(?i)abc", r"\Qabc\E", "(abc)", "àéîõü"):
        assert pattern_grams(none) is None
    assert pattern_grams("a.bcd*", literal=True) == [{"a.b", ".bc", "bcd", "cd*"}]


def test_fewer_texts_are_read(spark, tmp_path):
    many = spark.range(4000).select("id", F.concat(F.lit("common words number "), F.md5(F.col("id").cast("string"))).alias("body"))
    index = TextIndex.build(many.coalesce(1), "body", str(tmp_path), rows_per_part=100)
    key = many.filter("id = 777").first()["body"][-12:]
    found = index.search(key)
    assert [r["id"] for r in found.collect()] == [777]
    assert index.survivors(key).count() <= 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(_part" in plan or "EqualTo(_part" in plan
    # no posting list is longer than a part, however common the trigram
    assert index.postings.agg(F.max(F.size("rows"))).first()[0] == 100
    assert index.search("common words").count() == 4000


def test_more_parts_than_are_pushed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "MAX_PUSHED_PARTS", 1)
    many = spark.range(50).select("id", F.lit("same text").alias("body"))
    index = TextIndex.build(many, "body", str(tmp_path), rows_per_part=5)
    assert index.search("same").count() == 50 and index.search("other").count() == 0
