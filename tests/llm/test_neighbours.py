"""Nearest neighbours against brute force: recall, exact scores, copies, and odd rows."""

import math

import numpy as np
import pytest

from dinelens.llm import neighbours, queries

SF_SMALL = "/root/testdata/sf0.001"


def brute(rows, every, k):
    """All answers in order, by double products of all rows with the queries."""
    best = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            best[i] = min(best.get(i, v), v)
    sizes = [len(v) for v in best.values()]
    d = max(set(sizes), key=lambda s: (sizes.count(s), s), default=0)
    ids = np.array(sorted(i for i, v in best.items() if len(v) == d), np.int64)
    x = np.array([best[i] for i in ids], np.float64).reshape(len(ids), -1)
    out = {}
    for at, q in enumerate(ids):
        if q % every == 0:
            s = x @ x[at]
            order = [j for j in np.lexsort((ids, -s)) if j != at][:k]
            out[int(q)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    """Share of the true nearest found, a found row counting if its score is as large as the last true one's."""
    assert set(got) == set(want)
    hits = total = 0
    for q, near in want.items():
        assert len(got[q]) == len(near) and len({i for i, _ in got[q]}) == len(near)
        assert got[q] == sorted(got[q], key=lambda r: (-r[1], r[0])) and q not in {i for i, _ in got[q]}
        last = near[-1][1] if near else 0
        hits += sum(s >= last - 1e-12 for _, s in got[q])
        total += len(near)
    return hits / total


def given(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_query_finds_nine_in_ten(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got, want = answers(queries.queries()["op11_nearest_neighbours"](spark, SF_SMALL)), brute(rows, 20, 20)
    assert recall(got, want) >= 0.95
    x = dict(rows)
    for q, near in got.items():
        assert all(math.isclose(s, np.dot(np.float64(x[q]), np.float64(x[i])), abs_tol=1e-12) for i, s in near)


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_lengths_that_differ(spark, spread):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 12)) * np.exp(spread * rng.standard_normal((1500, 1)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert recall(answers(neighbours.nearest(given(spark, rows), every=50, k=10)), brute(rows, 50, 10)) >= 0.9


def test_copies_ties_and_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(7)
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(0, 400)] + [(1000 + i, rng.standard_normal(3).tolist()) for i in range(200)]
    rows += [(2000, None), (2020, [0.0, 0.0, 0.0]), (2040, [1.0, None, 0.0]), (2060, [nan, 1.0, 0.0]), (2080, [inf, 0.0, 0.0]), (2100, []), (2120, [1.0, 2.0])]
    rows += [(None, [9.0, 9.0, 9.0]), (1000, [50.0, 0.0, 0.0]), (40, [1.0, 0.0, 0.0]), (3000, [1e200, 0.0, 0.0])]
    df = given(spark, rows).selectExpr("*", "'x' AS node", "1 AS score", "2 AS rank")
    got, want = answers(neighbours.nearest(df)), brute(rows, 20, 20)
    assert recall(got, want) >= 0.95
    for q in (0, 200, 380):
        assert got[q] == want[q]


def test_few_rows_and_none(spark):
    rows = [(20 * i, [float(i + 1), 1.0]) for i in range(7)]
    assert answers(neighbours.nearest(given(spark, rows))) == brute(rows, 20, 20)
    assert neighbours.nearest(given(spark, rows[:1])).collect() == []
    assert neighbours.nearest(given(spark, [])).collect() == []
    assert neighbours.nearest(given(spark, [(1, [1.0]), (3, [2.0])])).collect() == []


def test_rounding_to_eight_bits():
    rows = np.random.default_rng(1).standard_normal((50, 9))
    assert np.abs(neighbours._unpack(neighbours._pack(rows)) - rows).max() <= np.abs(rows).max() / 250
