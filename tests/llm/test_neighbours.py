"""Operator 7: nearest neighbours."""

import numpy as np
from pyspark.sql import functions as F

from pageflow.llm.neighbours import forest_search

def query():
    return F.col("vec_id") % 20 == 0


def exact(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        s[i] = -np.inf
        top = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in top]
    return out


def test_recall_and_ranks(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 16)) * r.uniform(0.2, 3, size=(3000, 1))
    x[500:1400] = x[500]  # a third of the rows are one vector
    ids = np.arange(3000)
    want = exact(ids, x, 20)
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, leaf int")
    got = {}
    for row in forest_search(df, query()).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.rank, row.vec_id, row.score))
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in w}) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        assert [k for k, _, _ in found] == list(range(1, len(found) + 1))
        assert len({v for _, v, _ in found}) == len(found) and q not in {v for _, v, _ in found}
        order = [(-s, v) for _, v, s in found]
        assert order == sorted(order)
        assert all(abs((x[q] * x[v]).sum() - s) < 1e-9 for _, v, s in found)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [1.0]), (7, [float("inf"), 0.0]), (None, [1.0, 1.0]), (8, [0.9, 0.1]), (20, [0.0, 1.0])]
    got = forest_search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), query(), k=3).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 8), (0, 3, 20), (20, 1, 1), (20, 2, 8), (20, 3, 0)]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert forest_search(none, query()).count() == 0
    assert forest_search(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>"), query()).count() == 0


def test_rows_that_share_an_id(spark):
    """Each row is a candidate and, if its id says so, a query."""
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.5, 0.5])]
    got = forest_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), query(), k=5).collect()
    by_id = {}
    for r in sorted(got):
        by_id.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert by_id[0] == [(1, 1, 1.0), (2, 1, 1.0), (3, 20, 0.5), (4, 1, 0.0), (5, 20, 0.0)]
    first, second = [(1, 1, 1.0), (2, 20, 0.5), (3, 0, 0.0), (4, 1, 0.0), (5, 1, 0.0)], [(1, 0, 0.5), (2, 1, 0.5), (3, 1, 0.5), (4, 1, 0.5), (5, 20, 0.5)]
    assert by_id[20] == sorted(first + second)


def test_large_components(spark):
    rows = [(i, [1e200 * (i + 1), 1e190, -1e120]) for i in range(30)]
    got = forest_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), query(), k=4).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4), (20, 1, 0), (20, 2, 1), (20, 3, 2), (20, 4, 3)]
    small = [(i, [1e-3 * (i + 1), 0.5]) for i in range(400)]
    got = forest_search(spark.createDataFrame(small, "vec_id long, embedding array<double>"), query(), k=2).filter("query_id = 100").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [399, 398]
