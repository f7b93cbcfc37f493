"""Operator 13: hard negatives."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageflow.llm.negatives import from_limit, limits, mine_hard_negatives, ordered

SCHEMA = "vec_id long, label int, embedding array<double>, score string, rank int"


def label():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def mined(rows, anchor=lambda i: i % 50 == 0):
    """Brute force over all pairs, for ids that do not repeat."""
    good = []
    for i, lab, v in rows:
        if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * x) for x in v]))
    out = []
    for a, lab, v in good:
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, m) for i, m, w in good if i != a)
        for p, i, _ in [x for x in scored if x[2] == lab][:5]:
            fits = [(-s, j) for s, j, m in scored if m != lab and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(a, i, k + 1, j, -p, s) for k, (s, j) in enumerate(fits[:3])]
    return sorted(out)


def got(spark, rows, **how):
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, mine_hard_negatives(df, F.col("vec_id") % 50 == 0, label(), **how).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("how", [{}, {"block": 40, "chunk": 3}])
def test_equals_brute_force(spark, how):
    r = np.random.default_rng(1)
    heart = r.normal(size=(10, 8))
    rows = []
    for i in range(600):
        lab = int(r.integers(0, 10))
        rows.append((i, lab, (heart[lab] + 0.6 * r.normal(size=8)).tolist()))
    for i in range(200, 400):
        rows[i] = (i, rows[i][1], rows[200][2])  # a third of the rows are one vector
    want = mined(rows)
    assert want and got(spark, rows, **how) == want


def test_ties(spark):
    r = np.random.default_rng(2)
    rows = [(int(i), int(r.integers(0, 3)), (r.integers(-3, 4, 4) / 64).tolist()) for i in range(250)]
    want = mined(rows)
    assert want and got(spark, rows) == want


def test_odd_rows(spark):
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.4]), (2, 2, [0.7, 0.5]), (3, None, [1.0, 1.0]), (4, 2, None), (5, 2, [1.0, None]), (6, 2, [float("nan"), 1.0]), (8, 2, [float("-inf"), 1.0]), (None, 2, [0.8, 0.5]), (9, 2, [0.6, 0.5]), (50, 4, [1.0, 1.0]), (100, 1, [-1.0, -1.0]), (11, 2, [0.7, 0.5]), (12, 3, [0.0, 0.0])]
    rows = [(i, lab if i not in (0,) else 0, v) for i, lab, v in rows]  # 0 is relabelled to 1
    want = mined(rows)
    assert [x[:4] for x in want if x[0] == 0 and x[1] == 1] == [(0, 1, 1, 2), (0, 1, 2, 11), (0, 1, 3, 9)]
    assert got(spark, rows) == want
    assert got(spark, []) == []
    assert got(spark, [(0, 1, [1.0])]) == []
    assert got(spark, [(0, 1, [1.0]), (50, 1, [1.0, 2.0]), (7, 0, [1.0, 2.0]), (9, 3, [0.9, 1.1])]) == mined([(50, 1, [1.0, 2.0]), (7, 0, [1.0, 2.0]), (9, 3, [0.9, 1.1])])


def test_rows_that_share_an_id(spark):
    """A copy of an anchor is its partner, and each of them is an anchor."""
    rows = [(50, 1, [1.0]), (50, 1, [1.0]), (3, 2, [0.9]), (3, 2, [0.9])]
    assert got(spark, rows) == sorted([(50, 50, 1, 3, 65536, 58880), (50, 50, 2, 3, 65536, 58880)] * 2)


def test_large_components(spark):
    """Scores beyond doubles; and one vector so long that products go through Python's integers."""
    r = np.random.default_rng(3)
    rows = [(int(i), int(r.integers(0, 2)), (2.0**20 * r.uniform(0.2, 1, size=3)).tolist()) for i in range(0, 400, 5)]
    want = mined(rows)
    assert want and got(spark, rows) == want
    rows = [(i, lab, (np.array(v) / 2**20).tolist()) for i, lab, v in rows] + [(1, 5, [2.0**40, 0.0, 0.0])]
    want = mined(rows)
    assert want and got(spark, rows) == want


def test_limits():
    for p in range(-300, 300):
        low, high = limits(p, 50, 95)
        fits = [n for n in range(-400, 400) if 50 * p <= 100 * n <= 95 * p]
        assert fits == list(range(low, high + 1))
    s = np.array([5, 9, 5, 1, 7])
    assert ordered(s).tolist() == [1, 4, 0, 2, 3]
    assert from_limit(s, ordered(s), 7, 5, 2).tolist() == [4, 0] and from_limit(s, ordered(s), 6, 6, 3).tolist() == []
