"""Operator 12: centroid clustering."""

import hashlib
import math

import numpy as np
import pytest

from pageflow.llm.integers import MOST, products, squared_distances, squared_from_own
from pageflow.llm.yinyang import cluster_digest, grouped, kmeans

SCHEMA = "vec_id long, embedding array<double>, cluster int, lower string"


def lloyd(rows, k, rounds, dim):
    """Brute force in Python's integers: {vec_id: (cluster, distance)} and the centroids."""
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def assign():
        far = lambda v, w: sum((x - y) ** 2 for x, y in zip(v, w, strict=True))
        return [min((far(v, w), j) for j, w in enumerate(c)) for _, v in good]

    for _ in range(rounds):
        own = assign()
        for j in range(len(c)):
            mine = [v for (_, v), (_, a) in zip(good, own, strict=True) if a == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted((-1 if i is None else i, a, min(MOST, d)) for (i, _), (d, a) in zip(good, assign(), strict=True)), c


def clouds(n, dim, seed=1, centres=12):
    r = np.random.default_rng(seed)
    heart = r.normal(size=(centres, dim))
    x = heart[r.integers(0, centres, n)] + 0.15 * r.normal(size=(n, dim))
    x[n // 3 : 2 * n // 3] = x[0]  # a third of the rows are one vector
    return [(i, v.tolist()) for i, v in enumerate(x)]


def both(spark, rows, k, rounds, dim, **how):
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], SCHEMA).repartition(3)
    state, centroids = kmeans(df, k, rounds, dim, **how)
    got = cluster_digest(spark, state, centroids).collect()
    want, c = lloyd(rows, k, rounds, dim)
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in got) == want
    assert centroids.tolist() == c
    for r in got:
        own = [d for _, a, d in want if a == r.cluster]
        assert r.cluster_inertia == min(MOST, sum(own)) and r.inertia == min(MOST, sum(d for _, _, d in want))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()
    return got


@pytest.mark.parametrize("per_group", [1, 4, 10, 40])
def test_equals_full_scans(spark, per_group):
    got = both(spark, clouds(900, 8), 40, 5, 8, per_group=per_group)
    assert sum(r.scanned for r in got) < (0.8 if per_group < 40 else 1) * len(got) * 40 * 6  # bounds spare distances, one for all fewer


def test_bounds_spare_most_distances_of_separate_clouds(spark):
    rows = clouds(1500, 8, seed=4, centres=30)
    got = both(spark, rows, 24, 6, 8, per_group=4)
    assert sum(r.scanned for r in got) < 0.5 * len(got) * 24 * 7


def test_ties_and_repeats(spark):
    """Small integers: distances tie all the time; ids repeat."""
    r = np.random.default_rng(3)
    rows = [(int(i % 70), (r.integers(-2, 3, 4) / 256).tolist()) for i in range(200)]
    both(spark, rows, 15, 5, 4)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [-0.001, 0.5]), (None, [0.25, 0.25]), (8, []), (9, [1.0, 2.0])]
    both(spark, rows, 40, 5, 2)  # fewer rows than centroids
    both(spark, rows, 2, 5, 2)
    both(spark, rows, 3, 0, 2)  # the starts alone
    state, centroids = kmeans(spark.createDataFrame([], SCHEMA), 40, 5, 2)
    assert cluster_digest(spark, state, centroids).count() == 0


def test_large_components(spark):
    """Sums beyond doubles, then beyond 64-bit integers; distances end at a long's limit."""
    r = np.random.default_rng(5)
    for size in (2.0**20, 2.0**26, 2.0**45):
        both(spark, [(i, (size * r.normal(size=3)).tolist()) for i in range(60)], 7, 5, 3)


def test_exact_arithmetic():
    r = np.random.default_rng(2)
    for most in (100, 1 << 25, 1 << 30, 1 << 50):
        a, b = r.integers(-most, most, (5, 7)), r.integers(-most, most, (4, 7))
        dot = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
        far = [[sum((int(x) - int(y)) ** 2 for x, y in zip(p, q, strict=True)) for q in b] for p in a]
        assert products(a, b).tolist() == dot and squared_distances(a, b).tolist() == far
        assert squared_from_own(a[:4], b).tolist() == [far[i][i] for i in range(4)]


def test_groups():
    own = grouped(np.random.default_rng(1).integers(0, 99, (40, 5)))
    assert len(own) == 40 and set(own) == set(range(own.max() + 1))
    assert grouped(np.zeros((3, 2), np.int64)).tolist() == [0, 0, 0]
