"""Centroid clustering with Yinyang bounds (operator 12).

Lloyd's rounds over integer vectors.  The centroids are put into groups once.  Each row keeps
an upper bound of the distance to its own centroid and one lower bound for each group's other
centroids.  When centroids move, the bounds move by as much; a row whose upper bound lies under
all of its lower bounds keeps its centroid without a look (after its own distance has been
measured anew, if need be), and else only the groups whose bound it exceeds are scanned, exactly.
Bounds are compared with a margin far above rounding errors, so ties and results are those of
full scans.

State is a table: rows with their vector, centroid and bounds.  A round is one pass of it by
Arrow batches without a shuffle; the next round's state is written to the shared folder and the
last one's goes, so a lost executor costs a part of one round.  Sums change by the rows that
moved: each task adds up its own, and Spark adds these up, k x (components + 1) numbers.  Those,
the centroids and their drifts are all that passes through the driver, whatever the table.

Behaviour: vectors that are null, hold null or non-finite components, or are not of the given
length take no part; fewer rows than k give as many centroids; a null id takes part, and is
a start only where others are too few; rows that repeat count each; start hashes that tie go by
id and vector; equal distances go to the smaller number; an empty table gives no rows;
sums and distances beyond a long end at its limit; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, written
from .integers import MOST, integer_vectors, matrix, squared_distances, squared_from_own, to_long

STATE = "vec_id long, v array<long>, before int, cluster int, upper double, lower array<double>, squared long, scanned long"
#: Above what rounding does to a bound, relative and absolute.
MARGIN = 1e-9
#: Centroids of a group, about.
PER_GROUP = 10


def grouped(centroids: np.ndarray, per_group: int = PER_GROUP, steps: int = 5) -> np.ndarray:
    """A group for each centroid, by a small clustering of the centroids; every grouping gives the same results."""
    c = centroids.astype(np.float64)
    n = max(1, len(c) // per_group)
    own = np.arange(len(c)) % n
    for _ in range(steps):
        heart = np.array([c[own == g].mean(axis=0) if (own == g).any() else c[g] for g in range(n)])
        own = ((c[:, None, :] - heart[None]) ** 2).sum(axis=2).argmin(axis=1)
    return np.unique(own, return_inverse=True)[1]


def _root(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64))


def scan(x, own, best, lower, need, centroids, members):
    """Measure the rows of `need` (rows x groups) against all centroids of the groups asked for.

    `own`, `best` (squared distance from own) and `lower` change in place; gives how many distances were measured.
    """
    before, was = own.copy(), best.copy()
    found, measured = {}, np.zeros(len(x), np.int64)
    for g, m in enumerate(members):
        rows = np.flatnonzero(need[:, g])
        if len(rows):
            d = squared_distances(x[rows], centroids[m])
            at = d.argmin(axis=1)
            low, name = d[np.arange(len(rows)), at], m[at]
            better = (low < best[rows]) | ((low == best[rows]) & (name < own[rows]))
            best[rows[better]], own[rows[better]] = low[better], name[better]
            measured[rows] += len(m)
            found[g] = rows, d
    left = np.flatnonzero(own != before)
    for g, m in enumerate(members):
        back = left[np.isin(before[left], m)]  # the centroid that was theirs is another one now
        lower[back, g] = np.minimum(lower[back, g], _root(was[back]))
        if g in found:
            rows, d = found[g]
            far = _root(d)
            far[own[rows][:, None] == m[None, :]] = np.inf
            lower[rows, g] = far.min(axis=1)
    return measured


def step(x, own, upper, lower, centroids, drift, members):
    """One round's assignment of rows that have bounds; exact squared distances from their centroids, and how many were measured."""
    upper = upper + drift[own]
    lower = lower - np.array([drift[m].max() for m in members])[None, :]
    open_ = lambda: ~(lower > (upper * (1 + MARGIN) + MARGIN)[:, None])
    rows = np.flatnonzero(open_().any(axis=1))
    tight = squared_from_own(x[rows], centroids[own[rows]])
    upper[rows] = _root(tight)
    need = open_()[rows]
    now, best, low = own[rows], tight, lower[rows]
    measured = np.zeros(len(x), np.int64)
    measured[rows] = 1 + scan(x[rows], now, best, low, need, centroids, members)
    own = own.copy()
    own[rows], lower[rows], upper[rows] = now, low, _root(best)
    return own, upper, lower, measured


def first(x, centroids, members):
    """Assignment without bounds: all centroids are measured."""
    full = squared_distances(x, centroids)
    own = full.argmin(axis=1)
    far = _root(full)
    upper = far[np.arange(len(x)), own]
    far[np.arange(len(x)), own] = np.inf
    lower = np.stack([far[:, m].min(axis=1) for m in members], axis=1)
    return own, upper, lower, np.full(len(x), len(centroids), np.int64)


def _assigned(state: DataFrame, centroids: np.ndarray, drift: np.ndarray | None, members: list[np.ndarray], last: bool) -> DataFrame:
    """The state after one more assignment; with `last`, with exact squared distances."""
    dim = centroids.shape[1]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = matrix(b.column("v"), dim)
            own = b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
            if drift is None:
                now, upper, lower, measured = first(x, centroids, members)
            else:
                lower = b.column("lower").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(members))
                now, upper, lower, measured = step(x, own, b.column("upper").to_numpy(zero_copy_only=False), lower, centroids, drift, members)
            squared = to_long(squared_from_own(x, centroids[now])) if last else np.zeros(len(x), np.int64)
            measured = measured + b.column("scanned").to_numpy(zero_copy_only=False)
            bounds = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(members)), pa.array(lower.ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("v"), pa.array(own.astype(np.int32)), pa.array(now.astype(np.int32)), pa.array(upper), bounds, pa.array(squared), pa.array(measured)],
                names=["vec_id", "v", "before", "cluster", "upper", "lower", "squared", "scanned"],
            )

    return state.mapInArrow(run, STATE)


def _changes(state: DataFrame, k: int, dim: int) -> list:
    """(cluster, place, sum): what rows that moved add to and take from sums of components; place -1 counts them."""

    def run(batches):
        import pyarrow as pa

        total: dict[int, list] = {}
        for b in batches:
            x = matrix(b.column("v"), dim)
            kind = np.int64 if len(x) * max(1, int(np.abs(x.astype(np.float64)).max(initial=0))) < 1 << 62 else object
            for sign, name in ((1, "cluster"), (-1, "before")):
                c = b.column(name).to_numpy(zero_copy_only=False)
                for i in np.unique(c[c >= 0]).tolist():
                    own = x[c == i]
                    add = [sign * len(own), *(sign * int(y) for y in own.astype(kind).sum(axis=0))]
                    total[i] = [p + q for p, q in zip(total[i], add, strict=True)] if i in total else add
        for i, sums in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * len(sums), pa.int32()), pa.array(range(-1, dim), pa.int32()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], names=["cluster", "place", "sum"]
            )

    moved = state.filter("cluster <> before").select("v", "before", "cluster")
    return moved.mapInArrow(run, "cluster int, place int, sum decimal(38,0)").groupBy("cluster", "place").agg(F.sum("sum").alias("sum")).collect()


def kmeans(rows: DataFrame, k: int, rounds: int, dim: int, scale: int = 256, salt: str = "2", per_group: int = PER_GROUP) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, v, cluster, squared, scanned) after the last assignment, and the centroids they were assigned to.

    Starts are the k rows with the smallest SHA-256 of `salt:vec_id`.  `scanned` is how many
    distances were measured for a row in all; without bounds it would be k x (rounds + 1).
    """
    spark = rows.sparkSession
    base = integer_vectors(rows.filter(F.size("embedding") == dim), scale, F.col("vec_id").cast("long").alias("vec_id"))
    nothing = F.lit(-1).cast("int")
    state = base.select("vec_id", "v", nothing.alias("before"), nothing.alias("cluster"), F.lit(0.0).alias("upper"), F.array().cast("array<double>").alias("lower"), F.lit(0).cast("long").alias("squared"), F.lit(0).cast("long").alias("scanned"))
    state, path = written(spark, state, "yinyang")
    start = state.orderBy(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "vec_id", "v").select("v").limit(k).collect()
    if not start:
        return state.select("vec_id", "v", "cluster", "squared", "scanned"), np.zeros((0, dim), np.int64)
    centroids = np.array([r.v for r in start], np.int64)
    own = grouped(centroids, per_group)
    members = [np.flatnonzero(own == g) for g in range(own.max() + 1)]
    sums = [[0] * (dim + 1) for _ in centroids]
    drift = None
    for r in range(rounds + 1):
        state, now = written(spark, _assigned(state, centroids, drift, members, r == rounds), "yinyang")
        drop_path(spark, path)
        path = now
        if r < rounds:
            for c in _changes(state, len(centroids), dim):
                sums[c["cluster"]][c["place"] + 1] += int(c["sum"])
            moved = np.array([[x // s[0] for x in s[1:]] if s[0] else c.tolist() for s, c in zip(sums, centroids, strict=True)], np.int64)
            drift = _root(squared_from_own(moved, centroids))
            centroids = moved
    return state.select("vec_id", "v", "cluster", "squared", "scanned"), centroids


def cluster_digest(spark: SparkSession, state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scanned of each row."""
    spent = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(F.col("squared").cast("decimal(38,0)")).alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    of = [(i, min(MOST, spent.get(i, 0)), min(MOST, sum(spent.values())), digest(c)) for i, c in enumerate(centroids)]
    facts = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = state.join(F.broadcast(facts), "cluster")  # a row a centroid: k at most
    return out.select("vec_id", "cluster", F.col("squared").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256", "scanned")
