"""Approximate nearest neighbours by a forest of random-projection trees (operator 7).

Nearness is the inner product.  One further component makes all rows equally long, so
that the largest inner product is the smallest angle, which trees can cut.  The trees are
fitted on a sample of at most `sample_rows` rows (the smallest hashes of the id); every
row is indexed.  A node's direction is the widest of a few random ones, its threshold the
sample's median; rows that lie on it (as copies of one vector do) are dealt to both sides
by the hash of their id, and searches enter both sides, so copies never crowd a leaf.

A search takes nodes of all trees from one priority queue by their distance from the
query until the leaves taken hold `visit` times as many rows as the table (a row counts in
each tree), and `floor` times k rows for each tree at least.  Leaves are cut into parts of
`block` rows.  Each part is read once and then meets the queries that came to it, batch by
batch, so neither the rows of a leaf nor its queries are ever held whole, and a row is sent
once a tree.  Scores are double-precision inner products on the original vectors, and each
query keeps its best.  A first round over each query's nearest leaf gives a score that its
k-th best reaches at least; in the second round parts return nothing below it, so what they
return follows the number of queries.

Behaviour: vectors that are null, zero, of a length other than the most common one, or
that hold null or non-finite components take no part; a null id takes no part; each row
counts by itself, also where ids repeat: it is a candidate for every other row, and a query
if its id says so; ties go to the smaller id; products that overflow count as they come out
(infinite; what is no number is left out); fewer candidates than k give fewer rows; an
empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mix64, width, written

TIE = 1e-9


class Tree:
    """A full binary tree in arrays; node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, rng, sample: np.ndarray, depth: int, tries: int = 16):
        self.depth = depth
        inner = (1 << depth) - 1
        self.way, self.at = np.zeros((inner, sample.shape[1])), np.zeros(inner)
        node = np.zeros(len(sample), np.int64)
        for level in range(depth):
            first = (1 << level) - 1
            order = np.argsort(node, kind="stable")
            cuts = np.searchsorted(node[order], np.arange(first, 2 * first + 2))
            for i in range(first, 2 * first + 1):
                own = order[cuts[i - first] : cuts[i - first + 1]]
                ways = rng.normal(size=(tries, sample.shape[1]))
                ways /= np.linalg.norm(ways, axis=1)[:, None]
                if len(own):
                    p = sample[own] @ ways.T
                    best = p.std(axis=0).argmax()
                    self.way[i], self.at[i] = ways[best], np.median(p[:, best])
                else:
                    self.way[i] = ways[0]
            node = self.step(node, sample, rng.integers(0, 1 << 62, len(sample)).astype(np.uint64))

    def step(self, node, rows, salt):
        p = np.einsum("ij,ij->i", rows, self.way[node]) - self.at[node]
        coin = (mix64(salt + node.astype(np.uint64)) & np.uint64(1)).astype(bool)
        return 2 * node + 1 + np.where(np.abs(p) <= TIE, coin, p > 0)

    def leaves(self, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        node, salt = np.zeros(len(rows), np.int64), mix64(ids.view(np.uint64))
        for _ in range(self.depth):
            node = self.step(node, rows, salt)
        return node - ((1 << self.depth) - 1)


def search(trees: list[Tree], query: np.ndarray, leaf_rows: float, want: float) -> list[tuple[int, int]]:
    """(tree, leaf) cells by one shared priority queue until they hold `want` rows."""
    inner = [len(t.at) for t in trees]
    offset = [t.way @ query - t.at for t in trees]
    queue = [(0.0, k, 0) for k in range(len(trees))]
    out: list[tuple[int, int]] = []
    while queue and (not out or len(out) * leaf_rows < want):
        far, k, node = heapq.heappop(queue)
        if node >= inner[k]:
            out.append((k, node - inner[k]))
            continue
        p = offset[k][node]
        near, other = (2 * node + 2, 2 * node + 1) if p > 0 else (2 * node + 1, 2 * node + 2)
        heapq.heappush(queue, (far, k, near))
        heapq.heappush(queue, (max(far, abs(p) - TIE), k, other))
    return out


def best_in_part(ids: np.ndarray, keys: np.ndarray, rows: np.ndarray, query_keys: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray, unit: float):
    """(query's place, row's place, score) of each query's k best in a part that reach `least`; ties go to the smaller id.

    `keys` tell rows apart.  Products of vectors over `unit` choose, those of the vectors themselves are the scores.
    """
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    most = np.finfo(np.float64).max / unit / unit  # products beyond it are infinite, and so equal
    rough = np.minimum((queries / unit) @ (rows / unit).T, most)
    rough[query_keys[:, None] == keys[None, :]] = -np.inf
    scale = np.abs(rough[np.isfinite(rough)]).max(initial=1e-300)
    floor = np.minimum(least / unit / unit, most)
    for q in range(len(query_keys)):
        r = rough[q]
        edge = np.partition(r, len(r) - k)[len(r) - k] if len(r) > k else -np.inf
        own = np.flatnonzero((r >= max(edge, floor[q]) - 1e-9 * scale) & (r > -np.inf))
        with np.errstate(over="ignore", invalid="ignore"):
            score = (rows[own] * queries[q]).sum(axis=1)
        own, score = own[~np.isnan(score)], score[~np.isnan(score)]
        top = np.lexsort((keys[own], ids[own], -score))[:k]
        out.append((np.full(len(top), q), own[top], score[top]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def usable(rows: DataFrame) -> DataFrame:
    """row, vec_id and its vector of doubles, without those that take no part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    df = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    return df.filter(~bad & F.exists("v", lambda x: x != 0)).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def forest_search(rows: DataFrame, is_query, k: int = 20, trees: int = 8, leaves: int = 64, visit: float = 1.4, floor: int = 4, sample_rows: int = 20_000, block: int = 4096, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found for each row that meets `is_query`."""
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    good, _ = written(spark, usable(rows), "vectors")
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, n = sizes
    good = good.filter(F.size("v") == dim)
    unit = float(good.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0])
    most = float(good.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / unit) * (x / unit)))).first()[0])
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id", "row").select("v").limit(sample_rows).toPandas()

    def lengthened(x: np.ndarray) -> np.ndarray:
        x = x / unit
        own = np.einsum("ij,ij->i", x, x)
        return np.column_stack((x, np.sqrt(np.maximum(most - own, 0)))) / np.sqrt(most)

    rng = np.random.default_rng(seed)
    fit = lengthened(np.array(sample["v"].tolist(), np.float64))
    depth = int(min(np.ceil(np.log2(leaves)), max(1, np.log2(max(2, len(fit) / 8)))))  # some sample rows to each leaf
    forest = [Tree(rng, fit, depth) for _ in range(trees)]
    leaf = n / (1 << depth)
    parts = int(np.ceil(leaf / block))
    held = spark.sparkContext.broadcast(forest)  # trees x leaves x (dimension + 1): bounded by the sample

    def index(batches):
        for pdf in batches:
            keys, ids, x = pdf["row"].to_numpy(), pdf["vec_id"].to_numpy(), np.array(pdf["v"].tolist(), np.float64).reshape(-1, dim)
            long, raw = lengthened(x), [r.tobytes() for r in x]
            part = (mix64(keys.view(np.uint64) + np.uint64(1)) % np.uint64(parts)).astype(np.int64)
            for t, tree in enumerate(held.value):
                yield _frame(t, tree.leaves(long, keys), part, keys, ids, raw)

    def probe(rounds):
        def run(batches):
            for pdf in batches:
                keys, ids, x = pdf["row"].to_numpy(), pdf["vec_id"].to_numpy(), np.array(pdf["v"].tolist(), np.float64).reshape(-1, dim)
                least = pdf["least"].to_numpy(np.float64)
                for at in range(0, len(ids), 64):
                    found = []
                    for i in range(at, min(at + 64, len(ids))):
                        own = x[i] / unit
                        q = np.append(own, 0.0) / np.linalg.norm(own)
                        found += [(t, c, p, 1, keys[i], ids[i], x[i].tobytes(), least[i]) for t, c in search(held.value, q, leaf, max(rounds * n, floor * k * trees * (rounds > 0))) for p in range(parts)]
                    yield _rows(found)

        return run

    cells = "tree int, leaf long, part long, kind int, row long, vec_id long, v binary, least double"
    indexed = good.mapInPandas(index, cells)
    queries = good.filter(is_query)

    def score(batches):
        import pandas as pd

        key, held_rows, ready = None, [], None
        for b in batches:
            tree, place, part, kind = (b.column(i).to_numpy() for i in range(4))
            code = np.column_stack((tree, place, part, kind))
            cuts = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]).any(axis=1)))) if len(code) else []
            for first, end in zip(cuts, [*cuts[1:], len(code)], strict=True):
                own = b.slice(first, end - first)
                keys, ids, least = (own.column(i).to_numpy() for i in (4, 5, 7))
                x = np.frombuffer(b"".join(own.column(6).to_pylist()), np.float64).reshape(-1, dim)
                if tuple(code[first, :3]) != key:
                    key, held_rows, ready = tuple(code[first, :3]), [], None
                if code[first, 3] == 0:
                    held_rows.append((keys, ids, x))
                elif held_rows:
                    ready = ready or [np.concatenate(c) for c in zip(*held_rows, strict=True)]
                    for at in range(0, len(keys), 1024):
                        few = slice(at, at + 1024)
                        q, r, s = best_in_part(ready[1], ready[0], ready[2], keys[few], x[few], k, least[few], unit)
                        yield from _batches(pd.DataFrame({"query_row": keys[few][q], "query_id": ids[few][q], "row": ready[0][r], "vec_id": ready[1][r], "score": s}))

    key = ["tree", "leaf", "part"]

    def scores(asked, rounds):
        both = indexed.unionByName(asked.mapInPandas(probe(rounds), cells))
        dealt = both.repartition(width(spark), *key).sortWithinPartitions(*key, "kind")
        return dealt.mapInArrow(score, "query_row long, query_id long, row long, vec_id long, score double")

    def ranked(scored):
        # a row found in several trees has one score, so it has one rank
        order = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
        return scored.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k)

    nothing = F.lit(float("-inf"))
    first = ranked(scores(queries.withColumn("least", nothing), 0.0))
    least = first.groupBy(F.col("query_row").alias("row")).agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("least"))
    least, _ = written(spark, least, "least")
    scored = scores(queries.join(least, "row", "left").withColumn("least", F.coalesce("least", nothing)), visit)
    best = ranked(scored).groupBy("query_row", "rank").agg(F.min("query_id").alias("query_id"), F.min("vec_id").alias("vec_id"), F.max("score").alias("score"))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _batches(pdf):
    import pyarrow as pa

    return pa.Table.from_pandas(pdf, preserve_index=False).to_batches()


def _frame(tree, cell, part, keys, ids, raw):
    import pandas as pd

    n = len(ids)
    return pd.DataFrame({"tree": np.full(n, tree, np.int32), "leaf": cell, "part": part, "kind": np.zeros(n, np.int32), "row": keys, "vec_id": ids, "v": raw, "least": np.zeros(n)})


def _rows(found):
    import pandas as pd

    return pd.DataFrame(found, columns=["tree", "leaf", "part", "kind", "row", "vec_id", "v", "least"]).astype({"tree": np.int32, "leaf": np.int64, "part": np.int64, "kind": np.int32, "row": np.int64, "vec_id": np.int64, "least": np.float64})
