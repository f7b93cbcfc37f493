"""Hard negatives by a full score sort for each anchor (operator 13).

Scores are integer inner products.  Rows are dealt to blocks by a hash of the row, anchors to
chunks, and each pair of block and chunk is a group of the shuffle: the block's rows come
first, are ordered by id once and held (a bounded number), and the anchors then pass as a
stream.  For each anchor all scores of the block are computed and sorted with the ids, highest
first.  A first pass reads the best rows of the anchor's own label from each block's order and
keeps the best of all blocks: the positives.  A second pass finds each positive's upper limit
in the order of the rows of other labels by binary search and reads on from there down to the
lower limit; the best over all blocks are the negatives.  Each block gives a few rows for an
anchor, so neither all scores of an anchor nor all rows of a label are ever gathered, and no
limit is set to what is compared.

Behaviour: rows with a null id, label or vector, with a null or non-finite component, or of a
length other than the most common one take no part; rows count each, also where ids repeat
(a row is not its own partner, a copy of it is); equal scores go by the smaller id, then by the
row; anchors without a row of their label give none; negative limits hold as they are written,
so a positive below 0 has no negatives; scores beyond a long end at its limit; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import width, written
from .integers import integer_vectors, matrix, products, to_long

#: Anchors whose scores are held at a time.
TOGETHER = 64


def ordered(score: np.ndarray) -> np.ndarray:
    """Places of a block whose rows stand in the order of their ids: highest scores first, ties as they stand."""
    return np.argsort(-score, kind="stable")


def from_limit(score: np.ndarray, order: np.ndarray, upper: int, lower: int, most: int) -> np.ndarray:
    """The first places in an order from the highest score, of which the scores lie between the limits."""
    down = -score[order]
    at = int(np.searchsorted(down, -upper, "left"))
    few = order[at : at + most]
    return few[score[few] >= lower]


def limits(positive: int, lower: int, upper: int) -> tuple[int, int]:
    """The least and the largest integer n with lower * positive <= 100 n <= upper * positive."""
    return -(-lower * positive // 100), upper * positive // 100


def mining_rows(rows: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """row, vec_id, label, v of the rows that take part."""
    good = integer_vectors(rows, scale, F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"))
    return good.filter("vec_id IS NOT NULL AND label IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v")


def _pairs(good: DataFrame, anchors: DataFrame, blocks: int, chunks: int, dim: int, work, schema: str) -> DataFrame:
    """work(block, anchors) for each block of rows and each stretch of anchors of a chunk."""
    deal = lambda by, n: F.pmod(F.xxhash64("row", F.lit(by)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.array().cast("array<long>")
    held = good.select(F.lit(0).alias("kind"), deal(1, blocks).alias("block"), each(chunks).alias("chunk"), "row", "vec_id", "label", "v", none.alias("known"))
    asked = anchors.select(F.lit(1).alias("kind"), deal(2, chunks).alias("chunk"), each(blocks).alias("block"), "row", "vec_id", "label", "v", "known")
    both = held.unionByName(asked).repartition(width(good.sparkSession), "block", "chunk").sortWithinPartitions("block", "chunk", "kind", "vec_id", "row")

    def run(batches):
        key, parts, ready = None, [], None
        for b in batches:
            code = np.column_stack([b.column(n).to_numpy() for n in ("block", "chunk", "kind")])
            cuts = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]).any(axis=1)))) if len(code) else []
            for at, end in zip(cuts, [*cuts[1:], len(code)], strict=True):
                own = b.slice(at, end - at)
                if tuple(code[at, :2]) != key:
                    key, parts, ready = tuple(code[at, :2]), [], None
                if code[at, 2] == 0:
                    parts.append([*(own.column(n).to_numpy() for n in ("row", "vec_id", "label")), matrix(own.column("v"), dim)])
                elif parts:
                    ready = ready or [np.concatenate(x) for x in zip(*parts, strict=True)]
                    for few in range(0, own.num_rows, TOGETHER):
                        yield work(ready, own.slice(few, TOGETHER))

    return both.mapInArrow(run, schema)


def mine_hard_negatives(rows: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, lower: int = 50, upper: int = 95, scale: int = 256, block: int = 32_768, chunk: int = 8192) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its best other rows of the same label; a positive's negatives are the
    best rows of other labels whose score is `lower` to `upper` hundredths of the positive's.
    """
    import pyarrow as pa

    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    good, _ = written(spark, mining_rows(rows, label, scale), "mining")
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, n = sizes
    good = good.filter(F.size("v") == dim)
    anchors = good.filter(is_anchor)
    blocks = max(-(-n // block), width(spark))
    chunks = max(1, -(-anchors.count() // chunk))

    def best(ready, own):
        """The best rows of each anchor's label in a block."""
        keys, ids, labels, x = ready
        scores = products(matrix(own.column("v"), dim), x)
        out = []
        for i, (row, name, lab) in enumerate(zip(*(own.column(c).to_pylist() for c in ("row", "vec_id", "label")), strict=True)):
            places = ordered(scores[i])
            mine = places[(labels[places] == lab) & (keys[places] != row)][:positives]
            out.append((np.full(len(mine), row), np.full(len(mine), name), keys[mine], ids[mine], to_long(scores[i][mine])))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["anchor", "anchor_id", "row", "vec_id", "score"])

    found = _pairs(good, anchors.withColumn("known", F.array().cast("array<long>")), blocks, chunks, dim, best, "anchor long, anchor_id long, row long, vec_id long, score long")
    first = W.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    chosen = found.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives)
    chosen, _ = written(spark, chosen.select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    known = chosen.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("k"))  # at most `positives` each
    known = known.select(F.col("anchor").alias("row"), F.transform("k", lambda k: k["positive_score"]).alias("known"))

    def below(ready, own):
        """The best rows of other labels within each positive's limits in a block."""
        keys, ids, labels, x = ready
        scores = products(matrix(own.column("v"), dim), x)
        out = []
        for i, (row, name, lab, scored) in enumerate(zip(*(own.column(c).to_pylist() for c in ("row", "vec_id", "label", "known")), strict=True)):
            places = ordered(scores[i])
            others = places[labels[places] != lab]
            for k, p in enumerate(scored):
                least, most = limits(p, lower, upper)
                got = from_limit(scores[i], others, most, least, negatives)
                out.append((np.full(len(got), row), np.full(len(got), name), np.full(len(got), k + 1), keys[got], ids[got], to_long(scores[i][got])))
        names = ["anchor", "anchor_id", "place", "row", "negative_id", "negative_score"]
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 6
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    scanned = _pairs(good, anchors.join(known, "row"), blocks, chunks, dim, below, "anchor long, anchor_id long, place long, row long, negative_id long, negative_score long")
    order = W.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id", "row")
    ranked = scanned.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.join(chosen, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
