"""Best-fit packing with large-item matching (operator 9).

Lengths are integers up to the capacity, so the plan is made on the histogram of lengths:
at most `capacity` numbers, whatever the number of documents.  Pieces longer than a third
of the capacity go two to a bin at most, matched greedily (the largest with the largest
that fits); shorter ones fill the tightest gap that holds them, largest first.  Equal
lengths are handled as one run, which gives what one-by-one placement gives.

Each piece then gets its rank among those of its length: counted within salted groups,
so that a length that many copies share is spread over tasks, and shifted by the counts
of the groups before.  The rank leads to a bin and an offset.

Behaviour: null text counts as empty (its end id only); repeated rows are packed each;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, tidy, width, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, pieces, first bin, pieces a bin, offset): bins in a row get the same."""
    rows: list[tuple[int, int, int, int, int, int]] = []
    taken = dict.fromkeys(counts, 0)
    runs: dict[int, list[tuple[int, int]]] = {}
    gaps: list[int] = []
    bins = 0

    def give(length: int, n: int, first: int, each: int, offset: int) -> None:
        rows.append((length, taken[length], n, first, each, offset))
        taken[length] += n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append((first, n))

    left = {k: n for k, n in counts.items() if n}
    if any(k > capacity or k < 1 for k in left):
        raise ValueError("a length is outside 1..capacity")
    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        i = bisect_left(large, capacity - a + 1) - 1
        if i >= 0 and large[i] == a and left[a] == 1:
            i -= 1  # the last one of its length has no equal partner
        if i >= 0:
            b = large[i]
            n = left[a] // 2 if a == b else min(left[a], left[b])
        if i < 0:
            n = left[a]
            give(a, n, bins, 1, 0)
            leave(capacity - a, bins, n)
            left[a] = 0
        elif a == b:
            give(a, 2 * n, bins, 2, 0)
            leave(capacity - 2 * a, bins, n)
            left[a] -= 2 * n
        else:
            give(a, n, bins, 1, 0)
            give(b, n, bins, 1, a)
            leave(capacity - a - b, bins, n)
            left[a] -= n
            left[b] -= n
        bins += n
        large = [k for k in large if left[k]]
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        n = left[s]
        while n:
            i = bisect_left(gaps, s)
            if i == len(gaps):
                m = -(-n // (capacity // s))
                leave(capacity, bins, m)
                bins += m
                continue
            gap = gaps[i]
            first, m = runs[gap].pop()
            if not runs[gap]:
                del runs[gap], gaps[i]
            each = gap // s
            full, rest = (m, 0) if n >= each * m else divmod(n, each)
            if full:
                give(s, full * each, first, each, capacity - gap)
                leave(gap - each * s, first, full)
            if rest:
                give(s, rest, first + full, rest, capacity - gap)
                leave(gap - rest * s, first + full, 1)
            leave(gap, first + full + bool(rest), m - full - bool(rest))
            n -= full * each + rest
    return rows


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of every whole text's ids with the end id, in one pass over the scan."""

    @tidy
    def cut(batches):
        import pyarrow as pa

        from .tokens import encoder

        enc, end, step = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for b in batches:
            for at in range(0, b.num_rows, 512):
                own = b.slice(at, 512)
                out = []
                for d, ids in zip(own.column(0).to_pylist(), enc.encode(own.column(1).to_pylist()), strict=True):
                    ids += end
                    for k in range(0, len(ids), step):
                        piece = ids[k : k + step]
                        out.append((d, k // step, k // 4, len(piece) // 4, zlib.crc32(piece)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, PIECES)


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to rows with a length; `pieces` is read twice, so it should be a table."""
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    rows = sorted(plan_packing(counts, capacity))
    plan = np.array(rows, np.int64).reshape(-1, 6)
    salts = max(width(spark), sum(counts.values()) // 50_000 + 1)
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")
    own = "_" * (1 + max(map(len, pieces.columns)))  # begins no column of the pieces
    s, n, first, place_, rank = (own + x for x in ("salt", "n", "before", "own", "rank"))
    dealt = pieces.withColumn(s, salt)
    before = F.sum(n).over(W.partitionBy("length").orderBy(s).rowsBetween(W.unboundedPreceding, -1))
    shift = dealt.groupBy("length", s).agg(F.count(F.lit(1)).alias(n)).select("length", s, F.coalesce(before, F.lit(0)).alias(first))
    number = F.row_number().over(W.partitionBy("length", s).orderBy("doc_id", "piece", *[c for c in ("ids_crc32",) if c in pieces.columns])) - 1
    ranked = dealt.withColumn(place_, number).join(shift.hint("shuffle_merge"), ["length", s]).withColumn(rank, F.col(place_) + F.col(first))
    names = pieces.columns

    @tidy
    def place(batches):
        import pyarrow as pa

        key = plan[:, 0] * (1 << 44) + plan[:, 1]
        for b in batches:
            length, at_rank = (b.column(b.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("length", rank))
            _, start, _, at, each, offset = plan[np.searchsorted(key, length * (1 << 44) + at_rank, "right") - 1].T
            k = at_rank - start
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(at + k // each), pa.array(offset + k % each * length)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*names, rank).mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def best_fit_packing(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    with small_batches(spark):
        pieces, _ = written(spark, token_pieces(docs, tokenizer, end_id, capacity), "pieces")
    return pack_pieces(pieces, capacity)
