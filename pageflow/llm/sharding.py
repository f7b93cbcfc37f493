"""Rendezvous hashing of record keys over weighted shards (operator 11), in DataFrame functions alone.

Each shard draws for each key: eight hex digits of the MD5 of `key:group`, where four neighbouring
shards are a group and take a quarter each, are a number u between 0 and 1; the draw is
weight / -ln(u), and the largest draw takes the key.  Draws of one shard do not depend on
the others, so a shard that joins takes keys only into itself, one that leaves gives up its
own keys only, and a change of weight moves keys only to or from its shard.  Shares follow the
weights.  A draw is made in the scan, so placing shuffles nothing; MD5 is the same in every
engine, so placements can be checked and continued outside Spark.

Slots number the rows of a shard from 0.  A shard falls into `1 << 4 * BLOCK_DIGITS` blocks by
a hash of the row; rows that are alike in all that is returned are counted before the shuffle,
blocks are summed up (a table bounded by shards x blocks), and numbers run within a block.
So neither a shard nor a repeated row is ever gathered or sorted in one task.

Behaviour: a null key is the empty text, so such rows share a shard (their slots are dealt
like all others); null text has no bytes; rows repeated as a whole get a slot each; ties of
draws go to the smaller shard; a weight of 0 takes nothing; an empty table gives no rows;
further columns stay in `with_shard` and are not returned by `shard_slots`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bind import bind

#: Hex digits of a draw; one MD5 makes the draws of PER_DIGEST neighbouring shards.
DRAW_DIGITS, PER_DIGEST = 8, 4
#: Hex digits that choose a block of a shard.
BLOCK_DIGITS = 3
#: Copies of a row that are listed at a time.
COPIES = 1 << 16


def equal_shards(n: int) -> dict[int, float]:
    return dict.fromkeys(range(n), 1.0)


def _key(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def _digests(key: Column, shards: list[int]) -> Column:
    """The MD5s that the shards' draws lie in, one after another."""
    groups = F.array(*(F.lit(g) for g in sorted({k // PER_DIGEST for k in shards})))
    return F.array_join(F.transform(groups, lambda g: F.md5(F.concat(key, F.lit(":"), g.cast("string")).cast("binary"))), "")


def _largest(digests: Column, known: dict[int, float], shards: list[int]) -> Column:
    """The largest struct(draw, -shard) of some of the known shards.

    Equal weights leave the order of the digits as it is, so the digits are the draws then.
    """
    place = {g: i for i, g in enumerate(sorted({k // PER_DIGEST for k in known}))}
    at = {k: (place[k // PER_DIGEST] * PER_DIGEST + k % PER_DIGEST) * DRAW_DIGITS + 1 for k in shards}
    each = F.array(*(F.struct(F.lit(at[k]).alias("at"), F.lit(known[k]).alias("weight"), F.lit(-k).alias("order")) for k in sorted(shards)))
    equal = len(set(known.values())) == 1

    def draw(s):
        digits = F.substring(digests, s["at"], F.lit(DRAW_DIGITS))
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 4 * DRAW_DIGITS)
        return F.struct((digits if equal else s["weight"] / -F.ln(u)).alias("draw"), s["order"].alias("order"))

    return F.array_max(F.transform(each, draw))


def _weights(shards: dict[int, float]) -> dict[int, float]:
    known = {k: float(w) for k, w in shards.items() if w > 0}
    if not known or min(known) < 0 or any(w == float("inf") for w in known.values()) or any(w != w for w in shards.values()):
        raise ValueError("shards need numbers from 0 and weights that are finite, one of them above 0")
    return known


def shard_of(key: Column, shards: dict[int, float]) -> Column:
    """The shard that a key falls to."""
    own = _weights(shards)
    found = bind(_digests(_key(key), list(own)), lambda d: _largest(d, own, list(own))["order"])
    return F.coalesce(-found, F.lit(-1)).cast("int")


def shard_before_and_after(key: Column, shards: dict[int, float], added: int, weight: float = 1.0) -> Column:
    """struct(shard, grown): the key's shard, and the one it has once `added` joins, from one set of digests."""
    own = _weights(shards)
    more = _weights(own | {added: weight})
    both = lambda d: F.struct(_largest(d, more, list(own)).alias("old"), _largest(d, more, [added]).alias("new"))
    found = lambda p: F.struct((-p["old"]["order"]).cast("int").alias("shard"), (-F.greatest(p["old"], p["new"])["order"]).cast("int").alias("grown"))
    return bind(_digests(_key(key), list(more)), lambda d: bind(both(d), found))


def with_shard(rows: DataFrame, key: str, shards: dict[int, float], name: str = "shard") -> DataFrame:
    """Rows with all their columns, and their shard; nothing is shuffled."""
    return rows.withColumn(name, shard_of(F.col(key), shards))


def write_shards(rows: DataFrame, path: str, key: str, shards: dict[int, float], name: str = "shard") -> None:
    """Write rows as Parquet, a folder a shard; each task writes what it reads, so no shard is gathered."""
    with_shard(rows, key, shards, name).write.partitionBy(name).parquet(path)


def numbered(rows: DataFrame, group: str, block: str) -> DataFrame:
    """Rows with `slot`, from 0 without a gap in each group, in the order of block and then of all columns.

    Rows that are alike share a count up to the last step, where they are listed a bounded number at a time.
    """
    alike = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    sums = alike.groupBy(group, block).agg(F.sum("_n").alias("_sum"))
    upto = W.partitionBy(group).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(group, block, F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_base"))
    inside = W.partitionBy(group, block).orderBy(*(c for c in rows.columns if c not in (group, block))).rowsBetween(W.unboundedPreceding, -1)
    placed = alike.join(base, [group, block]).withColumn("_first", F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    some = placed.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPIES).cast("long"))))
    each = some.withColumn("_copy", F.explode(F.sequence(F.col("_at"), F.least(F.col("_at") + COPIES, F.col("_n")) - 1)))
    return each.select(*rows.columns, (F.col("_first") + F.col("_copy")).alias("slot"))


def shard_slots(docs: DataFrame, shards: dict[int, float], added: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of documents dealt by their doc_id.

    `size` is the UTF-8 bytes of the text and 16; `grown_shard` is where a row lies once the shard `added` joins.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"), shard_before_and_after(F.col("doc_id"), shards, added).alias("_s"))
    mark = F.md5(F.concat_ws(":", _key(F.col("doc_id")), F.col("size").cast("string"), F.col("text_crc32").cast("string")).cast("binary"))
    rows = rows.select("doc_id", "size", "text_crc32", F.coalesce("_s.shard", F.lit(-1)).alias("shard"), F.col("_s.grown").alias("grown_shard"), F.substring(mark, 1, BLOCK_DIGITS).alias("_block"))
    placed = numbered(rows, "shard", "_block")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
