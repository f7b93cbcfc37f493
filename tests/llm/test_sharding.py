"""Operator 11: rendezvous hashing."""

import math
from hashlib import md5
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from pageflow.llm.sharding import equal_shards, shard_before_and_after, shard_of, shard_slots, with_shard, write_shards

from .helpers import corpus, empty, frame


def draw(key, shard, weight):
    digits = md5(f"{key}:{shard // 4}".encode()).hexdigest()[8 * (shard % 4) :][:8]
    return weight / -math.log((int(digits, 16) + 0.5) / 2**32)


def place(key, shards):
    key = "" if key is None else key
    return max(sorted(k for k in shards if shards[k] > 0), key=lambda s: draw(key, s, shards[s]))


def placed(spark, keys, shards):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    return dict(with_shard(df, "k", shards).collect())


def test_digest_columns(spark):
    rows = corpus()
    docs = frame(spark, [*rows, (None, "lost"), (None, "lost"), (None, None), (7, "again"), (7, "again"), (7, "other")])
    got = shard_slots(docs, equal_shards(40), 40).collect()
    assert len(got) == len(rows) + 6
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and r.shard == place(r.doc_id, equal_shards(40)) and r.grown_shard == place(r.doc_id, equal_shards(41))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = sorted((d, len((t or "").encode()) + 16, crc32((t or "").encode())) for d, t in rows)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None and not (r.doc_id == 7 and r.size < 23)) == texts
    assert shard_slots(empty(spark), equal_shards(40), 40).count() == 0


def test_moves_and_weights(spark):
    keys = list(range(4000))
    plain = placed(spark, keys, equal_shards(40))
    grown = placed(spark, keys, equal_shards(41))
    moved = [k for k in keys if plain[k] != grown[k]]
    assert moved and {grown[k] for k in moved} == {40} and len(moved) < 2 * len(keys) / 41
    without = placed(spark, keys, {k: 1.0 for k in range(40) if k != 5})
    assert all(without[k] == plain[k] for k in keys if plain[k] != 5) and 5 not in without.values()
    weighted = {0: 1.0, 1: 2.0, 2: 0.0, 7: 5.0}
    own = placed(spark, keys, weighted)
    assert all(own[k] == place(k, weighted) for k in keys)
    share = {s: sum(v == s for v in own.values()) / len(keys) for s in weighted}
    assert all(abs(share[s] - w / 8) < 0.04 for s, w in weighted.items()) and share[2] == 0
    heavier = placed(spark, keys, weighted | {1: 3.0})
    assert all(heavier[k] in (own[k], 1) for k in keys)  # rows move only to the shard that grew


def test_unequal_newcomer(spark):
    df = spark.range(500).withColumn("s", shard_before_and_after(F.col("id"), {0: 1.0, 3: 2.0}, 9, 4.0))
    for r in df.collect():
        assert (r.s.shard, r.s.grown) == (place(r.id, {0: 1.0, 3: 2.0}), place(r.id, {0: 1.0, 3: 2.0, 9: 4.0}))


def test_keys_and_bad_weights(spark):
    df = spark.createDataFrame([("a",), ("é",), ("",), (None,)], "k string").withColumn("s", shard_of(F.col("k"), equal_shards(7)))
    assert {r.k: r.s for r in df.collect()} == {k: place(k, equal_shards(7)) for k in ("a", "é", "", None)}
    for bad in ({}, {0: 0.0}, {0: float("nan")}, {0: float("inf")}, {-1: 1.0}):
        with pytest.raises(ValueError):
            shard_of(F.col("k"), bad)


def test_many_copies_of_one_row(spark):
    """A third of all rows alike, more than are listed at a time."""
    same = spark.range(70_000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    rest = spark.range(3000).select("id", F.col("id").cast("string").alias("text"))
    got = shard_slots(same.union(rest), equal_shards(4), 4).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert sum(r.n for r in got) == 73_000 and all(r.n == r.d == r.m + 1 for r in got)


def test_no_python_in_the_plan(spark):
    plan = shard_slots(frame(spark, corpus()), equal_shards(40), 40)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_written_shards(spark, tmp_path):
    docs = frame(spark, corpus())
    write_shards(docs, f"file://{tmp_path}/s", "doc_id", equal_shards(5))
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == docs.count() and all(r.shard == place(r.doc_id, equal_shards(5)) for r in back.select("doc_id", "shard").collect())
