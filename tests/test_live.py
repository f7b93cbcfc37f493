"""Readers' events: versions, bursts, tasks and stale results; streams in several micro-batches against batches."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pageflow.operators import events as E
from pageflow.operators.prefix import running
from pageflow.settings import next_version
from pageflow.streaming import live as L
from pageflow.streaming.upserts import task_tokens

START = datetime(2026, 1, 1)


def fed(spark, tmp_path, parts, schema, build, name="s"):
    """Rows that a stream gives over micro-batches, one for each part; `build` makes the query of the stream."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}-in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}-in")
        out = build(source)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/{name}-out").option("checkpointLocation", f"{tmp_path}/{name}-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{tmp_path}/{name}-out").collect()


def test_versions_follow_the_rule(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "b", None]), 3 * i, r.choice([0, 1, 5, i // 4, None])) for i in range(700)]
    got = {x.seq: x.version for x in E.next_versions(spark.createDataFrame(rows, "k string, seq long, now_ms long").repartition(4), ["k"], last=1500, span=50).collect()}
    last = {}
    for k, seq, now in rows:
        last[k] = next_version(last.get(k, 1500), now or 0)
        assert got[seq] == last[k]
    assert len(got) == len(rows)


def test_running_in_blocks(spark):
    rows = [(i % 3 if i % 7 else None, i, (i * 37) % 101 if i % 5 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, i int, v int")
    for own in (True, False):
        got = {x.i: (x.m, x.s) for x in running(running(df, ["g"], F.floor(F.col("i") / 40), ["i"], F.col("v"), "m", own=own), ["g"], F.floor(F.col("i") / 40), ["i"], F.col("v").cast("long"), "s", F.sum, own=own).collect()}
        for g, i, _ in rows:
            seen = [v for h, j, v in rows if h == g and (j <= i if own else j < i) and v is not None]
            assert got[i] == (max(seen, default=None), sum(seen))


def bursts(seed, n=300):
    r = random.Random(seed)
    now, rows = START, []
    for i in range(n):
        now += timedelta(milliseconds=r.choice([0, 1, 40, 249, 250, 251, 400, 2000]))
        rows.append((r.choice(["a", "b"]), now, i))
    return rows


def test_debounce(spark, tmp_path):
    rows = bursts(1)
    schema = "k string, ts timestamp, i int"
    batch = {x.i: x.quiet_at for x in E.settled(spark.createDataFrame(rows, schema).repartition(3), ["k"], "ts", "i").collect()}
    want = {}
    for k in "ab":
        own = [x for x in rows if x[0] == k]
        for a, b in zip(own, [*own[1:], None], strict=True):
            if b is None or b[1] - a[1] > timedelta(milliseconds=250):
                want[a[2]] = a[1] + timedelta(milliseconds=250)
    assert batch == want and 20 < len(want) < len(rows)
    for span in (50_000, 1_000_000):
        assert {x.i: x.quiet_at for x in E.settled(spark.createDataFrame(rows, schema).repartition(3), ["k"], "ts", "i", span_us=span).collect()} == want
    # micro-batches that cut bursts, the last one only to move the watermark on
    parts = [rows[:71], rows[71:72], rows[72:200], rows[200:], [("z", rows[-1][1] + timedelta(hours=1), -1)]]
    got = fed(spark, tmp_path, parts, schema, lambda s: L.settled_stream(s, ["k"], "ts", "i", "1 second"))
    assert {x.i: x.quiet_at for x in got if x.i >= 0} == want and len(got) == len(want)


EVENTS = "key string, seq long, kind string, token string, replace boolean, ts timestamp"


def tasks(seed, n=240):
    r = random.Random(seed)
    return [(r.choice("abc"), i, r.choice(["start", "start", "finish", "finish", "cancel"]), r.choice("xyz"), r.choice([True, False, None]), START + timedelta(seconds=i)) for i in range(n)]


def test_tasks_over_micro_batches(spark, tmp_path):
    rows = tasks(2)
    want = {x.seq: x.accepted for x in task_tokens(spark.createDataFrame(rows, EVENTS)).collect()}
    shuffled = rows[40:90]
    random.Random(3).shuffle(shuffled)
    parts = [rows[:40], shuffled, rows[80:95], rows[90:]]  # some are delivered again
    got = fed(spark, tmp_path, parts, EVENTS, L.task_tokens_stream)
    assert {x.seq: x.accepted for x in got} == want and len(got) == len(rows)


def test_idle_tasks_are_freed(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    parts = [[("a", 1, "start", "x", False, at(0)), ("b", 2, "start", "x", False, at(0))], [("c", 3, "start", "x", False, at(100))], [("c", 4, "cancel", "x", False, at(200))], [("a", 5, "start", "y", False, at(201)), ("a", 6, "finish", "x", False, at(202)), ("b", 7, "finish", "x", False, at(203)), ("a", 8, "finish", "y", False, at(204))]]
    got = fed(spark, tmp_path, parts, EVENTS, lambda s: L.task_tokens_stream(s.withWatermark("ts", "1 second"), idle_ms=60_000))
    assert {x.seq: x.accepted for x in got} == {1: True, 2: True, 3: True, 4: True, 5: True, 6: False, 7: False, 8: True}


def test_overtaken_results(spark, tmp_path):
    r = random.Random(5)
    at = lambda s: START + timedelta(seconds=s)
    loads = sorted({(r.choice("de"), r.randrange(9), s) for s in range(0, 3000, 61)}, key=lambda x: x[2])
    results = [(r.choice("de"), r.randrange(9), s, i) for i, s in enumerate(sorted(r.sample(range(3000), 120)))]
    results += [("d", 5, loads[4][2], 900), ("f", 1, 50, 901)]  # at a load's own time; of a document without loads
    want = sorted(i for d, q, s, i in results if not any(e == d and p > q and t <= s for e, p, t in loads))
    sides = "document_id string, sequence int, time timestamp, i int"
    given = spark.createDataFrame([(d, q, at(s), i) for d, q, s, i in results], sides)
    known = spark.createDataFrame([(d, q, at(s)) for d, q, s in loads], "document_id string, sequence int, time timestamp")
    assert sorted(x.i for x in E.current_results(given, known, span_us=200_000_000).collect()) == want
    assert 5 < len(want) < len(results) - 5

    # one stream of both, in three batches; results and loads come up to a minute late within and between batches
    both = [(d, q, at(s), i, False) for d, q, s, i in results] + [(d, q, at(s), None, True) for d, q, s in loads]
    both.sort(key=lambda x: x[2] + timedelta(seconds=r.uniform(0, 55)))
    end = [("z", 0, at(90_000), -1, False), ("z", 0, at(90_000), None, True)]
    schema = sides + ", load boolean"
    got = fed(spark, tmp_path, [both[:50], both[50:120], both[120:], end], schema, lambda s: L.current_results_stream(s.filter("NOT load").drop("load"), s.filter("load").drop("load", "i"), "1 minute", "2 HOURS"))
    assert sorted(x.i for x in got if x.i >= 0) == want
