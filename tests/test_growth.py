"""Steps whose cost once grew faster than their input: what they do for a row is counted, and odd rows keep their results."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from pageflow.operators import navigation as N
from pageflow.operators import store as D
from pageflow.sources import books as K
from pageflow.streaming import live as L


def parses(df) -> int:
    """How often a plan parses JSON for a row."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("parseJson")


STORED = "document_id string, pdf_page int, is_table_of_contents int, toc_entries string, page_label string, page_value int, numbering string"


def test_stored_entries_are_parsed_once(spark, tmp_path):
    rows = [
        ("a", 1, 1, '[{"title":" T ","label":"4","value":4,"numbering":"arabic","level":9},{"title":1,"label":"2"},5,{"title":"u","label":"x","value":-1,"sourcePage":7,"ordinal":2.5}]', " 9 ", 9, "arabic"),
        ("a", 2, 1, '{"title":"x"}', "", 3, "roman"),
        ("a", 3, 0, '[{"title":"t","label":"l"}]', "iv", -4, None),
        ("b", 4, None, '[{"title":"t"', None, None, None),
        ("b", 0, 1, "[]", "1", 1, "arabic"),
        ("b", None, 1, None, "1", 1, "arabic"),
        ("b", 5, 1, None, "   ", 1, "arabic"),
    ]
    spark.createDataFrame(rows, STORED).write.parquet(f"{tmp_path}/stored")
    got = N.stored_observations(spark.read.parquet(f"{tmp_path}/stored"))
    assert parses(got) == 1 and parses(N.anchors_of(got)) == 0 and parses(N.entries_of(got)) == 1
    seen = {r.observation.pdfPage: r.observation for r in got.collect()}
    assert sorted(seen) == [1, 2, 3, 4, 5]
    assert [tuple(e) for e in seen[1].tocEntries] == [(1, 0, "T", "4", 4, "arabic", 3), (7, 3, "u", "x", None, "other", 0)]
    assert [seen[i].isTableOfContents for i in (1, 2, 3, 4, 5)] == [True, False, False, False, False]
    assert [seen[i].anchor and tuple(seen[i].anchor) for i in (1, 2, 3, 4, 5)] == [(1, "9", 9, "arabic"), None, (3, "iv", None, "other"), None, None]
    assert sorted(r.pdf_page for r in N.anchors_of(got).collect()) == [1, 3]


def test_observations_are_parsed_once(spark, tmp_path):
    texts = ['{"pdfPage":3,"isTableOfContents":"yes","tocEntries":[{"title":"t","label":"1","value":1.5,"numbering":"roman"}],"anchor":{"label":" v ","value":5,"numbering":"roman"}}', '{"pdfPage":"3","isTableOfContents":1,"tocEntries":{"a":1},"anchor":"x"}', "[1]", "broken", None]
    spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, json string").write.parquet(f"{tmp_path}/o")
    df = spark.read.parquet(f"{tmp_path}/o").select("i", N.read_observation(F.col("json")).alias("o"))
    assert parses(df) == 1
    got = {r.i: r.o for r in df.collect()}
    assert (got[0].pdfPage, got[0].isTableOfContents, [tuple(e) for e in got[0].tocEntries], tuple(got[0].anchor)) == (3, True, [(3, 0, "t", "1", None, "roman", 0)], (3, "v", 5, "roman"))
    assert all((got[i].pdfPage, got[i].isTableOfContents, got[i].tocEntries, got[i].anchor) == (0, False, [], None) for i in (1, 2, 3, 4))


def test_stale_results_meet_no_pairs(spark, tmp_path):
    """One document with many loads at once; results with null fields, micro-seconds and numbers above 2**53 come out whole."""
    r = random.Random(4)
    at = lambda s: datetime(2026, 1, 1) + timedelta(microseconds=int(s * 1e6) + 1)
    loads = [("d", r.randrange(1000), at(r.uniform(0, 20_000))) for _ in range(400)]
    results = [("d", r.randrange(1000) if i % 9 else None, at(r.uniform(0, 20_000)), (1 << 60) + i if i % 5 else None) for i in range(300)] + [(None, 1, at(5), 1), ("d", 1, None, 2)]
    want = [x for x in results if x[2] and not any(x[0] == d and x[1] is not None and q > x[1] and x[2] - timedelta(hours=1) <= t <= x[2] for d, q, t in loads)]
    both = [(*x, False) for x in results] + [(*x, None, True) for x in loads] + [("d", 5, None, None, True), ("d", None, at(3), None, True), (None, 900, at(4), None, True)]
    both += [("z", 0, at(90_000), -1, False), ("z", 0, at(90_000), None, True)]
    schema = "document_id string, sequence long, time timestamp, i long, load boolean"
    spark.createDataFrame(both, schema).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    out = L.current_results_stream(s.filter("NOT load").drop("load"), s.filter("load").drop("load", "i"), "1 minute", "1 HOUR")
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    assert "StreamingSymmetricHashJoin" not in q._jsq.explainInternal(False)
    got = [tuple(x) for x in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and 30 < len(want) < 280


def test_largest_of_ranges():
    r = np.random.default_rng(1)
    order, value = np.sort(r.integers(0, 50, 40)), r.integers(-9, 9, 40)
    first = r.integers(-5, 55, 200)
    last = first + r.integers(0, 30, 200)
    got = L.largest(order, value, first, last)
    assert got.tolist() == [max((v for o, v in zip(order, value, strict=True) if a <= o <= b), default=-(1 << 63)) for a, b in zip(first, last, strict=True)]
    assert L.largest(order[:0], value[:0], first, last).tolist() == [-(1 << 63)] * 200


def test_oversized_contents_are_refused_by_their_letters(spark, tmp_path):
    cap = D.CONTENTS_LENGTH
    rows = [(0, "a", 1), (1, "a", cap + 1), (2, "\\", cap // 2), (3, "a", cap - 200), (4, "é", cap - 200)]
    entry = F.struct(F.lit(1).cast("long").alias("sourcePage"), F.lit(0).alias("ordinal"), F.expr("repeat(c, n)").alias("title"), F.lit("1").alias("label"), F.lit(None).cast("long").alias("value"), F.lit("arabic").alias("numbering"), F.lit(0).alias("level"))
    anchor = F.lit(None).cast("struct<label:string,value:bigint,numbering:string>").alias("anchor")
    o = F.struct(F.lit(1).cast("long").alias("pdfPage"), F.lit(True).alias("isTableOfContents"), F.array(entry).alias("tocEntries"), anchor).alias("observation")
    spark.createDataFrame(rows, "i int, c string, n int").write.parquet(f"{tmp_path}/log")
    got = D.checked_observations(spark.read.parquet(f"{tmp_path}/log").select("i", F.lit("d").alias("document_id"), o))
    assert {r.i: r.rejected for r in got.select("i", "rejected").collect()} == {0: None, 1: "size", 2: "size", 3: None, 4: None}
    plan = got.select("i", "rejected")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and plan.index("aggregate(") < plan.index("StructsToJson")


def test_fnv1a_holds_a_bounded_part():
    import tracemalloc

    rows = [bytes([i % 251]) * (20_000 + i) for i in range(1000)] + [b"", b"a" * 3_000_000]
    tracemalloc.start()
    got = K.fnv1a(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000
    for i in (0, 500, 999, 1000):
        x = K.FNV_OFFSET
        for b in rows[i]:
            x = (x ^ b) * K.FNV_PRIME & 0xFFFFFFFFFFFFFFFF
        assert got[i] == x


def test_a_label_is_trimmed_once_and_without_patterns(spark, tmp_path):
    """Every letter of WHITE goes at both ends and no other; a page's label is trimmed once, a page's blocks are looked through once."""
    import regex

    from pageflow.functions import text as T

    white = regex.compile(regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", T.WHITE))
    letters = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    spark.createDataFrame([(c, f"{c} x{c}y {c}") for c in letters], "c string, t string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert all(r.x == ("" if white.fullmatch(r.c) else r.c) for r in df.select("c", T.trim(F.col("c")).alias("x")).collect())
    assert all(r.x == (f"x{r.c}y" if white.fullmatch(r.c) else r.t) for r in df.select("c", "t", T.trim(F.col("t")).alias("x")).collect())
    plan = lambda column: df.select(column)._jdf.queryExecution().optimizedPlan().toString()
    reference = plan(T.page_reference(F.col("t")))
    assert "regexp_replace" not in reference and reference.count("trim(") == 2
    blocks = F.array(F.struct(*(F.col("t").alias(n) for n in ("kind", "text", "marker", "trailing")), F.lit(0).alias("indent")))
    assert plan(N.observe(blocks, F.lit(1))).count("= page_number") <= 2
