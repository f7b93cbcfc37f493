"""Operators on literal rows."""

import json
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from pageflow.functions import text as T
from pageflow.operators import blocks as B
from pageflow.operators import boundary as Y
from pageflow.operators import navigation as N
from pageflow.operators import store as D
from pageflow.operators import translate as P
from pageflow.operators import viewport as V
from pageflow.plans.fixtures import plain_block
from pageflow.sources import books as K
from pageflow.sources.demo import demo_pages
from pageflow.streaming.upserts import bucket_paths, committed, latest_state, stream_upsert, task_tokens, without_repeats


def value(spark, column, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for k, v in cols.items())) if cols else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("label", "want"), [("xvii", ("xvii", 17, "roman")), ("iix", ("iix", 8, "roman")), ("mix", ("mix", 1009, "roman")), (" 12　", ("12", 12, "arabic")), ("0", ("0", 0, "arabic")), ("1234567", ("1234567", None, "other")), ("﻿\t", None), (None, None)])
def test_page_reference(spark, label, want):
    got = value(spark, T.page_reference(F.col("x")), x=label)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("saved", "header", "want"), [("en-US", "zh-CN,zh;q=0.9", "en-US"), (None, "fr-FR,zh-CN;q=0.8,en-US;q=0.6", "zh-CN"), (None, "fr-FR", "en-US"), ("de", "zh;q=0,en;q=0.1", "en-US"), (None, None, "en-US"), (None, "en;q=x,zh;q=0.2", "zh-CN")])
def test_locale(spark, saved, header, want):
    assert value(spark, T.accepted_locale(F.col("s"), F.col("h")), s=saved, h=header) == want


def test_snippet_and_highlight(spark):
    text = "a" * 100 + " Needle\n\n in " + "b" * 100
    got = value(spark, T.snippet(F.col("x"), "needle"), x=text)
    assert got.startswith("…a") and got.endswith("b…") and "Needle in" in got
    assert value(spark, T.snippet(F.col("x"), "none"), x=text) == ""
    parts = value(spark, T.highlight(F.col("x"), "a.b"), x="xA.Bya.b")
    assert [(p.text, p.hit) for p in parts] == [("x", False), ("A.B", True), ("y", False), ("a.b", True)]


def test_reveal(spark):
    shown = [value(spark, T.revealed(F.col("ms"), F.lit(100), F.lit(50)), ms=ms) for ms in (0, 500, 1000, 2000, 10000)]
    assert shown == [0, 25, 50, 100, 100]
    assert [value(spark, T.reveal_duration(F.lit(n), F.lit(c))) for n, c in ((80, 80), (50, 50), (500, 50))] == [1000, 1000, 10000]
    assert tuple(value(spark, T.reveal_parts(F.col("x"), F.lit(0), F.lit(7)), x="abcdefghij")) == ("ab", "cdefg", "hij")


def test_scalars(spark):
    assert [value(spark, T.file_size(F.col("n")), n=n) for n in (1, 1536, 1048576, 15728640)] == ["1 KB", "2 KB", "1.0 MB", "15 MB"]
    assert value(spark, T.percent_decode(F.col("x")), x="a%2Fb+c") == "a/b+c" and value(spark, T.percent_decode(F.col("x")), x="%zz") is None
    assert value(spark, T.percent_encode(F.col("x")), x="a b(1)") == "a%20b(1)"
    assert value(spark, T.round_half_up(F.col("x")), x=-0.5) == 0


def test_blocks_are_type_exact(spark):
    raw = json.dumps([{"type": "list_item", "text": "t", "marker": "1 /", "trailing": "3", "align": "center", "indent": 1, "spaceBefore": "sm", "size": "md"}, {"kind": "nope", "text": 5, "indent": "2", "marker": None}, 7, {"kind": None, "type": "caption", "indent": 2.5}])
    got = [tuple(b) for b in value(spark, B.read_blocks(F.col("x")), x=raw)]
    assert got[0] == ("list_item", "t", "1 /", "3", "center", 1, "sm", "md")
    assert got[1] == ("paragraph", "", "", "", "left", 0, "none", "md") == got[2]
    assert got[3][0] == "caption" and got[3][5] == 3
    for bad in ('{"x":1}', "[", "5", None):
        assert value(spark, B.read_blocks(F.col("x")), x=bad) == []


def test_payload_and_response(spark):
    assert value(spark, B.read_payload(F.col("x")), x='{"blocks":[]}').isBlank is True
    got = value(spark, B.read_response(F.col("x"), F.lit(9)), x='{"blocks":[{"text":"a"}],"previousPageRevision":{"blocks":[{"text":"b"}]}}')
    assert (got.page, got.isBlank, got.previousPageRevision.page, got.previousPageRevision.blocks[0].text) == (9, False, 8, "b")


@pytest.mark.parametrize(("before", "after", "want"), [("“症候式", "“症候式解读”的", "“症候式"), ("It is complete.", "complete. A new", ""), ("上一页末尾的", "的确，这是新一页。", ""), ("ends with some words that", "some words that go on", "some words that"), ("awesome words", "some words go", ""), (None, "x", "")])
def test_overlap(spark, before, after, want):
    assert value(spark, Y.overlap(F.col("a"), F.col("b")), a=before, b=after) == want


def test_chain_meets_reduced_pages(spark):
    rows = [("d", 1, "前一页的症候式解读"), ("d", 2, "症候式解读"), ("d", 3, "解读继续"), ("d", 5, "解读继续"), ("e", 1, "alone")]
    df = spark.createDataFrame(rows, "document_id string, page int, text string")
    got = Y.reconcile(df.select("document_id", "page", F.array(plain_block("paragraph", F.col("text"))).alias("blocks")))
    assert {(r.document_id, r.page): (r.markdown, r.removed, r.is_blank) for r in got.collect()} == {("d", 1): (rows[0][2], "", False), ("d", 2): ("", "症候式解读", True), ("d", 3): ("解读继续", "", False), ("d", 5): ("解读继续", "", False), ("e", 1): ("alone", "", False)}


def test_observation(spark):
    def blocks(*items, heading=None):
        own = [plain_block("heading", heading)] if heading else []
        return F.array(*own, *(plain_block("list_item", t, marker=m, trailing=n, indent=i) for t, m, n, i in items))

    two = (("The Movie Show Begins", "1 /", "3", 0), ("The Nickelodeon Era", "2 /", "18", 1))
    got = value(spark, N.observe(blocks(*two, heading="目录"), F.lit(7)))
    assert got.isTableOfContents and [(e.title, e.value, e.level) for e in got.tocEntries] == [("1 / The Movie Show Begins", 3, 0), ("2 / The Nickelodeon Era", 18, 1)]
    assert not value(spark, N.observe(blocks(*two), F.lit(7))).isTableOfContents
    assert value(spark, N.observe(blocks(*two, *two), F.lit(7))).isTableOfContents
    assert not value(spark, N.observe(blocks(("a", "", "0", 0), ("b", "", "2", 0), heading="Contents"), F.lit(1))).isTableOfContents


def test_offsets_and_targets(spark):
    anchors = spark.createDataFrame([("d", "arabic", p, v) for p, v in ((20, 1), (37, 18), (99, 34))] + [("e", "arabic", p, 0) for p in (1, 2, 3, 4)] + [("f", "arabic", 4, None)], "document_id string, numbering string, pdf_page long, value long")
    offsets = N.page_offsets(anchors)
    assert {r.document_id: r.page_offset for r in offsets.collect()} == {"d": 19, "e": 3}
    entries = spark.createDataFrame([("d", 1, 0, "x", "18", 18, "arabic"), ("g", 1, 0, "y", "3", 3, "arabic"), ("h", 1, 0, "z", "?", None, "other")], "document_id string, source_page long, ordinal int, title string, label string, value long, numbering string")
    settings = spark.createDataFrame([("g", 21)], "document_id string, manual_offset int")
    pages = spark.createDataFrame([("d", 410), ("g", 410), ("h", 410)], "document_id string, total_pages int")
    got = {r.document_id: (r.target_page, r.used_offset, r.calibrated) for r in N.resolve(entries, offsets, settings, pages).collect()}
    assert got == {"d": (37, 19, True), "g": (24, 21, True), "h": (None, None, None)}


def test_versioned_upsert_in_any_order(spark):
    log = [("k", "a", 1, 5, "v5", 1, 1), ("k", "b", 2, 3, "v3", 2, 2), ("k", "c", 3, 5, "v5b", 3, 3), ("m", "a", 1, None, "first", 1, 4), ("m", "a", 1, None, None, 2, 5)]
    schema = "cache_key string, document_id string, page int, cache_version long, payload string, updated_at long, arrival long"
    for rows in (log, log[::-1], log + log):
        got = {r.cache_key: (r.document_id, r.page, r.payload, r.cache_version) for r in D.upsert_versioned(spark.createDataFrame(rows, schema)).collect()}
        assert got == {"k": ("a", 1, "v5b", 5), "m": ("a", 1, None, 0)}


def test_latest_upsert_keeps_nulls(spark):
    log = spark.createDataFrame([("d", 5, 1), ("d", None, 2), ("e", None, 1), ("e", 7, 2)], "document_id string, manual_offset int, arrival long")
    assert {r.document_id: r.manual_offset for r in D.upsert_latest(log, ["document_id"]).collect()} == {"d": None, "e": 7}


def test_ranges_parts_and_fingerprints(spark):
    cases = [("bytes=0-3", (0, 4)), ("bytes=-7", (93, 7)), ("bytes=-500", (0, 100)), ("bytes=-", (0, 100)), ("bytes=100-", None), ("bytes=9-2", (9, 0)), ("bytes=-0", None), ("x", None), (None, None)]
    for header, want in cases:
        got = value(spark, K.byte_range(F.col("x"), F.lit(100)), x=header)
        assert (tuple(got) if got else None) == want, header
    assert value(spark, K.range_status(K.byte_range(F.lit("bytes=0-2097152"), F.lit(2097153)))) == 416
    assert value(spark, K._fnv1a(F.lit(b"a"))) == "fnv1a-af63dc4c8601ec8c"
    data = [bytes([i % 256]) * (i % 90) for i in range(300)] + [b"long" * 500]

    def one(x):
        h = K.FNV_OFFSET
        for b in x:
            h = (h ^ b) * K.FNV_PRIME % (1 << 64)
        return h

    assert K.fnv1a(data) == [one(x) for x in data] and K.fnv1a([]) == []
    files = spark.createDataFrame([(1, bytearray(b"abcdefghij")), (2, bytearray(b"x"))], "id long, content binary")
    parts = K.cut_parts(files, 4)
    sizes = spark.createDataFrame([(1, 10), (2, 2)], "id long, size long")
    got = {r.id: (r.bytes, r.accepted, r.reason) for r in K.check_assembly(parts, sizes).collect()}
    assert got == {1: (10, True, None), 2: (1, False, "size")}
    assert {r.id: (r.bytes, r.digest) for r in K.digests(parts.repartition(3)).collect()} == {1: (10, sha256(b"abcdefghij").hexdigest()), 2: (1, sha256(b"x").hexdigest())}
    reason = lambda p: {r.id: r.reason for r in K.check_assembly(p, sizes).collect()}[1]
    assert reason(parts.filter("part_number <> 2")) == reason(parts.union(parts)) == "numbers" and reason(parts.withColumn("etag", F.lit(""))) == "etag"


def test_stored_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-local-test" + b"0" * 100)
    row = K.read_files(spark, str(tmp_path)).select("size", K.read_range(F.col("content"), K.byte_range(F.lit("bytes=0-3"), F.col("size"))).alias("x")).first()
    assert (row.size, bytes(row.x)) == (115, b"%PDF")


def test_viewport(spark):
    window = lambda c, n, r: value(spark, V.page_window(F.lit(c), F.lit(n), F.lit(r)))
    assert [window(200, 410, 2), window(1, 410, 2), window(410, 410, 2), window(9, 3, 2)] == [[198, 199, 200, 201, 202], [1, 2, 3], [408, 409, 410], []]
    enabled = lambda p, s: value(spark, V.work_enabled(F.lit(p), F.lit(200), F.lit(2), F.lit(s)))
    assert [enabled(198, True), enabled(203, True), enabled(200, False)] == [True, False, False]


def test_stream_equals_batch(spark, tmp_path):
    schema = "cache_key string, document_id string, page int, cache_version long, payload string, updated_at long, arrival long"
    rows = [(f"k{i % 7}", f"d{i}", i, (7 * i) % 5, f"p{i}", i, i) for i in range(60)]
    root = f"file://{tmp_path}/state"
    for part in (rows[40:], rows[1::2][:15], rows[::2][:20], rows[31:40:2], [rows[9]]):  # batches interleave in arrival; the last one touches a single key
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream_upsert(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), root, f"{tmp_path}/log").awaitTermination()
    names = ["cache_key", "document_id", "page", "payload", "cache_version", "arrival", "first_arrival"]
    want = D.upsert_versioned(spark.createDataFrame(rows, schema)).select(names)
    assert sorted(latest_state(spark, root).select(names).collect()) == sorted(want.collect())
    kept = bucket_paths(spark, root)
    assert len(kept) > 1 and max(map(len, kept.values())) == 2  # older versions are gone
    assert committed(spark, f"file://{tmp_path}/none") == -1


def test_repeated_deliveries(spark, tmp_path):
    rows = [("a", 1), ("b", 2), ("a", 1), ("a", 3)]
    schema = "key string, content int, ts timestamp"
    spark.createDataFrame(rows, "key string, content int").withColumn("ts", F.lit("2026-01-01 00:00:00").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = without_repeats(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "ts", "10 minutes", ["key", "content"])
    stream.writeStream.format("memory").queryName("once").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.key, r.content) for r in spark.table("once").collect()) == [("a", 1), ("a", 3), ("b", 2)]


def test_task_tokens(spark):
    events = [("k", 1, "start", "a", False), ("k", 2, "start", "b", False), ("k", 3, "cancel", "", False), ("k", 4, "start", "c", False), ("k", 5, "finish", "a", False), ("k", 6, "finish", "c", False)]
    got = task_tokens(spark.createDataFrame(events, "key string, seq long, kind string, token string, replace boolean"))
    assert [r.accepted for r in got.orderBy("seq").collect()] == [True, False, True, True, False, True]


def test_read_through(spark):
    demo = demo_pages(spark)
    pages = demo.select("document_id", "page", B.markdown(F.col("blocks")).alias("text"), F.lit(2).alias("total"), F.lit("").alias("tail"))
    stored = pages.filter("page = 1").select("document_id", "page", F.lit('{"blocks":[{"kind":"paragraph","text":"an unfinished sentence that goes on"}]}').alias("payload"))
    got = {r.page: (r.source, r.boundary_deduplicated) for r in P.read_through(pages, stored, P.Echo()).select("page", "source", F.lit(None).alias("boundary_deduplicated")).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "cache", 2: "api"}
    assert [P.parallel_calls(x) for x in (None, 0, 2.5, 99, float("nan"))] == [4, 1, 3, 6, 4]
