"""The corpus pipeline, stage by stage against brute force on the stages' own inputs."""

import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from pageflow.llm import pipeline as P
from pageflow.llm.common import written
from pageflow.llm.queries import tokenizer_path

from .helpers import components, deduplicated, leaks

DIR = "/root/testdata/sf0.001"


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "near duplicates", "repeated passages", "benchmark leaks", "packing"]

    def apply(name, df):
        out, _ = written(spark, stages[name](spark, df, DIR), "stage")
        if name != "packing":
            assert out.columns == docs.columns
        return out

    clean = apply("toxicity", docs)
    kept = {d for d, _ in rows(clean)}
    assert not [d for d, t in labels.items() if t == 1 and d in kept]
    assert not [d for d, t in labels.items() if t == 0 and d not in kept]

    one = apply("near duplicates", clean)
    want = components(rows(clean), 5, 80)
    assert {d for d, _ in rows(one)} == {d for d, x in want.items() if d == x[1]}

    less = apply("repeated passages", one)
    want = deduplicated(rows(one))
    got = dict(rows(less))
    assert {d: (t or "").encode().split() for d, t in got.items()} == {d: k for d, (w, k) in want.items() if k or not w}
    before = dict(rows(one))
    assert all(got[d] == before[d] for d in got if len(want[d][0]) == len(want[d][1]))

    free = apply("benchmark leaks", less)
    left = {d for d, _ in rows(free)}
    assert left == {d for d, _ in rows(less)} - leaks(rows(less), items)
    assert len(left) >= 0.85 * less.count()

    packed = apply("packing", free).collect()
    fresh, pieces = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), []
    for d, t in rows(free):
        ids = np.array([*fresh.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        pieces += [(d, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted(tuple(r)[:5] for r in packed) == sorted(pieces)
    total = np.bincount([r.sequence_id for r in packed], [r.length for r in packed])
    assert total.max() <= 2048 and sum(r.length for r in packed) == sum(x[3] for x in pieces)

    # the whole run gives what the stages gave, each of which was held against brute force
    assert sorted(tuple(r)[:5] for r in P.run(spark, DIR).collect()) == sorted(pieces)


def test_odd_columns_and_rows(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").selectExpr("doc_id", "text", "lang AS n_words", "source AS g", "n_chars", "'x' AS length", "1 AS piece", "2 AS toxic", "3 AS _row")
    null = docs.limit(1).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text", *docs.columns[2:])
    odd = docs.unionByName(docs.limit(3)).unionByName(null)
    for name, stage in P.STAGES[:4]:
        out = stage(spark, odd, DIR)
        assert out.columns == odd.columns and out.filter("doc_id IS NULL").count() == 1, name
    assert P.STAGES[4][1](spark, odd, DIR).filter("doc_id IS NULL").count() == 1
    for name, stage in P.STAGES:
        assert stage(spark, odd.limit(0), DIR).count() == 0, name


def test_near_duplicates_keep_rows_that_share_only_a_doc_id(spark):
    words = [f"w{i}" for i in range(60)]
    one, two = " ".join(words[:30]), " ".join(words[30:])
    data = [(1, one), (1, two), (2, one + " more"), (3, two), (3, two), (4, "alone"), (4, ""), (5, None), (5, None), (None, one), (6, one), (6, "quite another text of its own")]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(data)], "doc_id long, text string, h int")
    got = P.near_duplicates(spark, docs, DIR)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted([(1, one), (1, two), (4, "alone"), (4, ""), (5, ""), (5, ""), (0, one), (6, "quite another text of its own")])


def test_the_root_names_the_stages():
    assert (corpus_pipeline.STAGES, corpus_pipeline.run, corpus_pipeline.ORACLE_SQL) == (P.STAGES, P.run, P.ORACLE_SQL)
