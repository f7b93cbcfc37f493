"""Texts of over a megabyte, null and repeated ids: operators 1, 4, 5, 6, 8, 9, 10 and the pipeline's stages."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pageflow.llm import pipeline as P
from pageflow.llm.binary_output import simple8b_round_trip
from pageflow.llm.context_trees import context_tree_scores
from pageflow.llm.decontamination import decontaminate
from pageflow.llm.jaccard import jaccard_components
from pageflow.llm.licenses import license_scan
from pageflow.llm.packing import best_fit_packing
from pageflow.llm.queries import tokenizer_path
from pageflow.llm.substrings import deduplicate_substrings

from .helpers import components, deduplicated, frame, low

ITEM = "which of these rivers flows through seven old towns and four young ones? the long grey river"


def long_words(seed, n=190_000):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghij", k=r.randint(3, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Two near copies of 1.2 MB, one more long text with a passage of the first and an item far inside, and short ones."""
    first = long_words(1)
    near = list(first)
    near[1000::5000] = [f"edit{i}" for i in range(len(near[1000::5000]))]
    other = long_words(2)
    other[100_000:100_000] = first[5000:5100]
    other[150_000:150_000] = ITEM.split()
    rows = [(1, " ".join(first)), (2, " ".join(near)), (3, " ".join(other)), (4, "short text"), (None, "without an id"), (None, None), (5, ""), (6, "twice told"), (6, "twice told")]
    assert all(len(t) > 1_100_000 for _, t in rows[:3])
    return rows


def known(rows):
    return [(d, t) for d, t in rows if d is not None]


def test_jaccard(spark, texts):
    got = jaccard_components(frame(spark, texts), n=3, percent=90).collect()
    once = list(dict.fromkeys(known(texts)))
    want = components(once, 3, 90)
    assert want[1][1] == want[2][1] and len(got) == len(texts)
    for r in got:
        if r.doc_id is None:
            assert (r.component_id, r.n_links) == (None, 0)
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id][:2]


def test_substrings(spark, texts):
    want = deduplicated(list(dict.fromkeys(known(texts))))
    for r in deduplicate_substrings(frame(spark, texts)).collect():
        if r.doc_id is not None:
            w, kept = want[r.doc_id]
            assert (r.n_words, r.n_removed) == (len(w), len(w) - len(kept))
        else:
            assert r.n_removed == 0


def library(name, text):
    return np.asarray(Tokenizer.from_file(tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_token_files(spark, texts):
    rows = known(texts)[:5]
    at = 0
    want = {}
    for d, t in sorted(rows):
        own = library("byte_bpe_50k.json", t) + (2).to_bytes(4, "little")
        want[d] = (at, len(own) // 4, zlib.crc32(own))
        at += len(own) // 4
    got = simple8b_round_trip(spark, frame(spark, rows), tokenizer_path("byte_bpe_50k.json"), 2).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want


def test_packing(spark, texts):
    got = best_fit_packing(spark, frame(spark, texts[:4]), tokenizer_path("word_bpe_49k.json"), 0, 2048).collect()
    for d, t in texts[:4]:
        own = library("word_bpe_49k.json", t) + bytes(4)
        pieces = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == d)
        assert pieces == [(k, 2048 * k, len(own[8192 * k : 8192 * k + 8192]) // 4, zlib.crc32(own[8192 * k : 8192 * k + 8192])) for k in range(-(-len(own) // 8192))]


def test_context_trees(spark, texts):
    """Counts and the base model by hand; rows that share an id are scored each, alike texts alike."""
    rows = [texts[0], *texts[3:]]
    held = F.coalesce(F.col("doc_id") == 6, F.lit(False))
    got = context_tree_scores(frame(spark, rows), held).collect()
    assert len(got) == len(rows)
    train = [w for d, t in rows if d != 6 for w in low(t)]
    ends, count = sum(d != 6 for d, _ in rows), {}
    for w in train:
        count[w] = count.get(w, 0) + 1
    n, v = len(train) + ends, len(count) + 1
    for r in got:
        own = [t for d, t in rows if d == r.doc_id] if r.doc_id is not None else ["without an id", None]
        base = [sum(math.log10((count.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in [*low(t)]) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1))) for t in own]
        assert r.train_tokens == n and any(math.isclose(r.base_score, b, rel_tol=1e-9) for b in base)
        assert r.score < 0 and r.held_out == (r.doc_id == 6)
    twice = [r.score for r in got if r.doc_id == 6]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_leaks(spark, texts):
    bench = spark.createDataFrame([(7, ITEM), (8, "an item that nobody has copied anywhere in these many words at all")], "item_id long, text string")
    got = decontaminate(frame(spark, texts), bench).collect()
    assert [(r.doc_id, r.item_id, r.lcs) for r in got] == [(3, 7, 1.0)]
    alone = decontaminate(frame(spark, [(None, ITEM), (1, "clean")]), bench).collect()
    assert [(r.doc_id, r.item_id) for r in alone] == [(None, 7)]  # a row without an id is told of as such


def test_licenses(spark, texts):
    rows = [*texts, (None, "Apache License"), (9, "x " * 600_000 + "MIT License")]
    got = license_scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or 0, r.n_base, r.base_labels) for r in got if r.n_base) == [(0, 1, "apache"), (9, 1, "mit")]


def test_stages(spark, texts, tmp_path):
    """Every stage over long texts, null and repeated ids; clean rows stay."""
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(P.STAGES)
    assert stages["toxicity"](spark, docs, str(tmp_path)).count() == len(texts)
    left = sorted((r.doc_id or 0, r.n_chars) for r in stages["near duplicates"](spark, docs, str(tmp_path)).collect())
    assert [d for d, _ in left] == [0, 0, 1, 3, 4, 5, 6]
    cut = {r.doc_id: r.n_chars for r in stages["repeated passages"](spark, docs.filter("doc_id IN (1, 3, 4)"), str(tmp_path)).collect()}
    assert cut[1] == len(texts[0][1]) and cut[4] == 10 and cut[3] < len(texts[2][1]) - 400
    clean = stages["benchmark leaks"](spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id or 0 for r in clean) == [0, 0, 1, 2, 4, 5, 6, 6]
    packed = stages["packing"](spark, docs, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == 7 and packed.agg(F.max("length")).first()[0] == 2048
