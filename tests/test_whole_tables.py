"""Queries keep every row of their tables; brute force over small tables with short, long and missing texts."""

import random
from hashlib import sha256

import pytest

import __spark_entry__ as entry
from pageflow.operators import boundary as Y


@pytest.fixture
def documents(spark, tmp_path):
    def make(rows):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return make


def cut(before, after):
    """The longest end of `before` that `after` starts with, at whole words and with eight letters; both of letters and spaces."""
    for n in range(min(Y.LONGEST, len(before), len(after)), 0, -1):
        own = after[:n]
        outside, following = before[: len(before) - n][-1:], after[n : n + 1]
        if before.endswith(own) and sum(map(str.isalpha, own)) >= 8 and not (outside.isalpha() and own[0].isalpha()) and not (own[-1].isalpha() and following.isalpha()):
            return own
    return ""


def test_boundary_of_short_and_long_documents(spark, documents):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 7)))
    rows = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 44, 45, 52, 60, 300, 900, 4000])] + [(80, "ab " * 300), (90, ""), (91, None)]
    assert sum(400 <= len(t or "") <= 4000 for _, t in rows) < len(rows) - 4
    chain, pairs = {}, {}
    for d, t in rows:
        if t is None:
            continue
        words, before = t.split(" "), ""
        for i in range((len(words) - 1) // 44 + 1):
            page = " ".join(words[i * 44 : i * 44 + 50])
            pairs[str(d), i + 1] = cut(" ".join(words[i * 44 - 44 : i * 44 + 6]) if i else "", page)
            removed = cut(before.rstrip(), page)
            before = page[len(removed) :].lstrip()
            chain[str(d), i + 1] = (removed, before)
    sf_dir = documents(rows)
    got = entry.queries()["boundary_chain"](spark, sf_dir).collect()
    assert {(x.document_id, x.page): (x.removed, x.markdown) for x in got} == chain and len(got) == len(chain)
    got = entry.queries()["boundary_overlap"](spark, sf_dir).collect()
    assert {(x.document_id, x.page): x.removed for x in got} == {k: v for k, v in pairs.items() if v}


def test_fingerprints_of_long_texts(spark, documents):
    r = random.Random(5)
    texts = {i: "".join(r.choices("abcé ", k=n)) for i, n in enumerate([0, 10, 60000, 65536, 70000, 200000])} | {7: "x" * 65536, 8: "x" * 65537}
    got = entry.queries()["fingerprint_sha256"](spark, documents([*texts.items(), (9, None)])).collect()
    content = {i: t.encode() for i, t in texts.items()} | {9: b""}
    assert sum(len(x) > 65536 for x in content.values()) >= 4
    assert {x.id: x.fingerprint for x in got} == {i: sha256(str(len(x)).encode() + x[:65536] + x[-65536:]).hexdigest() for i, x in content.items()}
