"""Operators 1, 3, 4, 6, 8 and 10 against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageflow.llm.common import hash_words, rolling
from pageflow.llm.context_trees import DEPTH, context_tree_scores
from pageflow.llm.decontamination import common_subsequence, decontaminate
from pageflow.llm.graph import connected_components
from pageflow.llm.jaccard import bipartite, jaccard_components, spanning
from pageflow.llm.license_rules import BASE_PHRASES, FAMILIES, Rule, rules
from pageflow.llm.licenses import license_scan
from pageflow.llm.substrings import FingerprintIndex, deduplicate_batch, deduplicate_substrings, read_segment, write_segment
from pageflow.llm.toxicity import fit_chain, score_chain, without

from .helpers import WORDS, components, corpus, deduplicated, empty, frame, low

def held():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1


def test_word_hashes():
    texts = [(t or "").encode() for _, t in corpus()] + [b"x" * 5000, b""]
    h, n = hash_words(texts)
    flat = [w for t in texts for w in t.split()]
    assert n.tolist() == [len(t.split()) for t in texts]
    of = dict(zip(flat, h.tolist(), strict=True))
    assert [of[w] for w in flat] == h.tolist() and len(set(of.values())) == len(of)


def brute_scores(rows):
    out_of = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    count, ends = Counter(), 0
    for d, t in rows:
        if not out_of(d):
            count.update(low(t))
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + (ends > 0)
    body = lambda t: b"\n" * DEPTH + b"".join(w + b" " for w in low(t)) + b"\n"
    bits = lambda y: [((256 | y) >> (8 - j), y >> (7 - j) & 1) for j in range(8)]
    trees = [defaultdict(lambda: [0, 0]) for _ in range(DEPTH + 1)]
    for d, t in rows:
        if not out_of(d):
            s = body(t)
            for i in range(DEPTH, len(s)):
                for node, bit in bits(s[i]):
                    for k in range(DEPTH + 1):
                        trees[k][s[i - k : i], node][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    logs, below = [{} for _ in trees], defaultdict(float)
    for k in range(DEPTH, -1, -1):
        up = defaultdict(float)
        for key, (a, b) in trees[k].items():
            logs[k][key] = kt(a, b) if k == DEPTH else np.logaddexp(kt(a, b), below[key]) - math.log(2)
            up[key[0][1:], key[1]] += logs[k][key]
        below = up
    out = {}
    for d, t in rows:
        s, total = body(t), 0.0
        for i in range(DEPTH, len(s)):
            for node, bit in bits(s[i]):
                p, reach = 0.0, 1.0
                for k in range(DEPTH + 1):
                    key = s[i - k : i], node
                    if key not in logs[k]:
                        p += reach / 2
                        break
                    a = trees[k][key]
                    stop = 1.0 if k == DEPTH else math.exp(kt(*a) - math.log(2) - logs[k][key])
                    p += reach * stop * (a[bit] + 0.5) / (sum(a) + 1)
                    reach *= 1 - stop
                total += math.log10(p)
        scale = n + 0.5 * (v + 1)
        base = sum(math.log10((count[w] + 0.5) / scale) for w in low(t)) + math.log10((ends + 0.5) / scale)
        out[d] = (out_of(d), len(low(t)) + 1, sum(count[w] > 0 for w in low(t)) + (ends > 0), n, base, total)
    return out


def test_context_trees(spark):
    rows = [(d, t[:1500] if t else t) for d, t in corpus()]
    want = brute_scores(rows)
    got = context_tree_scores(frame(spark, rows), held(), portion_mb=0.01).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9) and math.isclose(r.score, want[r.doc_id][5], rel_tol=1e-7)
    assert context_tree_scores(empty(spark), held()).count() == 0
    untaught = context_tree_scores(frame(spark, [(1, "ab")]), F.lit(True)).first()
    assert (untaught.train_tokens, untaught.n_known) == (0, 0) and math.isclose(untaught.score, 4 * math.log10(1 / 256))


def test_context_trees_predict_held_out_text(spark):
    r = random.Random(3)
    syllables = [a + b for a in "klmtsr" for b in ("a", "e", "io", "un", "er", "ix")]
    rows = [(i, " ".join("".join(r.choices(syllables, k=r.randint(2, 5))) for _ in range(80))) for i in range(600)]
    got = [x for x in context_tree_scores(frame(spark, rows), held()).collect() if x.held_out]
    n = sum(x.n_bytes for x in got)
    letters = Counter("".join(t.replace(" ", "_") + "_" for _, t in rows))
    order_0 = -sum(c / letters.total() * math.log2(c / letters.total()) for c in letters.values())
    assert sum(x.bits_per_byte * x.n_bytes for x in got) / n < 0.7 * order_0


def test_context_trees_send_segments_not_grams(spark):
    """A portion's keys lie in sorted segments, kept once by their bucket: no step has a row for each of a portion's grams, none joins them."""
    from pageflow.llm import context_trees as C

    for key in (np.array([-(1 << 63), -5, 0, 7, (1 << 63) - 1]), np.array([3]), np.empty(0, np.int64)):
        assert C.unpack_keys(C.pack_keys(key)).tolist() == key.tolist()
    logs = np.array([-0.5, 0.0, -308.25])
    assert C.unplanes(C.planes(logs), np.float64).tolist() == logs.tolist()
    rows = [(d, t[:1500] if t else t) for d, t in corpus()]
    got = context_tree_scores(frame(spark, rows), held(), portion_mb=0.01)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def toxic_corpus():
    r, rows, labels = random.Random(5), [], []
    for i in range(600):
        words = r.choices(WORDS, k=60)
        bad = i % 6 == 0
        if bad:
            words[::20] = [f"vile{r.choice('abcdefgh')}{r.randrange(99)}" for _ in words[::20]]
        if i % 5 == 1:
            words[::9] = ["spam"] * len(words[::9])
        rows.append((i, " ".join(words)))
        if i < 450:
            labels.append((i, int(i % 5 != 1), int(bad)))
    return rows + [(601, None), (602, "")], labels + [(5, None, None), (0, 1, 1), (None, 0, 1)]


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    docs = frame(spark, rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    categories = {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}
    chain = fit_chain(docs, table, categories, sample_rows=400)
    assert chain.held_out["toxic"] > 0.95 and chain.held_out["low_quality"] > 0.95
    got = {r.doc_id: r for r in score_chain(docs, chain).collect()}
    assert len(got) == len(rows)
    fresh = range(450, 600)
    limit = chain.threshold["toxic"]
    assert sum((got[i].p_toxic >= limit) == (i % 6 == 0) for i in fresh) >= 0.97 * len(fresh)
    kept = without(docs, chain, "toxic")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d in got if got[d].p_toxic < limit}
    none = fit_chain(docs, table.limit(0), categories)
    assert {round(r.p_toxic, 3) for r in score_chain(docs, none).collect()} == {0.0}
    assert score_chain(empty(spark), chain).count() == 0
    assert score_chain(empty(spark), fit_chain(empty(spark), table, categories)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=70), st.lists(st.integers(0, 4), max_size=30))
def test_common_subsequence(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    assert common_subsequence(np.array(a, np.int64), np.array(b, np.int64)) == rows[-1][-1]


def test_decontamination(spark):
    r = random.Random(9)
    vocabulary = [f"t{i}" for i in range(3000)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(15, 60)))) for i in range(30)]
    rows, want = [], set()
    for i in range(300):
        words = r.choices(vocabulary, k=200)
        if i % 10 == 0:
            k = (i // 10) % 30
            own = items[k][1].split()
            if i % 20 == 0:  # rephrased: every sixth word replaced
                own = [r.choice(vocabulary) if j % 6 == 3 else w for j, w in enumerate(own)]
            words[90:90] = own
            want.add((i, k))
        rows.append((i, " ".join(words)))
    rows += [(400, None), (401, ""), (402, items[3][1].upper()), (0, rows[0][1])]
    want.add((402, 3))
    bench = spark.createDataFrame([*items, (98, None), (99, ""), (None, "x")], "item_id long, text string")
    got = decontaminate(frame(spark, rows), bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want)
    blocks = decontaminate(frame(spark, rows), bench, block=7)
    assert {(x.doc_id, x.item_id) for x in blocks.collect()} == want
    assert decontaminate(empty(spark), bench).count() == 0 and decontaminate(frame(spark, rows[:9]), bench.limit(0)).count() == 0


def test_decontamination_finds_all_that_passes_its_check(spark):
    r = random.Random(4)
    common, rare = [f"c{i}" for i in range(60)], [f"r{i}" for i in range(4000)]
    prose = lambda k: [r.choice(common) if r.random() < 0.6 else r.choice(rare) for _ in range(k)]
    items = [prose(r.randint(15, 60)) for _ in range(30)]
    docs = []
    for i in range(400):
        words = prose(r.choice([20, 150, 300]))
        if i % 4 == 0:  # rephrased: the rarest words are gone
            own, gone = items[i // 4 % 30], 0
            most = int(0.4 * len(own))
            left = []
            for w in own:
                drop = w[0] == "r" and gone < most
                gone += drop
                left.append(f"new{i}" if drop else w)
            at = r.randrange(len(words))
            words[at:at] = left
        if i % 4 == 1:  # one item in a quarter of the documents
            words[10:10] = [w if j % 4 else f"other{i}" for j, w in enumerate(items[7])]
        docs.append((i, words))
    want = {}
    lcs = lambda a, b: common_subsequence(np.array([hash(x) for x in a]), np.array([hash(x) for x in b]))
    for d, words in docs:
        for k, item in enumerate(items):
            for s in range(0, len(words), 24):
                around = words[max(0, s - len(item)) : s + 48 + len(item)]
                share, answer = lcs(item, around) / len(item), lcs(item[-5:], around) / 5
                if share >= 0.6 or (share >= 0.45 and answer >= 0.8):
                    want[d, k] = max(want.get((d, k), (0, 0)), (share, answer))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = decontaminate(frame(spark, [(d, " ".join(w)) for d, w in docs]), bench).collect()
    assert {(x.doc_id, x.item_id): (x.lcs, x.answer) for x in got} == want and len(got) == len(want) > 190


def test_decontamination_finds_in_the_latent_space_what_another_order_hides(spark):
    r = random.Random(6)
    items = [r.sample([f"t{i}" for i in range(3000)], 24) for _ in range(20)]
    prose = lambda: [f"t{r.randrange(3000)}" for _ in range(150)]
    docs = [(i, prose()) for i in range(80)]
    for i in range(0, 80, 8):
        own = items[i // 8]
        docs[i][1][60:60] = [*own[-6::-1], *own[-5:]]  # all before the answer stands the other way round
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    rows = frame(spark, [(d, " ".join(w)) for d, w in docs])
    got = decontaminate(rows, bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(i, i // 8) for i in range(0, 80, 8)} and max(x.lcs for x in got) < 0.45
    assert decontaminate(rows, bench, cosine=1.01).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(50, 90)] + [(r.randrange(40), r.randrange(40)) for _ in range(25)] + [(100, 7), (7, 7)]
    up = {x: x for e in edges for x in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: root(i) for e in edges if e[0] != e[1] for i in e}


def test_jaccard(spark):
    rows = corpus()
    for n, percent, block in ((3, 90, 150_000), (5, 80, 600), (1, 50, 300)):
        want = components(rows, n, percent)
        got = jaccard_components(frame(spark, rows), n, percent, block=block, portion_mb=0.01).collect()
        assert {x.doc_id: (x.n_shingles, x.component_id, x.n_links) for x in got} == want and len(got) == len(rows)
    twice = jaccard_components(frame(spark, [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "A b c d")])).collect()
    assert sorted((x.doc_id or -1, x.component_id or -1) for x in twice) == [(-1, -1), (1, 1), (1, 1), (2, 1)]
    assert jaccard_components(empty(spark)).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute_licenses(text, own):
    w = WORD.findall((text or "").translate(UP))
    places, labels = [], set()
    for phrase, label in BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    padded = " " + " ".join(w) + " " if w else " "
    found = []
    for rule in own:
        if rule.keyword in padded:
            for m in re.finditer(rule.pattern, padded):
                start = padded[: m.start()].count(" ") - 1
                found.append((start, start + m.group().count(" ") + 1, rule))
    rank = lambda d: (d[2].priority, d[1] - d[0], -d[2].rule_id)
    kept = [d for d in found if not any(e[2] is not d[2] and ((e[0] <= d[0] and e[1] >= d[1] and rank(e) > rank(d)) or (e[0] < d[1] and e[1] > d[0] and e[2].priority > d[2].priority)) for e in found)]
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {d[2].label for d in kept})), max((d[2].weight for d in kept), default=0.0)


def test_licenses(spark):
    assert len({f[1] for f in FAMILIES}) > 200 and len({r.pattern for r in rules()}) == len(rules())
    texts = [
        "Licensed under the Apache License, Version 2.0 (the License). MIT License. GNU General Public License version 3.0 or later, or CC BY-SA 4.0; SPDX-License-Identifier: MIT",
        "This is released under the MIT license and the GNU Lesser General Public License version 2.1, or (at your option) any later version.",
        "mit license " * 200, "mit  licenses, smit license; MİT license cc by", "CC-BY é CC.BY", "Apache 2 apache license", "éapache license", "All rights reserved. Copyright (c) 2019 x", None, "", "\x00", "cc0 cc0 cc0 1.0 universal",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies", "Neither the name of the Regents of Ümläut nor the names of its contributors may be used to endorse or promote products", "BLUEOA\u212a-1.0.0 spdx-license-identifier: blueoa\u212a-1.0.0", "the bsd zero clause license, see the LICENSE file for details; gpl licensed gplv3 gpl-2",
        "https://creativecommons.org/licenses/by-nc-sa/4.0/ and https://www.apache.org/licenses/LICENSE-2.0", "word " * 5000 + "BSD 3-Clause License",
    ]
    rows = list(enumerate(texts)) + corpus()[:20]
    got = license_scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((d, *brute_licenses(t, rules())) for d, t in rows)
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(r[:8]) for r in got), key=key) == sorted(want, key=key)
    assert license_scan(empty(spark)).count() == 0
    plan = license_scan(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "hashpartitioning" not in plan


def test_priority_and_containment(spark):
    own = [Rule(0, "long", 10, "a", "(?<= )(?:a b c)(?= )", 0.5), Rule(1, "inner", 10, "a", "(?<= )(?:a b)(?= )", 0.9), Rule(2, "high", 20, "c", "(?<= )(?:c d)(?= )", 0.7), Rule(3, "same", 20, "c", "(?<= )(?:c d)(?= )", 0.8)]
    got = license_scan(spark.createDataFrame([(1, "a b c x"), (2, "a b c d"), (3, "a b, a b c")], "doc_id long, text string"), own).orderBy("doc_id").collect()
    assert [r.labels for r in got] == ["long", "high", "inner,long"]
    # one long match contains many short ones, far from its own place in the order of starts
    tail = " ".join(f"w{i}" for i in range(40))
    own = [Rule(0, "short", 1, "mit", "(?<= )(?:mit)(?= )", 0.5), Rule(1, "long", 9, "begin", f"(?<= )(?:begin(?: mit)+ {tail} mit)(?= )", 0.9)]
    text = "begin " + "mit " * 60 + tail + " mit"
    assert license_scan(spark.createDataFrame([(1, text), (2, text + " x mit")], "doc_id long, text string"), own).agg(F.sort_array(F.collect_list("labels"))).first()[0] == ["long", "long,short"]


def test_many_matches(spark):
    """Time in proportion to the matches: a megabyte of them in one text."""
    n = 80_000
    got = license_scan(spark.createDataFrame([(1, "mit license " * n)], "doc_id long, text string")).first()
    assert (got.n_words, got.n_base, got.first_word, got.last_word, got.labels) == (2 * n, n, 0, 2 * n - 2, "mit")


def test_segments():
    r = np.random.default_rng(4)
    first = np.sort(r.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2))
    more = [r.integers(0, 2**k, 500).astype(np.uint64) for k in (3, 20, 40)]
    assert all((a == b).all() for a, b in zip(read_segment(write_segment(first, *more)), [first, *more], strict=True))
    assert [len(x) for x in read_segment(write_segment(first[:0], first[:0]))] == [0, 0]


def test_substrings(spark):
    rows = corpus()
    want = deduplicated(rows)
    for batches in (1, 3):
        got = deduplicate_substrings(frame(spark, rows), batches=batches, portion_mb=0.01, with_text=True, carry=["score"]).collect()
        assert len(got) == len(rows)
        for r in got:
            w, kept = want[r.doc_id]
            assert (r.n_words, r.n_removed, r.kept_sha256, r.score) == (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), "s")
            assert r.text == (dict(rows)[r.doc_id] if len(kept) == len(w) else b" ".join(kept).decode())
    same = " ".join(WORDS[:30])
    got = deduplicate_substrings(frame(spark, [(7, same), (7, same), (None, same), (8, same + " tail"), (-3, "x " + " ".join(WORDS[20:30]))])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(-3, 0), (0, 0), (7, 0), (7, 0), (8, 30)]
    assert deduplicate_substrings(empty(spark)).count() == 0


def alike_words(n=1024):
    """Two words that any polynomial hash modulo 2**64 takes for one."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomials_confuse(spark):
    t, u = alike_words()
    hashes, _ = hash_words([f"{t} {u}".encode()])
    assert hashes[0] != hashes[1]
    pattern = [0, 1, 1, 0, 1, 0, 0, 1] * 2
    flip = np.array([hashes[i] for i in pattern]), np.array([hashes[1 - i] for i in pattern])
    assert rolling(flip[0], 16)[0] != rolling(flip[1], 16)[0]
    head, tail = " ".join(WORDS[:9]), " ".join(WORDS[9:20])
    rows = [(1, f"{head} {t} {tail}"), (2, f"{head} {u} {tail}"), (3, f"{head} {u} {tail}"), (4, t), (5, u)]
    got = {r.doc_id: r.n_removed for r in deduplicate_substrings(frame(spark, rows)).collect()}
    assert got == {d: len(w) - len(k) for d, (w, k) in deduplicated(rows).items()} and got[3] == 21
    linked = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_components(frame(spark, [(1, f"x {t} y"), (2, f"x {u} y"), (3, f"x {t} y")])).collect()}
    assert linked == {1: (1, 1, 1), 2: (1, 2, 0), 3: (1, 1, 1)}
    taught = spark.createDataFrame([(1, f"x {t}", False), (2, f"x {u}", True)], "doc_id long, text string, out boolean")
    assert {r.doc_id: r.n_known for r in context_tree_scores(taught, F.col("out")).collect()} == {1: 3, 2: 2}


def test_false_matches_of_fingerprints(spark):
    """With ten bits most fingerprints stand for many windows; the further bits tell them apart."""
    rows = corpus()
    want = deduplicated(rows)
    got = deduplicate_substrings(frame(spark, rows), bits=10, portion_mb=0.01, batches=2, buckets=3).collect()
    assert {r.doc_id: (r.n_words, r.n_removed) for r in got} == {d: (len(w), len(w) - len(k)) for d, (w, k) in want.items()}


def test_index_across_sessions(spark, tmp_path):
    """An index that is opened again for each batch gives what one run over all gives, and what stands on disk stays few runs."""
    r, root = random.Random(8), f"file://{tmp_path}/index"
    rows = [x for x in corpus() if x[0] is not None] + [(200 + i, " ".join(r.choices(WORDS[:40], k=400))) for i in range(4)]
    rows += [(300, " ".join(f"v{j}" for j in range(60_000))), (301, " ".join(f"v{j}" for j in range(30_000, 90_000))), (302, " ".join(w for _, t in rows[:8] for w in t.split()))]
    want, got = deduplicated(rows), {}
    FingerprintIndex.create(spark, root, buckets=5)
    cuts = [0, 20, 40, 75, 202, 301, 400]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        index = FingerprintIndex.open(spark, root)
        part = deduplicate_batch(index, frame(spark, [x for x in rows if low <= x[0] < high]), with_text=True)
        got |= {x.doc_id: x for x in part.collect()}
        assert max(n for n in [sum(y["level"] == k for y in index.state["runs"]) for k in range(9)]) < 2
    assert {d: (x.n_words, x.n_removed, x.kept_sha256) for d, x in got.items()} == {d: (len(w), len(w) - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for d, (w, k) in want.items()}
    assert got[301].n_removed == 30_000 and got[302].n_removed > 100
    again = deduplicate_batch(FingerprintIndex.open(spark, root), frame(spark, rows)).collect()
    assert all(x.n_removed == x.n_words for x in again if x.n_words >= 13)


def test_jaccard_of_chained_documents(spark):
    """Documents that share rare n-grams with the next ones, all in one chain, and a large group of near copies."""
    r = random.Random(6)
    rows = []
    for i in range(120):
        own = [f"p{j}" for j in range(20 * i, 20 * i + 45)]
        rows.append((i, " ".join(own)))
    base = [f"q{j}" for j in range(80)]
    for i in range(90):
        words = list(base)
        words[r.randrange(80)] = f"z{i % 30}"
        rows.append((500 + i, " ".join(words + base[:3] * (i % 3))))
    r.shuffle(rows)
    for n, percent, block, fragments in ((3, 90, 1500, 3), (2, 70, 700, 1), (1, 35, 900, 5)):
        want = components(rows, n, percent)
        got = jaccard_components(frame(spark, rows), n, percent, block=block, portion_mb=0.01, fragments=fragments).collect()
        assert {x.doc_id: (x.n_shingles, x.component_id, x.n_links) for x in got} == want


def test_spanning_forests():
    r = np.random.default_rng(1)
    for density in (0, 0.02, 0.1, 0.9):
        square = r.random((40, 40)) < density
        square |= square.T
        across = r.random((30, 20)) < density
        for linked, edges in ((square, spanning(square)), (np.block([[np.zeros((30, 30), bool), across], [across.T, np.zeros((20, 20), bool)]]), bipartite(across))):
            n, up = len(linked), list(range(len(linked)))

            def root(i, up=up):
                while up[i] != i:
                    i = up[i]
                return i

            for x, y in edges:
                assert linked[x, y] and root(x) != root(y)  # a link, and no circle
                up[root(x)] = root(y)
            assert all(root(x) == root(y) for x in range(n) for y in range(n) if linked[x, y])


def test_near_copies_leave_no_lists_of_pairs(spark, tmp_path, monkeypatch):
    """6,000 texts of 61 words that differ in the last one: 18 million links, told by a few rows a class."""
    from pageflow.llm import jaccard

    n = 6000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(" ".join(f"s{i}" for i in range(60)) + " e"), F.col("id").cast("string")).alias("text"))
    sizes = {}
    real = jaccard.written

    def noted(session, df, label):
        out, path = real(session, df, label)
        files = list(Path(path.removeprefix("file://").removeprefix("file:")).glob("*.parquet"))
        sizes[label] = (out.count(), sum(f.stat().st_size for f in files))
        return out, path

    monkeypatch.setattr(jaccard, "written", noted)
    got = jaccard_components(docs, n=5, percent=80).agg(F.count("*").alias("n"), F.countDistinct("component_id").alias("c"), F.min("n_links").alias("a"), F.max("n_links").alias("b")).first()
    assert (got.n, got.c, got.a, got.b) == (n, 1, n - 1, n - 1)
    blocks = -(-n // (300_000 // (57 + 150)))
    assert sizes["links"][0] <= 4 * n * (blocks + 1) and sizes["links"][1] < 200 * n and "overlaps" not in sizes


def test_clashing_columns_and_rows_of_one_document(spark):
    names = "doc_id, text, 'r' AS row, 1 AS node, 'x' AS s1, 2 AS block, 3 AS rep, 'c' AS _c0, 'h' AS h, 5 AS n_words, 6 AS n_removed, 7 AS kept_sha256"
    rows = [(1, "a b c d e f g"), (1, "p q r s t u v"), (2, "p q r s t u v"), (None, "a b c d e f g"), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(*names.split(", "))
    got = sorted((r.doc_id or 0, r.component_id or 0, r.n_links) for r in jaccard_components(docs).collect())
    assert got == [(0, 0, 0), (1, 1, 0), (1, 1, 1), (2, 1, 1), (3, 3, 0), (3, 3, 0)]
    left = deduplicate_substrings(docs, window=3, with_text=True, carry=["_c0", "row"]).collect()
    assert sorted((r.doc_id or 0, r.n_removed, r._c0, r.row) for r in left) == [(0, 0, "c", "r"), (1, 0, "c", "r"), (1, 0, "c", "r"), (2, 7, "c", "r"), (3, 0, "c", "r"), (3, 0, "c", "r")]
