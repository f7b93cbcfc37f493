"""Operator 3 against a plain fit of the same chain: dense features, Newton's method, no hashing."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pageflow.llm.common import mix64
from pageflow.llm.toxicity import DRAWN, FAR, RIDGE, fit_chain, score_chain, without

from .helpers import frame

MILD, BAD, POOR = [f"word{i}" for i in range(40)], ["grobian", "lumpen", "halunke"], ["klick", "gratis"]


def labelled(seed=3, n=260):
    """(doc_id, text, quality, toxic): toxic texts hold bad words mostly, texts of low quality poor ones; toxic ones are of low quality more often."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = r.random() < 0.2
        low = r.random() < (0.7 if toxic else 0.2)
        words = r.choices(MILD, k=r.randint(1, 30))
        if toxic and r.random() < 0.9:
            words.insert(0, r.choice(BAD).upper() + "!")
        if low and r.random() < 0.8:
            words.append(r.choice(POOR))
        rows.append((i, " ".join(words), None if i % 23 == 5 else int(not low), None if i % 31 == 7 else int(toxic)))
    return rows


def seen(text):
    """A text's features: words, and their first 4, 5 and 6 bytes."""
    words = re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").lower().encode())
    return {(0, w) for w in words} | {(n, w[:n]) for w in words for n in (4, 5, 6) if len(w) >= n}


def newton(x, dense, y):
    """Weights of a logistic regression with the operator's scaling and ridge."""
    n = len(y)
    if not n or y.min() == y.max():
        rate = np.clip(y.mean(), 1e-6, 1 - 1e-6) if n else 1e-6
        return lambda a, d: np.full(len(a), np.log(rate / (1 - rate)))
    ones, zeros = x.T @ y, x.T @ (1 - y)
    scale = np.abs(np.log((ones + 1) / (y.sum() + 2)) - np.log((zeros + 1) / (n - y.sum() + 2)))
    full = np.column_stack((x * scale, dense, np.ones(n)))
    ridge = np.full(full.shape[1], RIDGE / n)
    ridge[-1] = 0
    at = np.zeros(full.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(full @ at, -40, 40)))
        slope = full.T @ (p - y) / n + ridge * at
        curve = (full.T * (p * (1 - p))) @ full / n + np.diag(ridge) + 1e-12 * np.eye(len(at))
        move = np.linalg.solve(curve, slope)
        at = at - move * min(1.0, 5 / max(1e-9, np.abs(move).max()))
        if np.abs(slope).max() < 1e-11:
            break
    return lambda a, d: np.column_stack((a * scale, d, np.ones(len(a)))) @ at


def plain_chain(rows, asked, folds=5, least_docs=2):
    """Probabilities (low quality, toxic) of the texts asked for, and the thresholds."""
    known = [r for r in rows if r[2] is not None or r[3] is not None]
    counts = Counter(f for r in known for f in seen(r[1]))
    names = sorted(f for f, c in counts.items() if c >= least_docs)
    matrix = lambda texts: np.array([[f in own for f in names] for own in map(seen, texts)], float).reshape(len(texts), len(names))
    x, z = matrix([r[1] for r in known]), matrix(asked)
    fold = (mix64(np.array([r[0] for r in known], np.int64).view(np.uint64)) % np.uint64(folds)).astype(int)
    before, ahead, out, cuts = np.zeros((len(known), 0)), np.zeros((len(asked), 0)), [], []
    for value in (lambda r: None if r[2] is None else 1 - r[2], lambda r: r[3]):
        y = np.array([np.nan if value(r) is None else value(r) for r in known], float)
        told = ~np.isnan(y)
        held = np.zeros(len(known))
        for f in range(folds):
            use = told & (fold != f)
            held[fold == f] = newton(x[use], before[use], y[use])(x, before)[fold == f]
        logit = np.clip(newton(x[told], before[told], y[told])(z, ahead), -FAR, FAR)
        before, ahead = np.column_stack((before, np.clip(held, -FAR, FAR))), np.column_stack((ahead, logit))
        out.append(1 / (1 + np.exp(-logit)))
        own = sorted(zip(held[told], y[told], strict=True))
        wrong = [sum(v for _, v in own[:i]) + sum(1 - v for _, v in own[i:]) for i in range(len(own) + 1)]
        edges = np.clip([-FAR, *(h for h, _ in own), FAR], -FAR, FAR)
        gaps = [(edges[i + 1] - edges[i], -i) for i in range(len(own) + 1) if wrong[i] == min(wrong)]
        i = -max(gaps)[1]
        ones = sum(v for _, v in own)
        cuts.append(1 / (1 + np.exp(-(edges[i] + edges[i + 1]) / 2 * ones / (ones + DRAWN))))
    return np.array(out), cuts


def fitted(spark, rows):
    docs = frame(spark, [(r[0], r[1]) for r in rows])
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int")
    return docs, fit_chain(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})


def test_equals_a_plain_fit(spark):
    rows = labelled()
    docs, chain = fitted(spark, rows)
    others = [(1000 + i, t) for i, t in enumerate(["", "grobian", "word1 klick gratis", "Lumpen word2 " * 50, "nothing of this", "é ß " * 9])]
    got = {r.doc_id: (r.p_low_quality, r.p_toxic) for r in score_chain(docs.unionByName(frame(spark, others)), chain).collect()}
    want, cuts = plain_chain(rows, [r[1] for r in rows] + [t for _, t in others])
    for (i, *_), low, toxic in zip([*rows, *others], *want, strict=True):
        assert abs(got[i][0] - low) < 0.01 and abs(got[i][1] - toxic) < 0.01, (i, got[i], low, toxic)
    assert abs(chain.threshold["low_quality"] - cuts[0]) < 0.02 and abs(chain.threshold["toxic"] - cuts[1]) < 0.02


def test_labels_that_were_held_out(spark):
    """Half of the labels are fitted to; decisions on the other half follow the words."""
    rows = labelled(seed=8, n=600)
    docs, chain = fitted(spark, rows[:300])
    rest = frame(spark, [(r[0], r[1]) for r in rows[300:]])
    kept = {r.doc_id for r in without(rest, chain, "toxic").collect()}
    marked = {r[0] for r in rows[300:] if any(w.upper() in r[1] for w in BAD)}
    clean = {r[0] for r in rows[300:]} - marked
    assert len(marked - kept) >= 0.95 * len(marked) and len(clean & kept) >= 0.98 * len(clean)


def test_odd_rows(spark):
    """Null ids, repeated rows and very long texts, in fitting and scoring."""
    rows = labelled(n=120)
    long = "word1 " * 250_000
    docs = frame(spark, [(r[0], r[1]) for r in rows] + [(None, "grobian"), (None, None), (5, rows[5][1]), (5, "grobian"), (700, long)])
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows] + [(None, 1, 1), (700, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    chain = fit_chain(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    got = score_chain(docs, chain).collect()
    assert len(got) == 125 and all(0 <= r.p_toxic <= 1 and 0 <= r.p_low_quality <= 1 for r in got)
    same = [r.p_toxic for r in got if r.doc_id == 5]
    assert len(same) == 3 and len(set(same)) <= 2
    assert score_chain(docs.limit(0), chain).count() == 0
