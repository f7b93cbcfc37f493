"""Toxicity by a classifier chain of linear models (operator 3).

Features are the words of a text and the first 4, 5 and 6 bytes of each word, as hashes;
a feature is present or not.  The `n_features` that tell the categories apart best (by
chi-square over the labelled sample) are kept.  Categories stand in a fixed order.  The
model of each one sees the features and the log-odds of all earlier categories.  For
training, these come from models that have not seen the row (`folds` folds by the hash of
doc_id); for scoring, from the models of all rows.  The held-out scores also set each
category's threshold, so it is fitted anew with every model.

The models are fitted on at most `sample_rows` labelled documents, those with the
smallest hashes of doc_id.  All documents are scored, whole.

Behaviour: null and empty texts have no features and get the models' base rates; null
labels take no part in their category; several labels of a document count by their
maximum; a category without two classes gets its base rate (0 without labels); repeated
rows are scored each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _segments, chunks, eights, hash_spans, mix64, release, utf8, written

PREFIXES = (4, 5, 6)
#: The ridge, over the number of rows; log-odds that count as certain; how many ones move a threshold half-way from even odds.
RIDGE, FAR, DRAWN = 0.3, 10.0, 50
#: Everything that is no ASCII letter or digit and no part of a longer character ends a word.
STOP = np.ones(256, bool)
STOP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def features(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes and the documents they stand in, in order, with repeats."""
    data = b"\n".join(docs) + bytes(8)
    eight, edges = eights(data), np.cumsum([0] + [len(d) + 1 for d in docs])
    out, where = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for at, end in _segments(data, len(data) - 8):
        cut = np.diff(np.concatenate(([True], STOP[np.frombuffer(data, np.uint8, end - at, at)], [True])).view(np.int8))
        s, e = np.flatnonzero(cut == -1) + at, np.flatnonzero(cut == 1) + at
        doc = np.searchsorted(edges, s, "right") - 1
        for n in (0, *PREFIXES):
            own = slice(None) if not n else np.flatnonzero(e - s >= n)
            size = e[own] - s[own] if not n else np.full(len(own), n)
            out.append(mix64(hash_spans(data, eight, s[own], size) + np.uint64(n)))
            where.append(doc[own])
    return np.concatenate(out), np.concatenate(where)


def present(docs: list[bytes], kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, place in `kept`) pairs; `kept` is sorted."""
    h, doc = features(docs)
    at = np.minimum(np.searchsorted(kept, h), len(kept) - 1)
    own = kept[at] == h
    pair = np.unique(doc[own] * len(kept) + at[own])
    return pair // len(kept), pair % len(kept)


def least(loss, at: np.ndarray, steps: int = 100, memory: int = 10, flat: float = 1e-5) -> np.ndarray:
    """Where a smooth convex `loss` (value and slope) is least, by limited-memory quasi-Newton steps."""
    value, slope = loss(at)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(slope).max() < flat:
            break
        way, sizes = slope.copy(), []
        for s, y, r in reversed(past):
            sizes.append(r * (s @ way))
            way -= sizes[-1] * y
        way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(slope))
        for (s, y, r), size in zip(past, reversed(sizes), strict=True):
            way += s * (size - r * (y @ way))
        t, down = 1.0, slope @ way
        while True:
            new, after = loss(at - t * way)
            if new <= value - 1e-4 * t * down or t < 1e-8:
                break
            t /= 2
        s, y = -t * way, after - slope
        if s @ y > 1e-12:
            past = [*past, (s, y, 1 / (s @ y))][-memory:]
        at, value, slope = at + s, new, after
    return at


def cut_point(logits: np.ndarray, y: np.ndarray) -> float:
    """The threshold on held-out log-odds: the middle of the widest gap with the fewest errors, drawn to even odds where ones are few."""
    if not len(y):
        return 0.0
    order = np.argsort(logits, kind="stable")
    missed = np.concatenate(([0], np.cumsum(y[order])))  # ones below the threshold
    wrong = missed + (len(y) - y.sum()) - (np.arange(len(y) + 1) - missed)
    edges = np.clip(np.concatenate(([-FAR], logits[order], [FAR])), -FAR, FAR)
    wide = np.where(wrong == wrong.min(), np.diff(edges), -1.0)
    i = int(wide.argmax())
    return float((edges[i] + edges[i + 1]) / 2 * y.sum() / (y.sum() + DRAWN))


class Linear:
    """Logistic regression with a ridge, on (row, column) pairs and a few dense columns.

    A feature's value is the size of its log-odds ratio between the two classes, so the ridge
    bears on what tells little.
    """

    def __init__(self, n: int):
        self.w, self.dense, self.bias = np.zeros(n), np.zeros(0), 0.0

    def logit(self, n, rows, cols, dense):
        return np.bincount(rows, self.w[cols], n) + dense @ self.dense + self.bias

    def fit(self, n, rows, cols, dense, y):
        rate = np.clip(y.mean(), 1e-6, 1 - 1e-6) if n else 1e-6
        self.dense, self.bias = np.zeros(dense.shape[1]), float(np.log(rate / (1 - rate)))
        if n == 0 or y.min() == y.max():
            return self
        k, ridge = len(self.w), RIDGE / n
        ones, zeros = np.bincount(cols, y[rows], k), np.bincount(cols, 1 - y[rows], k)
        scale = np.abs(np.log((ones + 1) / (y.sum() + 2)) - np.log((zeros + 1) / (n - y.sum() + 2)))

        def loss(at):
            self.w, self.dense, self.bias = at[:k] * scale, at[k:-1], float(at[-1])
            z = self.logit(n, rows, cols, dense)
            miss = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
            slope = np.concatenate((np.bincount(cols, miss[rows], k) * scale, miss @ dense, [0.0])) + ridge * np.append(at[:-1], 0.0)
            slope[-1] = miss.sum()
            return (np.logaddexp(0, z) - y * z).mean() + ridge / 2 * (at[:-1] @ at[:-1]), slope

        loss(least(loss, np.concatenate((self.w, self.dense, [self.bias]))))
        return self


class Chain:
    """One linear model for each category, in order."""

    def __init__(self, names: list[str], kept: np.ndarray):
        self.names, self.kept, self.models = names, kept, []
        #: By category: the share of right decisions on held-out rows, and the probability from which it is found.
        self.held_out, self.threshold = {}, {}

    def fit(self, n, rows, cols, labels: np.ndarray, fold: np.ndarray, folds: int) -> Chain:
        """labels: (n, categories) with nan where unknown; fold: of each row."""
        k, before = len(self.kept), np.zeros((n, 0))
        for c, name in enumerate(self.names):
            y = labels[:, c]
            known = ~np.isnan(y)
            out = np.zeros(n)
            for f in range(folds):
                model = Linear(k).fit(*_part(rows, cols, before, y, known & (fold != f)))
                own = fold == f
                out[own] = model.logit(n, rows, cols, before)[own]
            self.models.append(Linear(k).fit(*_part(rows, cols, before, y, known)))
            cut = cut_point(out[known], y[known])
            self.threshold[name] = float(1 / (1 + np.exp(-cut)))
            self.held_out[name] = float(((out[known] >= cut) == (y[known] > 0.5)).mean()) if known.any() else None
            before = np.column_stack((before, np.clip(out, -FAR, FAR)))
        return self

    def scores(self, n, rows, cols) -> np.ndarray:
        before = np.zeros((n, 0))
        for m in self.models:
            before = np.column_stack((before, np.clip(m.logit(n, rows, cols, before), -FAR, FAR)))
        return 1 / (1 + np.exp(-before))


def _part(rows, cols, dense, y, own):
    place = np.cumsum(own) - 1
    use = own[rows]
    return int(own.sum()), place[rows[use]], cols[use], dense[own], y[own]


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict, sample_rows: int = 8000, n_features: int = 4096, least_docs: int = 2, folds: int = 5) -> Chain:
    """A chain over `categories`: name -> Column of 0/1 over `labels`, in order.

    Fitting looks at `sample_rows` labelled documents at most, and at the `n_features` best
    features that stand in `least_docs` of these or more.
    """
    names = list(categories)
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(*(F.max(c.cast("double")).alias(f"_y{i}") for i, c in enumerate(categories.values())))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    own = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    sample = own.join(F.broadcast(known), "_id")  # at most sample_rows labels
    sample, _ = written(docs.sparkSession, sample.groupBy("_id").agg(F.min("_text").alias("_text"), *(F.first(f"_y{i}").alias(f"_y{i}") for i in range(len(names)))), "labelled")

    def hashed(batches):
        import pyarrow as pa

        for b in batches:
            for first, part in chunks(x.lower() for x in utf8(b.column(0))):
                h, doc = features(part)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order] + first
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))[: len(h)]
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), *(b.column(1 + i).take(pa.array(doc[new])) for i in range(len(names)))], names=["h", *(f"_y{i}" for i in range(len(names)))])

    ys = [f"_y{i}" for i in range(len(names))]
    counted = sample.select("_text", *ys).mapInArrow(hashed, "h long, " + ", ".join(f"{y} double" for y in ys))
    counted = counted.groupBy("h").agg(F.count(F.lit(1)).alias("n"), *(F.sum(y).alias(y) for y in ys)).filter(F.col("n") >= least_docs)
    total = sample.agg(F.count(F.lit(1)), *(F.avg(y) for y in ys)).first()
    strength = F.greatest(F.lit(0.0), *(F.pow(F.coalesce(y, F.lit(0.0)) - F.col("n") * (rate or 0.0), F.lit(2.0)) / (F.col("n") * max(rate or 0.0, 1e-9) * max(1 - (rate or 0.0), 1e-9)) for y, rate in zip(ys, total[1:], strict=True)))
    kept = np.sort(np.array([r[0] for r in counted.orderBy(F.desc(strength), "h").select("h").limit(n_features).collect()], np.int64).view(np.uint64))
    chain = Chain(names, kept if len(kept) else np.zeros(1, np.uint64))
    kept = chain.kept

    def rows(batches):
        import pyarrow as pa

        for b in batches:
            for first, part in chunks(x.lower() for x in utf8(b.column(1))):
                doc, col = present(part, kept)
                lists = np.split(col, np.searchsorted(doc, np.arange(1, len(part))))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(part)), *(b.column(2 + i).slice(first, len(part)) for i in range(len(names))), pa.array([x.astype(np.int32) for x in lists], pa.list_(pa.int32()))], names=["_id", *ys, "cols"])

    got = sample.select(F.col("_id").cast("long"), "_text", *ys).mapInArrow(rows, "_id long, " + ", ".join(f"{y} double" for y in ys) + ", cols array<int>").toPandas()
    got = got.sort_values("_id")
    n = len(got)
    cols = np.concatenate([np.asarray(x, np.int64) for x in got["cols"]] or [np.empty(0, np.int64)])
    at = np.repeat(np.arange(n), [len(x) for x in got["cols"]])
    fold = (mix64(got["_id"].to_numpy(np.int64).view(np.uint64)) % np.uint64(folds)).astype(np.int64)
    return chain.fit(n, at, cols, got[ys].to_numpy(np.float64).reshape(n, len(names)), fold, folds)


def score_chain(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and one probability p_<category> for each row of `docs`."""
    held = docs.sparkSession.sparkContext.broadcast(chain)  # n_features numbers a category
    names = [f"p_{x}" for x in chain.names]

    def score(batches):
        import pyarrow as pa

        own = held.value
        for b in batches:
            out = []
            for _, part in chunks(x.lower() for x in utf8(b.column(1))):
                out.append(own.scores(len(part), *present(part, own.kept)))
            p = np.concatenate(out) if out else np.empty((0, len(names)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, i]) for i in range(len(names)))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).mapInArrow(score, "doc_id long, " + ", ".join(f"{x} double" for x in names))


def without(docs: DataFrame, chain: Chain, category: str) -> DataFrame:
    """The rows of `docs`, as they are, whose probability of a category stays below the chain's threshold for it."""
    threshold = chain.threshold[category]
    held = docs.sparkSession.sparkContext.broadcast(chain)
    at, which = docs.columns.index("text"), chain.names.index(category)

    def keep(batches):
        import pyarrow as pa

        own = held.value
        for b in batches:
            for first, part in chunks(x.lower() for x in utf8(b.column(at))):
                p = own.scores(len(part), *present(part, own.kept))[:, which]
                yield b.slice(first, len(part)).filter(pa.array(p < threshold))
        release()

    return docs.mapInArrow(keep, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict) -> DataFrame:
    """doc_id, a probability of each category, and `toxic`, for each row of `docs`."""
    chain = fit_chain(docs, labels, categories)
    return score_chain(docs, chain).withColumn("toxic", F.col("p_toxic") >= chain.threshold["toxic"])
