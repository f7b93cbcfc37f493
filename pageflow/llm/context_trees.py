"""Context-tree weighting over bytes (operator 1).

A document is read as its words, lower-cased (A-Z), each followed by a space, and then a
line feed as its end; before it stand five line feeds.  Each byte is eight binary
decisions; each decision has its own context tree, whose contexts are the 0 to 5 bytes
before.  A node's counts give a Krichevsky-Trofimov estimate; a node's weighted
probability is half its own block estimate and half its children's product.  Block
estimates depend on counts only, so the trees follow from the counts of byte 6-grams of
all training documents, and the prediction of a byte after its context is a mixture over
all six depths with the trained weights.

Counting: portions of documents reduce to their distinct 6-grams and words, which go out in
sorted segments, one for each bucket of keys, and are summed there; the bucket keeps the
segments in a file of the shared folder.  Trees: contexts that share their last two bytes lie
in one subtree, built in one task (at most 256**4 6-grams, in text far fewer); their roots are
summed by the last byte, 256 pairs a group, and what the two levels above pass on is one
dense row for each byte (256 of them, a megabyte in all).  Scoring: values go to the buckets,
where each kept segment is answered, so a portion meets the values of just its own 6-grams and
words; neither they nor the text are shuffled a second time on their way out.

Words are counted by their 64-bit hashes.

Behaviour: null and empty texts have the end token only; a null doc_id trains; repeated
rows count and are scored each; without training documents N and V are 0 and every byte
has probability 1/256; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, hash_words, mix64, new_folder, released, tidy, utf8, width, written
from .portions import bucket_count, keep_portion, portion_id, portions, read_portion

DEPTH = 5
HALF = np.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps up; x > 0."""
    y = x + 8
    steps = x.copy()
    for i in range(1, 8):
        steps *= x + i
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(steps)


def block_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)


def weighted(zeros, ones, children):
    return np.logaddexp(HALF + block_estimate(zeros, ones), HALF + children)


def below(reach, sure, zeros, ones, weighted_log):
    """Pass a mixture on: mass that goes deeper, and the chance of a one so far."""
    own = np.exp(HALF + block_estimate(zeros, ones) - weighted_log)
    return reach * (1 - own), sure + reach * own * (ones + 0.5) / (zeros + ones + 1)


def decisions(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each gram's last byte: the eight binary nodes (1..255) and bits, shape (n, 8)."""
    y = (gram & 255)[:, None]
    j = np.arange(8)
    return (256 | y) >> (8 - j), (y >> (7 - j)) & 1


class Subtree:
    """Counts and weights of the contexts that end in the same two bytes.

    Levels from 4 on hold the nodes that occur, as sorted (context, node) keys; the two
    above are dense.
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        own = n > 0
        gram, n = gram[own], n[own]
        node, bit = decisions(gram)
        key = ((gram >> 8)[:, None] << 8 | node).ravel()
        count, bit = np.repeat(n, 8).astype(np.float64), bit.ravel()
        zeros, ones, down = count * (1 - bit), count * bit, None
        self.levels: list[tuple[np.ndarray, ...]] = []
        for d in range(DEPTH, 3, -1):
            key, at = np.unique((key >> 8 & (1 << 8 * d) - 1) << 8 | key & 255, return_inverse=True)
            zeros, ones = (np.bincount(at, x, len(key)) for x in (zeros, ones))
            down = block_estimate(zeros, ones) if d == DEPTH else weighted(zeros, ones, np.bincount(at, down, len(key)))
            self.levels.insert(0, (key, zeros, ones, down))
        third = (key >> 24 & 255) << 8 | key & 255
        self.zeros3, self.ones3, down = (np.bincount(third, x, 65536).reshape(256, 256) for x in (zeros, ones, down))
        self.weighted3 = weighted(self.zeros3, self.ones3, down)
        self.zeros2, self.ones2 = self.zeros3.sum(axis=0), self.ones3.sum(axis=0)
        self.weighted2 = weighted(self.zeros2, self.ones2, self.weighted3.sum(axis=0))

    def log10(self, gram: np.ndarray, reach: np.ndarray, sure: np.ndarray) -> np.ndarray:
        """Log probability of each gram's last byte, given what the levels above pass on."""
        reach, sure = below(reach, sure, self.zeros2, self.ones2, self.weighted2)
        reach, sure = below(reach[None, :], sure[None, :], self.zeros3, self.ones3, self.weighted3)
        out = np.empty(len(gram))
        for at in range(0, len(gram), 1 << 16):
            g = gram[at : at + (1 << 16)]
            node, bit = decisions(g)
            third = (g >> 24 & 255)[:, None]
            deeper, one = reach[third, node], sure[third, node]
            for d, (keys, *level) in enumerate(self.levels, 4):
                key = (g >> 8 & (1 << 8 * d) - 1)[:, None] << 8 | node
                zeros, ones, weights = (np.zeros(key.shape) for _ in range(3))
                if len(keys):
                    i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    seen = keys[i] == key
                    zeros, ones, weights = (np.where(seen, x[i], 0) for x in level)
                if d < DEPTH:
                    deeper, one = below(deeper, one, zeros, ones, weights)
                else:
                    one = one + deeper * (ones + 0.5) / (zeros + ones + 1)
            out[at : at + len(g)] = np.log10(np.where(bit == 1, one, 1 - one)).sum(axis=1)
        return out


def top_levels(zeros1: np.ndarray, ones1: np.ndarray, down1: np.ndarray):
    """What depths 0 and 1 pass on after each last byte; arrays are (bytes, 256 nodes)."""
    weighted1 = weighted(zeros1, ones1, down1)
    zeros0, ones0 = zeros1.sum(axis=0), ones1.sum(axis=0)
    weighted0 = weighted(zeros0, ones0, weighted1.sum(axis=0))
    reach, sure = below(np.ones(256), np.zeros(256), zeros0, ones0, weighted0)
    return below(reach[None, :], sure[None, :], zeros1, ones1, weighted1)


def byte_grams(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All grams of DEPTH + 1 bytes that end in a byte of a document, and each document's count of them."""
    bodies = [b"".join((b" ".join(w), b" \n")) if (w := d.split()) else b"\n" for d in docs]
    start = b"\n" * DEPTH
    buf = np.frombuffer(b"".join(x for body in bodies for x in (start, body)), np.uint8)
    sizes = np.array([len(b) for b in bodies], np.int64)
    gram = np.zeros(len(buf) - DEPTH, np.int64)
    for j in range(DEPTH + 1):
        gram <<= 8
        gram |= buf[j : len(buf) - DEPTH + j]
    # gram i ends at byte i + DEPTH; those that end in the line feeds before a document are dropped
    inside = np.ones(len(gram), bool)
    later = np.cumsum(sizes + DEPTH)[:-1] - DEPTH
    inside[(later[:, None] + np.arange(DEPTH)).ravel()] = False
    return gram[inside], sizes


def reduced(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of n."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def counted(values: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each stands in training documents; sorts twice, moves nothing else."""
    keys = np.sort(values)
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
    own = np.sort(values[train])
    return keys, np.searchsorted(own, keys, "right") - np.searchsorted(own, keys, "left")


def grams_counted(gram: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`counted` for grams, which leave room for the flag: one sort."""
    packed = np.sort(gram << 1 | train)
    first = np.flatnonzero(np.concatenate(([True], packed[1:] >> 1 != packed[:-1] >> 1))) if len(packed) else np.empty(0, np.int64)
    return packed[first] >> 1, np.add.reduceat(packed & 1, first) if len(first) else packed[:0]


def gram_sums(gram: np.ndarray, sizes: np.ndarray, keys: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Each document's sum of its grams' logs; grams are sorted with their document's number in the lowest 16 bits."""
    out = np.zeros(len(sizes))
    ends = np.cumsum(sizes)
    for low in range(0, len(sizes), 1 << 16):
        n = min(1 << 16, len(sizes) - low)
        own = gram[ends[low] - sizes[low] : ends[low + n - 1]]
        packed = np.sort(own.astype(np.uint64) << np.uint64(16) | np.repeat(np.arange(n, dtype=np.uint64), sizes[low : low + n]))
        first = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
        times = np.diff(np.append(first, len(packed)))
        pair = packed[first]
        value = (pair >> np.uint64(16)).astype(np.int64)
        new = np.concatenate(([True], value[1:] != value[:-1]))
        found = logs[np.searchsorted(keys, value[new])][np.cumsum(new) - 1]
        out[low : low + n] = np.bincount((pair & np.uint64(65535)).astype(np.int64), found * times, n)
    return out


def segment_buckets(spark) -> int:
    """Buckets of keys: 1024 at most in sessions of a usual width, so that the segments of a portion do not grow short as the session grows wide."""
    return min(bucket_count(spark), max(1024, width(spark) // 4))


def _bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix64(key.view(np.uint64)) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def planes(x: np.ndarray) -> bytes:
    """Numbers of eight bytes with all first bytes together, then all second ones and so on: like bytes stand together, as codecs like it."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(data: bytes, kind=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def pack_keys(key: np.ndarray) -> bytes:
    """A sorted segment: its first key and the steps between keys."""
    return planes(np.diff(key, prepend=key.dtype.type(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data))


def _joined(segments, kind=np.int64) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *segments])


def _lists(x: np.ndarray):
    import pyarrow as pa

    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x, np.float64).ravel()), 256).cast(pa.list_(pa.float64()))


def _dense(column) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), np.float64).reshape(-1, 256)


def context_tree_scores(docs: DataFrame, held_out, portion_mb: float = 16) -> DataFrame:
    """Learn from the documents that do not meet `held_out` and score all of them.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes
    and bits_per_byte.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    texts, kept, buckets = new_folder(spark, "portions"), new_folder(spark, "segments"), segment_buckets(spark)

    @tidy
    def gather(batches):
        import pyarrow as pa

        for i, t in enumerate(portions(batches, 1, portion_mb * 1e6)):
            g, train = portion_id(i), ~t.column("held_out").to_numpy()
            keep_portion(texts, g, t)
            found: list[list] = [[], []]
            for first, part in chunks(x.lower() for x in utf8(t.column("text"))):
                own = train[first : first + len(part)]
                gram, sizes = byte_grams(part)
                found[0].append(grams_counted(gram, np.repeat(own, sizes)))
                words, sizes = hash_words(part)
                found[1].append(counted(words.view(np.int64), np.repeat(own, sizes)))
            for kind, parts in enumerate(found):
                key, n = reduced(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                own = _bucket_of(key, buckets)
                order = np.argsort(own.astype(np.uint16) if buckets <= 1 << 16 else own, kind="stable")
                key, n = key[order], n[order].astype(np.int64)
                cuts = np.searchsorted(own[order], np.arange(buckets + 1, dtype=np.uint64))
                some = np.flatnonzero(np.diff(cuts))
                for at in range(0, len(some), 64):
                    few = some[at : at + 64]
                    ends = list(zip(cuts[few].tolist(), cuts[few + 1].tolist(), strict=True))
                    columns = [pa.array(few, pa.int32()), pa.array(np.full(len(few), g)), pa.array(np.full(len(few), kind, np.int32)), pa.array([pack_keys(key[a:b]) for a, b in ends]), pa.array([planes(n[a:b]) for a, b in ends])]
                    yield pa.RecordBatch.from_arrays(columns, names=["bucket", "g", "kind", "keys", "counts"])

    @released
    def merge(t):
        import pyarrow as pa

        bucket = t.column("bucket")[0].as_py()
        keep_portion(kept, bucket, t.select(["g", "kind", "keys"]))
        tables = []
        for k in (0, 1):
            own = t.filter(pa.array(t.column("kind").to_numpy() == k))
            key, n = reduced(_joined(map(unpack_keys, own.column("keys").to_pylist())), _joined(map(unplanes, own.column("counts").to_pylist())))
            tables.append(pa.table({"bucket": np.full(len(key), bucket, np.int32), "kind": np.full(len(key), k, np.int32), "key": key, "n": n}))
        return pa.concat_tables(tables)

    segments = rows.mapInArrow(gather, "bucket int, g long, kind int, keys binary, counts binary")
    totals, _ = written(spark, segments.groupBy("bucket").applyInArrow(merge, "bucket int, kind int, key long, n long"), "totals")
    words = totals.filter("kind = 1").select("bucket", "kind", "key", F.col("n").cast("double").alias("value"))
    grams = totals.filter("kind = 0").select("bucket", "key", "n", (F.shiftright("key", 8).bitwiseAND(F.lit(65535))).alias("pair"))
    dense = ("zeros", "ones", "weights")

    @released
    def grow(t):
        import pyarrow as pa

        tree = Subtree(t.column("key").to_numpy(), t.column("n").to_numpy())
        last = pa.array([t.column("pair")[0].as_py() & 255], pa.int32())
        return pa.table({"last": last, **{k: _lists(x) for k, x in zip(dense, (tree.zeros2, tree.ones2, tree.weighted2), strict=True)}})

    def add(t):
        import pyarrow as pa

        return pa.table({"last": t.column("last").slice(0, 1), **{k: _lists(_dense(t.column(k)).sum(axis=0)) for k in dense}})

    kinds = "last int, " + ", ".join(f"{k} array<double>" for k in dense)
    roots, _ = written(spark, grams.groupBy("pair").applyInArrow(grow, kinds).groupBy("last").applyInArrow(add, kinds), "roots")  # what the subtrees took to get here goes
    roots = roots.toArrow()  # at most 256 rows
    order = np.argsort(roots.column("last").to_numpy())
    reach, sure = top_levels(*(_dense(roots.column(k))[order] for k in dense)) if len(order) else (None, None)
    place = {int(b): i for i, b in enumerate(roots.column("last").to_numpy()[order])}

    @released
    def predict(t):
        import pyarrow as pa

        gram, at = t.column("key").to_numpy(), place[t.column("pair")[0].as_py() & 255]
        tree = Subtree(gram, t.column("n").to_numpy())
        return pa.table({"bucket": t.column("bucket"), "kind": np.zeros(len(gram), np.int32), "key": gram, "value": tree.log10(gram, reach[at], sure[at])})

    model = grams.groupBy("pair").applyInArrow(predict, "bucket int, kind int, key long, value double")
    counts = words.agg(F.coalesce(F.sum("value"), F.lit(0.0)), F.sum((F.col("value") > 0).cast("long"))).first()
    ends = rows.filter(~F.col("held_out")).count()
    n_train, distinct = int(counts[0]) + ends, int(counts[1] or 0) + (ends > 0)

    @released
    def answer(t):
        import pyarrow as pa

        held = read_portion(kept, t.column("bucket")[0].as_py())
        kind, key, value = (t.column(c).to_numpy() for c in ("kind", "key", "value"))
        known = []
        for k in (0, 1):
            at = np.flatnonzero(kind == k)
            at = at[np.argsort(key[at])]
            known.append((key[at], value[at]))
        values = []
        for k, own in zip(held.column("kind").to_pylist(), held.column("keys").to_pylist(), strict=True):
            keys, found = known[k]
            values.append(planes(found[np.searchsorted(keys, unpack_keys(own))]))
        return held.append_column("values", pa.array(values, pa.binary()))

    answers = model.unionByName(words).groupBy("bucket").applyInArrow(answer, "g long, kind int, keys binary, values binary")

    @released
    def score(own):
        import pyarrow as pa

        t = read_portion(texts, own.column("g")[0].as_py())
        tables = []
        for k in (0, 1):
            part = own.filter(pa.array(own.column("kind").to_numpy() == k))
            key, value = _joined(map(unpack_keys, part.column("keys").to_pylist())), _joined((unplanes(x, np.float64) for x in part.column("values").to_pylist()), np.float64)
            at = np.argsort(key)
            tables.append((key[at], value[at]))
        (grams, logs), (vocabulary, seen) = tables
        scale = n_train + 0.5 * (distinct + 1)
        word_logs = np.log10((seen + 0.5) / scale)
        end_log = np.log10((ends + 0.5) / scale)
        parts = []
        for _, part in chunks(x.lower() for x in utf8(t.column("text"))):
            gram, sizes = byte_grams(part)
            total = gram_sums(gram, sizes, grams, logs)
            hashes, n = hash_words(part)
            at, doc = np.searchsorted(vocabulary, hashes.view(np.int64)), np.repeat(np.arange(len(part)), n)
            at_known = np.bincount(doc, seen[at] > 0, len(part)) if len(at) else np.zeros(len(part))
            base = np.bincount(doc, word_logs[at], len(part)) if len(at) else np.zeros(len(part))
            parts.append((n + 1, at_known.astype(np.int64) + (ends > 0), base + end_log, total, sizes))
        n, at_known, base, total, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        names = "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"
        return pa.table([t.column("doc_id"), t.column("held_out"), n, at_known, np.full(len(n), n_train), base, total, sizes, -total / sizes / np.log10(2)], names=names)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return answers.groupBy("g").applyInArrow(score, schema)
