"""Substring deduplication with a log-structured index of window fingerprints (operator 10).

A window is `window` consecutive words of one document.  Documents come in batches.  A
batch's windows are sent by the range of their fingerprint to a bucket; there they become a
sorted immutable run, which is merge-joined with the runs of the history: a window is
repeated where its words also start in a document of an earlier batch, or in one of the
same batch with a smaller doc_id.  The run keeps what the history lacks.  Runs stand in
levels; `fanout` runs of a level are merged into one of the next, so a window is rewritten
once a level, however many batches follow.  Every word that a repeated window covers goes.

What is compared is 64 bits of fingerprint, by which runs are sorted, and 32 further bits
from another hash of the same words, by which each match is verified before it counts and
before runs are compacted.  Windows that agree in the first and not in the second are
entries of their own, so a false match hides no true one.

Documents send a portion's distinct windows with the least doc_id that holds each; the
bucket answers with those that stand earlier elsewhere.  A window that a third of all
documents share is thus one row a portion, and the text is not shuffled.

An index is a folder: runs as files, one a bucket, and numbered manifests that list the
runs.  `FingerprintIndex.create`, `open` and `add` work across sessions; a batch counts once
its manifest is written.

Behaviour: null and empty texts have no words; a null doc_id neither owns nor loses
anything; rows that repeat a doc_id do not remove each other's words within a batch; an
empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, drop_path, hash_words, new_folder, released, rolling, scratch_path, tidy, utf8, width, written
from .files import open_fs, write_whole
from .portions import bucket_count, bucket_cuts, keep_portion, portion_id, portions, read_portion

# ------------------------------------------------------------------- segments


def _narrow(x: np.ndarray) -> np.ndarray:
    """The smallest unsigned type that holds x."""
    top = int(x.max(initial=0))
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def _planes(x: np.ndarray) -> np.ndarray:
    """The bytes of x, all lowest first; compresses what is often zero."""
    x = _narrow(x)
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).ravel()


def write_segment(*columns: np.ndarray) -> bytes:
    """Columns of non-negative numbers (the first one sorted) in few bytes."""
    import pyarrow as pa

    first = np.diff(columns[0].astype(np.uint64), prepend=np.uint64(0))
    parts = [_planes(first), *(_planes(c.astype(np.uint64)) for c in columns[1:])]
    head = np.array([len(first), *(len(p) for p in parts)], "<u8").tobytes()
    raw = b"".join([head, *(p.tobytes() for p in parts)])
    return np.array([len(parts), len(raw)], "<u8").tobytes() + pa.Codec("zstd").compress(raw, asbytes=True)


def read_segment(data: bytes) -> list[np.ndarray]:
    import pyarrow as pa

    k, size = map(int, np.frombuffer(data, "<u8", 2))
    raw = pa.Codec("zstd").decompress(memoryview(data)[16:], size, asbytes=True)
    n, *sizes = map(int, np.frombuffer(raw, "<u8", k + 1))
    out, at = [], 8 * (k + 1)
    for s in sizes:
        own = np.zeros((n, 8), np.uint8)
        own[:, : s // n if n else 0] = np.frombuffer(raw, np.uint8, s, at).reshape(-1, n).T if n else 0
        out.append(own.view(np.uint64).ravel())
        at += s
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


# -------------------------------------------------------------------- windows


def firsts(fp: np.ndarray, check: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """An order in which equal (fp, check) stand together, or None if they do as they are; where each begins.

    `fp` is sorted; only where one fingerprint has several checks must anything move.
    """
    if not len(fp):
        return None, np.empty(0, np.int64)
    same = fp[1:] == fp[:-1]
    order = None
    if (same & (check[1:] != check[:-1])).any():
        order = np.lexsort((check, fp))
        fp, check = fp[order], check[order]
        same = fp[1:] == fp[:-1]
    return order, np.flatnonzero(np.concatenate(([True], ~same | (check[1:] != check[:-1]))))


class Windows:
    """The windows of a portion's documents: sorted distinct (fp, check), and where they stand."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, known: np.ndarray, window: int, bits: int = 64):
        held, self.counts = [], np.empty(0, np.int64)
        counts_of = []
        for first, part in chunks(texts):
            words, counts = hash_words(part)
            counts_of.append(counts)
            fp = rolling(words, window)
            doc = np.repeat(np.arange(len(part), dtype=np.int32), counts)
            at = (np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
            inside = np.flatnonzero((doc[: len(fp)] == doc[window - 1 :]) & known[first + doc[: len(fp)]]) if len(fp) else np.empty(0, np.int64)
            check = (rolling(words, window, salt=1)[inside] >> np.uint64(32)).astype(np.uint32) if len(inside) else np.empty(0, np.uint32)
            held.append((fp[inside] >> np.uint64(64 - bits) << np.uint64(64 - bits), check, doc[inside] + np.int32(first), at[inside]))
        if counts_of:
            self.counts = np.concatenate(counts_of)
        none = (np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int32), np.empty(0, np.int32))
        fp, check, doc, at = (np.concatenate(x) for x in zip(none, *held, strict=True))
        held.clear()
        order = np.argsort(fp, kind="stable")
        fp, check, self.doc, self.at = fp[order], check[order], doc[order], at[order]
        order, self.first = firsts(fp, check)
        if order is not None:
            fp, check, self.doc, self.at = fp[order], check[order], self.doc[order], self.at[order]
        self.fp, self.check = fp[self.first], check[self.first]
        #: Of each distinct window, the least doc_id that holds it.
        self.least = np.minimum.reduceat(ids[self.doc], self.first) if len(self.first) else np.empty(0, np.int64)

    def repeated(self, ids: np.ndarray, elsewhere: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, place) of the windows that stand earlier: all those of `elsewhere`, and those after a smaller doc_id here."""
        n = np.diff(np.append(self.first, len(self.doc)))
        early = np.zeros(len(self.first), bool)
        early[elsewhere] = True
        gone = np.repeat(early, n) | (ids[self.doc] > np.repeat(self.least, n))
        return self.doc[gone], self.at[gone]


def covered(doc: np.ndarray, at: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Which words of the documents, in a row, lie in these windows."""
    base = np.concatenate(([0], np.cumsum(counts)))
    start = base[doc] + at
    edge = np.bincount(start, minlength=int(base[-1]) + 1) - np.bincount(start + window, minlength=int(base[-1]) + 1)
    return np.cumsum(edge[:-1]) > 0


# ----------------------------------------------------------------------- index


def _bucket_file(run: str, bucket: int) -> str:
    return f"{run}/bucket-{bucket:07d}.seg"


def read_runs(runs: list[dict], bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket's sorted (fp, check) of all runs."""
    parts = [(np.empty(0, np.uint64), np.empty(0, np.uint64))]
    for r in runs:
        if bucket in r["buckets"]:
            fs, path = open_fs(_bucket_file(r["path"], bucket))
            with fs.open_input_file(path) as f:
                parts.append(tuple(read_segment(f.read())))
    fp, check = (np.concatenate(x) for x in zip(*parts, strict=True))
    if len(parts) > 2:
        order = np.argsort(fp, kind="stable")  # sorted runs, which this sort merges
        fp, check = fp[order], check[order]
    return fp, check


def among(fp: np.ndarray, check: np.ndarray, past_fp: np.ndarray, past_check: np.ndarray) -> np.ndarray:
    """Which (fp, check) the past holds; `past_fp` is sorted, and may hold a fingerprint with several checks."""
    found = np.zeros(len(fp), bool)
    if not len(past_fp):
        return found
    at, live = np.searchsorted(past_fp, fp), np.arange(len(fp))
    while len(live):
        own = at[live]
        live = live[(own < len(past_fp)) & (past_fp[np.minimum(own, len(past_fp) - 1)] == fp[live])]
        hit = past_check[at[live]] == check[live]
        found[live[hit]] = True
        live = live[~hit]
        at[live] += 1
    return found


class FingerprintIndex:
    """The history of window fingerprints in a folder."""

    def __init__(self, spark: SparkSession, root: str, state: dict):
        self.spark, self.root, self.state = spark, root, state

    @classmethod
    def create(cls, spark: SparkSession, root: str, window: int = 13, buckets: int | None = None, fanout: int = 2, bits: int = 64) -> FingerprintIndex:
        """A new index.  `buckets` stays as it is for the index's life; `bits` below 64 only serve tests."""
        index = cls(spark, root, {"version": 0, "window": window, "buckets": buckets or bucket_count(spark), "fanout": fanout, "bits": bits, "runs": []})
        index._commit([])
        return index

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> FingerprintIndex:
        """An index as its newest manifest has it."""
        from pyarrow.fs import FileSelector

        fs, path = open_fs(root)
        newest = max(x.path for x in fs.get_file_info(FileSelector(path)) if x.base_name.startswith("manifest-") and x.base_name.endswith(".json"))
        with fs.open_input_file(newest) as f:
            return cls(spark, root, json.loads(f.read()))

    def _commit(self, runs: list[dict]) -> None:
        self.state = {**self.state, "version": self.state["version"] + 1, "runs": runs}
        write_whole(f"{self.root}/manifest-{self.state['version']:09d}.json", [json.dumps(self.state).encode()])

    def _new_run(self) -> str:
        return f"{self.root}/run-{uuid.uuid4().hex}"

    def add(self, batch: DataFrame, carry: list[str] | None = None, portion_mb: float = 8, last: bool = False) -> tuple[DataFrame, str]:
        """Take a batch in; (portion, places) of its repeated windows, and the folder of its portions.

        `last` leaves the batch's own run unwritten, for a history that ends here.
        """
        spark, window, buckets, bits = self.spark, self.state["window"], self.state["buckets"], self.state["bits"]
        texts, run, runs = new_folder(spark, "portions"), self._new_run(), [{**r, "buckets": set(r["buckets"])} for r in self.state["runs"]]

        @tidy
        def send(batches):
            import pyarrow as pa

            for k, t in enumerate(portions(batches, 1, portion_mb * 1e6)):
                g = portion_id(k)
                keep_portion(texts, g, t)
                ids, known = doc_ids(t)
                own = Windows(utf8(t.column(1)), ids, known, window, bits)
                cuts = bucket_cuts(own.fp, buckets)
                some = [b for b in range(buckets) if cuts[b] < cuts[b + 1]] or [0]  # each portion gets an answer
                docs, place = np.unique(own.least, return_inverse=True)
                segments = []
                for b in some:
                    x = slice(cuts[b], cuts[b + 1])
                    used, at = np.unique(place[x], return_inverse=True)
                    segments.append(np.array([len(used)], "<u8").tobytes() + docs[used].astype("<i8").tobytes() + write_segment(own.fp[x], own.check[x], at))
                del own
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([g] * len(some), pa.int64()), pa.array(segments, pa.binary())], names=["bucket", "g", "segment"])

        @released
        def join(t):
            import pyarrow as pa

            bucket, parts = t.column("bucket")[0].as_py(), []
            for x in t.column("segment"):
                x = x.as_py()
                k = int(np.frombuffer(x, "<u8", 1)[0])
                fp, check, at = read_segment(x[8 + 8 * k :])
                parts.append((fp, check.astype(np.uint32), np.frombuffer(x, "<i8", k, 8)[at.astype(np.int64)]))
            sizes = [len(x[0]) for x in parts]
            fp, check, least = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            order = np.argsort(fp, kind="stable")  # sorted segments, which this sort merges
            fp, check = fp[order], check[order]
            move, first = firsts(fp, check)
            if move is not None:
                order, fp, check = order[move], fp[move], check[move]
            n = np.diff(np.append(first, len(fp)))
            owner = np.minimum.reduceat(least[order], first) if len(first) else least
            past = among(fp[first], check[first].astype(np.uint64), *read_runs(runs, bucket))
            early = np.empty(len(fp), bool)
            early[order] = np.repeat(past, n) | (least[order] > np.repeat(owner, n))
            if not last:
                new = first[~past]
                write_whole(_bucket_file(run, bucket), [write_segment(fp[new], check[new])])
            cuts = np.cumsum([0, *sizes])
            answers = [write_segment(np.flatnonzero(early[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.table({"g": t.column("g"), "bucket": t.column("bucket"), "answer": pa.array(answers, pa.binary())})

        rows = batch.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry or [])))
        sent = rows.mapInArrow(send, "bucket int, g long, segment binary")
        found, _ = written(spark, sent.groupBy("bucket").applyInArrow(join, "g long, bucket int, answer binary"), "repeats")
        if not last:
            filled = sorted(r[0] for r in found.select("bucket").distinct().collect())  # at most `buckets` numbers
            self._commit([*self.state["runs"], {"level": 0, "path": run, "buckets": filled}])
            self._compact()
        return found, texts

    def _compact(self) -> None:
        """Merge the runs of each level that has `fanout` of them."""
        level = 0
        while True:
            own = [r for r in self.state["runs"] if r["level"] == level]
            if len(own) < self.state["fanout"]:
                if not any(r["level"] > level for r in self.state["runs"]):
                    return
                level += 1
                continue
            run, runs = self._new_run(), [{**r, "buckets": set(r["buckets"])} for r in own]
            filled = set().union(*(r["buckets"] for r in runs))

            def merge(batches, run=run, runs=runs, filled=filled):
                import pyarrow as pa

                for b in batches:
                    for bucket in filled.intersection(b.column(0).to_pylist()):
                        write_whole(_bucket_file(run, bucket), [write_segment(*read_runs(runs, bucket))])
                        yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64())})

            spark = self.spark
            asked = spark.range(self.state["buckets"], numPartitions=min(self.state["buckets"], width(spark)))
            asked.mapInArrow(merge, "bucket long").write.format("noop").mode("overwrite").save()
            gone = {r["path"] for r in own}
            self._commit([*(r for r in self.state["runs"] if r["path"] not in gone), {"level": level + 1, "path": run, "buckets": sorted(filled)}])
            for path in gone:
                drop_path(spark, path)

    def drop(self) -> None:
        drop_path(self.spark, self.root)


def doc_ids(t) -> tuple[np.ndarray, np.ndarray]:
    """A portion's doc_ids, and which are not null."""
    column = t.column(0)
    return column.fill_null(0).to_numpy(), ~column.is_null().to_numpy()


def remove_repeats(found: DataFrame, texts: str, index: FingerprintIndex, kinds: list[str], with_text: bool) -> DataFrame:
    """The rows of a batch without the words that repeated windows cover."""
    window, bits, buckets = index.state["window"], index.state["bits"], index.state["buckets"]

    @released
    def apply(answers):
        import pyarrow as pa

        t = read_portion(texts, answers.column("g")[0].as_py())
        ids, known = doc_ids(t)
        raw = utf8(t.column(1))
        own = Windows(raw, ids, known, window, bits)
        cuts = bucket_cuts(own.fp, buckets)
        early = [np.empty(0, np.int64)]
        for b, x in zip(answers.column("bucket").to_pylist(), answers.column("answer").to_pylist(), strict=True):
            early.append(cuts[b] + read_segment(x)[0].astype(np.int64))
        gone = covered(*own.repeated(ids, np.concatenate(early)), own.counts, window)
        base = np.concatenate(([0], np.cumsum(own.counts)))
        lost = np.add.reduceat(np.append(gone, False).astype(np.int64), base[:-1]) * (own.counts > 0) if len(own.counts) else own.counts
        shas, left = [], []
        for i, text in enumerate(raw):
            if lost[i]:
                words = text.split()
                text = kept = b" ".join([words[j] for j in np.flatnonzero(~gone[base[i] : base[i + 1]]).tolist()])
            else:
                kept = b" ".join(text.split())
            shas.append(hashlib.sha256(kept).hexdigest())
            left.append(text)
        cols = {"doc_id": t.column(0), "n_words": pa.array(own.counts), "n_removed": pa.array(lost), "kept_sha256": pa.array(shas, pa.string())}
        if with_text:
            cols["text"] = pa.array([x if v else None for x, v in zip(left, t.column(1).is_valid().to_pylist(), strict=True)], pa.binary()).cast(pa.string())
        return pa.table(cols | {f"_c{i}": t.column(2 + i) for i in range(len(kinds))})

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text + "".join(f", _c{i} {k}" for i, k in enumerate(kinds))
    return found.groupBy("g").applyInArrow(apply, schema)


def deduplicate_batch(index: FingerprintIndex, batch: DataFrame, with_text: bool = False, carry: list[str] | None = None, portion_mb: float = 8, last: bool = False) -> DataFrame:
    """Take a batch into an index and return its rows as `deduplicate_substrings` does."""
    found, texts = index.add(batch, carry, portion_mb, last)
    kinds = [batch.schema[c].dataType.simpleString() for c in carry or []]
    return remove_repeats(found, texts, index, kinds, with_text).withColumnsRenamed({f"_c{i}": c for i, c in enumerate(carry or [])})


def deduplicate_substrings(docs: DataFrame, window: int = 13, batches: int = 4, portion_mb: float = 8, with_text: bool = False, carry: list[str] | None = None, buckets: int | None = None, bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row; `with_text` adds what is left of the text, `carry` other columns of `docs`.

    The table goes through a new index in `batches` of ascending doc_id.  A text that loses
    nothing stays as it is; of others the kept words are joined by one space.
    """
    spark = docs.sparkSession
    index = FingerprintIndex.create(spark, scratch_path(spark, "index"), window, buckets, bits=bits)
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    out: DataFrame | None = None
    id_ = F.col("doc_id")
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        own = docs
        if low is not None:
            own = own.filter(id_ > int(low))
        if high is not None:  # rows without an id go with the first batch
            own = own.filter((id_ <= int(high)) if low is not None else (id_.isNull() | (id_ <= int(high))))
        part = deduplicate_batch(index, own, with_text, carry, portion_mb, last=high is None)
        out = part if out is None else out.unionByName(part)
    index.drop()
    return out
