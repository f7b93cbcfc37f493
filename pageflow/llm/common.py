"""Shared pieces: scratch tables in the cluster's shared folder, chunking, word hashes.

Hashes are 64 bit.  They are computed in numpy, eight bytes of every word at a time, without
a Python object for each word, and are stable across processes and runs.
"""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Only where the session names none (a local session, as in tests) a local
    temporary folder is used.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = [f"file://{tempfile.mkdtemp(prefix='pageflow-')}"]
    return _scratch[app][0]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of what runs inside go as soon as it is done, not when the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1024):
    """What is planned inside sends texts to Python by so many rows, so that few lie in the buffers of both sides."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def written(spark: SparkSession, df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write `df` to the shared folder and read it back."""
    path = new_folder(spark, label)
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


_made: list[list[str]] = []


def new_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that goes when the driver ends, or what `temporary` encloses."""
    path = scratch_path(spark, label)
    atexit.register(_drop_quietly, spark, path)
    for own in _made:
        own.append(path)
    return path


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Folders made inside go at the end, but for those that are appended to what this gives."""
    made: list[str] = []
    kept: list[str] = []
    _made.append(made)
    try:
        yield kept
    finally:
        _made.pop()  # the innermost one
        for path in made:
            if path not in kept:
                _drop_quietly(spark, path)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass


def width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_groups(docs: DataFrame, mb: float) -> int:
    """How many groups of about `mb` MB of text the table makes; grows with the table."""
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, int(np.ceil(total / (mb * 1e6))))


# ------------------------------------------------------------------- numpy text

#: Bytes that end a word: space and the five control characters from tab to return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
SEGMENT = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_WIDTH = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 8)), (1 << 64) - 1], np.uint64)
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_FACTOR = np.uint64(0xD1342543DE82EF95)
#: Longer words are hashed one by one.
LONG_WORD = 256


def eights(data: bytes) -> np.ndarray:
    """The eight bytes from each place of `data` on, which must end in eight bytes that are not its own."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))


def hash_spans(data: bytes, eight: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the bytes at `start`, `size` of them: eight bytes after eight are mixed in, so words that
    differ only in where like parts stand do not collide by their structure.  Equally long words of at most eight
    bytes never collide."""
    h = _SEEDS[seed] ^ (size.astype(np.uint64) * _FACTOR)
    live, at, left = np.arange(len(start)), start, size
    long = np.flatnonzero(size > LONG_WORD)
    if len(long):
        live = np.flatnonzero(size <= LONG_WORD)
        at, left = start[live], size[live]
    while len(live):
        h[live] = mix64((h[live] ^ (eight[at] & _WIDTH[np.minimum(left, 8)])) * _FACTOR)
        more = np.flatnonzero(left > 8)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in long.tolist():
        own = hashlib.blake2b(data[start[i] : start[i] + size[i]], digest_size=8, salt=bytes([seed]))
        h[i] = int.from_bytes(own.digest(), "little")
    return h


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    edge = np.diff(np.concatenate(([True], SPACES[buf], [True])).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _segments(data: bytes, size: int) -> Iterator[tuple[int, int]]:
    """Cuts of the first `size` bytes, at most SEGMENT each, where a word ends; a longer word stays whole."""
    at = 0
    while at < size:
        end = min(size, at + SEGMENT)
        while end < size and not SPACES[data[end]]:
            end += 1
        yield at, end
        at = end


def hash_words(docs: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the documents in order, and each document's count of words."""
    data = b"\n".join(docs) + bytes(8)
    eight = eights(data)
    hashes, starts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for at, end in _segments(data, len(data) - 8):
        s, e = word_bounds(np.frombuffer(data, np.uint8, end - at, at))
        hashes.append(hash_spans(data, eight, s + at, e - s, seed))
        starts.append(s + at)
    edges = np.cumsum([0] + [len(d) + 1 for d in docs])
    counts = np.diff(np.searchsorted(np.concatenate(starts), edges))
    return np.concatenate(hashes), counts.astype(np.int64)


_PAIR = np.uint64(0xF1357AEA2E62A9C5)


def rolling(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of k consecutive words (also those that cross documents).

    Runs of 1, 2, 4, ... words are joined two by two; `salt` gives independent hashes.
    """
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    part, size = mix64(words ^ np.uint64(salt * 0x632BE59BD9B4E019 % (1 << 64))), 1
    out, done = None, 0
    while True:
        if k & size:
            own = part[done : done + n]
            out = own if out is None else mix64(out * _PAIR + own)
            done += size
        if done == k:
            return mix64(out + np.uint64(k))
        part = mix64(part[:-size] * _PAIR + part[size:])
        size *= 2


def chunks(texts: Iterable[bytes], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about `most` bytes together, with the first one's position."""
    own, size, first = [], 0, 0
    for i, t in enumerate(texts):
        own.append(t)
        size += len(t)
        if size >= most:
            yield first, own
            own, size, first = [], 0, i + 1
    if own:
        yield first, own


def release() -> None:
    """Give freed memory back to the system; Python workers outlive their tasks and idle beside others."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def released(work):
    """A function over one or two Arrow tables that gives its memory back when it is done."""

    def one(t):
        try:
            return work(t)
        finally:
            release()

    def two(t, u):
        try:
            return work(t, u)
        finally:
            release()

    return two if work.__code__.co_argcount == 2 else one  # Spark counts the arguments


def tidy(work):
    """A function over an iterator of batches that gives its memory back when it is done."""

    def all_of(batches):
        try:
            yield from work(batches)
        finally:
            release()

    return all_of


def utf8(column) -> list[bytes]:
    """The bytes of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
