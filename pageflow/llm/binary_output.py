"""Token ids in Simple-8b files (operator 5).

File: eight 64-bit little-endian counts (magic, ids, blocks, words, escapes, documents,
codebook entries, ids a block), then in this order
  codebook   u64 each: the file's distinct ids, most frequent first
  block_word u64 each: the block's first word (the per-block offsets; every block but the
             last has `ids a block` ids, so any block decodes by itself)
  block_esc  u64 each: the block's first escape
  words      u64 each: selector in the upper 4 bits, packed codes in the lower 60
  escapes    u64 each: codes of 60 bits and more, in order; selector 15 stands for one
  documents  i64 doc_id, u8 1 where doc_id is null, u64 number of ids
Codes are places in the codebook, so frequent ids take few bits.

Documents are dealt to tasks by ranges of (doc_id, a hash of the text), so rows that share
a doc_id spread like others; a task writes a file for each `text_mb` MB of text.  The list of
files is a table: the driver holds none of it.

Behaviour: null text counts as empty (its end id only); rows with a null doc_id come
first; repeated doc_ids keep one entry per row, ordered by the hash of the text and the
text; an empty table gives no file and no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_folder, small_batches, text_groups, tidy, width, written
from .files import open_fs, write_whole

#: Ids in a word by selector, each in 60 // n bits (the word's 60 bits); 15 is the escape.
COUNTS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0, 1], np.int64)
WIDTHS = np.array([60 // n if n else 0 for n in COUNTS], np.int64)
LAST, ESCAPE = 13, 15
MAGIC = 0x3142385345444F43
BLOCK = 256


def _widths(codes: np.ndarray) -> np.ndarray:
    """Bits of each code; a code that rounds up to the next power counts one more."""
    return np.frexp(codes.astype(np.float64))[1].astype(np.uint8)


def _choices(bits: np.ndarray) -> np.ndarray:
    """The last selector whose count of codes from each place on fits, wherever a block ends.

    If n codes fit in 60 // n bits, so do fewer.  The most bits of a window come from two
    windows of a power of two that cover it.
    """
    n = len(bits)
    padded = np.concatenate((bits, np.full(64, 255, np.uint8)))
    power = {1: padded}
    for k in (1, 2, 4, 8, 16):
        power[2 * k] = np.maximum(power[k][:-k], power[k][k:])
    chosen = np.where(bits <= 60, np.uint8(0), np.uint8(ESCAPE))
    for s in range(1, LAST + 1):
        k = int(COUNTS[s])
        half = 1 << (k.bit_length() - 1)
        most = np.maximum(power[half][:n], power[half][k - half : k - half + n])
        fits = most <= WIDTHS[s]
        chosen[fits] = s
        if not fits.any():
            break
    return chosen


def pack(codes: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, escapes, first word and first escape of each block.

    Each word takes as many codes as fit.  All blocks advance together, a word at a time.
    """
    codes = np.ascontiguousarray(codes, np.uint64)
    n = len(codes)
    starts = np.arange(0, n, block)
    ends = np.minimum(starts + block, n)
    chosen = _choices(_widths(codes))
    room = np.searchsorted(COUNTS[: LAST + 1], np.arange(block + 1), "right").astype(np.int64) - 1  # by codes left
    begins = np.zeros(n, bool)
    at, end = starts, ends
    while len(at):
        own = chosen[at].astype(np.int64)
        own = np.where(own == ESCAPE, own, np.minimum(own, room[end - at]))
        begins[at] = True
        chosen[at] = own
        at = at + COUNTS[own]
        live = at < end
        at, end = at[live], end[live]
    place = np.flatnonzero(begins)
    selector = chosen[place].astype(np.int64)
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in range(LAST + 1):
        own = np.flatnonzero(selector == s)
        if not len(own):
            continue
        first, value = place[own], np.zeros(len(own), np.uint64)
        for j in range(int(COUNTS[s])):
            value |= codes[first + j] << np.uint64(j * int(WIDTHS[s]))
        words[own] |= value
    escaped = place[selector == ESCAPE]
    return words, codes[escaped], np.searchsorted(place, starts).astype(np.uint64), np.searchsorted(escaped, starts).astype(np.uint64)


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """All codes, one pass for each selector that occurs."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    first = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(first[-1], np.uint64)
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[first[own]] = escapes
            continue
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for j in range(int(COUNTS[s])):
            out[first[own] + j] = (words[own] >> np.uint64(j * int(WIDTHS[s]))) & mask
    return out


def encode_file(ids: np.ndarray, doc_ids: list, lengths: list[int]) -> list[bytes]:
    """The parts of a file that holds these documents' ids in a row."""
    if len(ids):
        top = int(ids.max())
        if top < 1 << 22:
            count = np.bincount(ids, minlength=top + 1)
            book = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
            code = np.zeros(top + 1, np.uint64)
            code[book] = np.arange(len(book), dtype=np.uint64)
            codes = code[ids]
        else:
            values, inverse, count = np.unique(ids, return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")
            code = np.empty(len(order), np.uint64)
            code[order] = np.arange(len(order), dtype=np.uint64)
            book, codes = values[order], code[inverse]
    else:
        book = codes = np.empty(0, np.uint64)
    words, escapes, first_word, first_escape = pack(codes)
    head = np.array([MAGIC, len(ids), len(first_word), len(words), len(escapes), len(doc_ids), len(book), BLOCK], "<u8")
    null = np.array([x is None for x in doc_ids], np.uint8)
    return [x.tobytes() for x in (head, book.astype("<u8"), first_word.astype("<u8"), first_escape.astype("<u8"), words.astype("<u8"), escapes.astype("<u8"), np.array([x or 0 for x in doc_ids], "<i8"), null, np.array(lengths, "<u8"))]


def _parts(data: bytes) -> dict[str, np.ndarray]:
    head = np.frombuffer(data, "<u8", 8)
    if head[0] != MAGIC:
        raise ValueError("not a Simple-8b token file")
    _, _, blocks, words, escapes, docs, book, _ = map(int, head)
    out, at = {"head": head}, 64
    for name, n, kind in (("book", book, "<u8"), ("block_word", blocks, "<u8"), ("block_esc", blocks, "<u8"), ("words", words, "<u8"), ("escapes", escapes, "<u8"), ("doc_ids", docs, "<i8"), ("null", docs, "u1"), ("lengths", docs, "<u8")):
        out[name] = np.frombuffer(data, kind, n, at)
        at += out[name].nbytes
    return out


def decode_file(data: bytes) -> tuple[np.ndarray, list, np.ndarray]:
    """Ids, doc_ids and lengths of a whole file."""
    x = _parts(data)
    ids = x["book"][unpack(x["words"], x["escapes"])] if len(x["words"]) else np.empty(0, np.uint64)
    return ids, [None if n else int(d) for d, n in zip(x["doc_ids"], x["null"], strict=True)], x["lengths"].astype(np.int64)


def decode_block(data: bytes, k: int) -> np.ndarray:
    """Ids of block k alone, found by the per-block offsets."""
    x = _parts(data)
    word, esc = [*x["block_word"], len(x["words"])], [*x["block_esc"], len(x["escapes"])]
    return x["book"][unpack(x["words"][int(word[k]) : int(word[k + 1])], x["escapes"][int(esc[k]) : int(esc[k + 1])])]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str, text_mb: float = 24, tasks: int | None = None) -> DataFrame:
    """Encode whole texts and write them to files in the order of doc_ids; a table (part, k, file, n_ids, n_docs) of the files.

    Files stand in the order of (part, k).  There are as many tasks as files of `text_mb` MB
    of text, but at most 64 a shuffle partition.
    """
    spark = docs.sparkSession
    n = tasks or min(text_groups(docs, text_mb), 64 * width(spark))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")

    @tidy
    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import encoder

        enc, end, part = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        ids, doc_ids, lengths, size, k = [], [], [], 0, 0

        def put():
            name = f"{path}/part-{part:06d}-{k:06d}.s8b"
            flat = np.frombuffer(b"".join(ids), "<u4")
            ids.clear()
            write_whole(name, encode_file(flat, doc_ids, lengths))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "k": pa.array([k], pa.int32()), "file": [name], "n_ids": pa.array([len(flat)], pa.int64()), "n_docs": pa.array([len(doc_ids)], pa.int64())})

        for b in batches:
            texts, own = b.column(1).to_pylist(), b.column(0).to_pylist()
            for at in range(0, len(texts), 512):
                few = texts[at : at + 512]
                for x in enc.encode(few):
                    ids += (x, end)
                    lengths.append(len(x) // 4 + 1)
                doc_ids += own[at : at + 512]
                size += sum(map(len, few))
                if size >= text_mb * 1e6:
                    yield put()
                    doc_ids, lengths, size, k = [], [], 0, k + 1
        if doc_ids:
            yield put()

    with small_batches(spark):
        return written(spark, rows.mapInArrow(write, "part int, k int, file string, n_ids long, n_docs long"), "files")[0]


def read_token_files(files: DataFrame) -> DataFrame:
    """Decode files: doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    # how many ids stand before a file: in earlier tasks, and in earlier files of its own task
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("block", F.floor(F.col("part") / 1024))
    blocks = parts.groupBy("block").agg(F.sum("n").alias("n"))
    before = lambda n, *by, order: F.coalesce(F.sum(n).over((W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("block", before("n", order="block").alias("far"))  # a row for 1024 tasks
    parts = parts.join(blocks, "block").select("part", (F.col("far") + before("n", "block", order="part")).alias("far"))
    listed = files.join(parts, "part").select("file", (F.col("far") + before("n_ids", "part", order="k")).alias("base"))

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, path = open_fs(name)
                with fs.open_input_file(path) as f:
                    ids, doc_ids, lengths = decode_file(f.read())
                data, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths)
                crcs = [zlib.crc32(memoryview(data)[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(base + ends - lengths, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    return listed.repartition(width(files.sparkSession), "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def simple8b_round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the documents' ids to files in the shared folder and return what is read back."""
    return read_token_files(write_token_files(docs, tokenizer, end_id, new_folder(spark, "simple8b")))
