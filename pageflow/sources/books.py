"""Book bytes: fingerprints, upload parts, byte ranges, and readers of stored files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Sizes in bytes of what is sampled, uploaded and served at once.
SAMPLE, PART, RANGE_CAP, CHUNK, LEAST_CHUNK = 65536, 8388608, 2097152, 1048576, 65536
ATTEMPTS, BACKOFF_MS = 5, 75
OBJECT_KEY, UPLOAD_ID = r"\Abooks/[a-z0-9-]+\.pdf\z", r"\A[0-9a-f-]{36}\z"
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, content) of stored files; the content is read only if a plan uses it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), "content")


def fingerprint_input(content: Column, sample: int = SAMPLE) -> Column:
    """The bytes a fingerprint covers: the size in decimal, the first and the last sample; short files count twice."""
    n = F.octet_length(content)
    tail = F.substring(content, F.greatest(F.lit(1), n - sample + 1), F.lit(sample))
    return F.concat(n.cast("string").cast("binary"), F.substring(content, 1, sample), tail)


def fingerprint(content: Column, sample: int = SAMPLE) -> Column:
    return F.sha2(fingerprint_input(content, sample), 256)


#: So many rows at least go byte by byte together; a few long ones go by themselves.
TOGETHER = 64


#: Bytes that are joined to go together, unless TOGETHER rows hold more.
HELD = 1 << 24


def fnv1a(rows: list[bytes]) -> list[int]:
    """The 64-bit FNV-1a hash of each row.  Rows of like length advance together; a bounded part of them is joined at a time."""
    out, part, held = [0] * len(rows), [], 0
    for i in sorted(range(len(rows)), key=lambda i: -len(rows[i])):
        if len(part) >= TOGETHER and held + len(rows[i]) > HELD:
            _advance(rows, part, out)
            part, held = [], 0
        part.append(i)
        held += len(rows[i])
    _advance(rows, part, out)
    return out


def _advance(rows: list[bytes], order: list[int], out: list[int]) -> None:
    """Put the hashes of some rows, longest first, into `out`: one byte a step, as long as many are left."""
    sizes = np.array([len(rows[i]) for i in order], np.int64)
    flat = np.frombuffer(b"".join(rows[i] for i in order), np.uint8)
    start = np.cumsum(sizes) - sizes
    h, prime = np.full(len(order), FNV_OFFSET, np.uint64), np.uint64(FNV_PRIME)
    at, live = 0, int(np.searchsorted(-sizes, 0, "left"))
    while live >= TOGETHER:
        h[:live] = (h[:live] ^ flat[start[:live] + at]) * prime
        at += 1
        live = int(np.searchsorted(-sizes, -at, "left"))
    for k, i in enumerate(order):
        x = int(h[k])
        if k < live:
            for b in rows[i][at:]:
                x = (x ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
        out[i] = x


@F.pandas_udf(StringType())
def _fnv1a(data: pd.Series) -> pd.Series:
    known = data[data.notna()]
    return pd.Series([f"fnv1a-{h:016x}" for h in fnv1a(known.tolist())], index=known.index, dtype=object).reindex(data.index, fill_value=None)


def fingerprint_fnv1a(content: Column, sample: int = SAMPLE) -> Column:
    """The 64-bit fallback; Spark has no unsigned multiplication, so it runs on Arrow batches."""
    return _fnv1a(fingerprint_input(content, sample))


def part_plan(files: DataFrame, part: int = PART) -> DataFrame:
    """(id, part_number, start, length) of the parts that a file of `size` bytes is sent in."""
    n = F.ceil(F.col("size") / part)
    rows = files.filter("size > 0").select("id", "size", F.explode(F.sequence(F.lit(1).cast("long"), n.cast("long"))).alias("part_number"))
    start = (F.col("part_number") - 1) * part
    return rows.select("id", "part_number", start.alias("start"), F.least(F.lit(part), F.col("size") - start).alias("length"))


def cut_parts(files: DataFrame, part: int = PART) -> DataFrame:
    """(id, part_number, content, etag) of each file's parts."""
    n = F.ceil(F.octet_length("content") / part).cast("long")
    rows = files.filter(F.octet_length("content") > 0).select("id", "content", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("part_number"))
    piece = F.substring("content", ((F.col("part_number") - 1) * part + 1).cast("int"), F.lit(part))
    return rows.select("id", "part_number", piece.alias("content")).withColumn("etag", F.sha2("content", 256))


def checked_parts(parts: DataFrame, order: str = "arrival") -> DataFrame:
    """Add `etag`, and `rejected`: why a part is refused, or null.

    Takes upload_id, object_key, part_number, content and the order of arrival.  A part that
    an upload has already is refused; the first one that is good by itself counts.
    """
    size = F.octet_length("content")
    reason = (
        F.when(~F.coalesce(F.col("object_key").rlike(OBJECT_KEY), F.lit(False)), "key")
        .when(F.coalesce(F.col("part_number") < 1, F.lit(True)), "number")
        .when(~F.coalesce(F.col("upload_id").rlike(UPLOAD_ID), F.lit(False)), "upload")
        .when(F.coalesce((size < 1) | (size > PART), F.lit(True)), "size")
    )
    rows = parts.withColumn("rejected", reason)
    first = rows.filter("rejected IS NULL").groupBy("upload_id", "part_number").agg(F.min(order).alias("_first"))
    rows = rows.join(first, ["upload_id", "part_number"], "left")
    again = F.when(F.col("rejected").isNull() & (F.col(order) > F.col("_first")), "exists")
    return rows.withColumn("rejected", F.coalesce("rejected", again)).withColumn("etag", F.when(F.col("rejected").isNull(), F.sha2("content", 256))).drop("_first")


def check_assembly(parts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, bytes, accepted, reason): parts must be numbered 1..n with an etag and add up to the size.

    Sums over the parts' numbers and lengths; no bytes are brought together.
    """
    n, low, high, kinds = F.count(F.lit(1)), F.min("part_number"), F.max("part_number"), F.count_distinct("part_number")
    tagged = F.min(F.coalesce(F.length("etag") > 0, F.lit(False)))
    rows = parts.groupBy("id").agg(((low == 1) & (high == n) & (kinds == n)).alias("_numbered"), tagged.alias("_tagged"), F.sum(F.octet_length("content").cast("long")).alias("bytes")).join(sizes, "id", "left")
    reason = F.when(~F.coalesce("_numbered", F.lit(False)), "numbers").when(~F.col("_tagged"), "etag").when(F.col("size").isNull() | (F.col("bytes") != F.col("size")), "size")
    return rows.select("id", "bytes", reason.isNull().alias("accepted"), reason.alias("reason"))


def digests(parts: DataFrame, key: str = "id", order: str = "part_number") -> DataFrame:
    """(key, bytes, digest): the SHA-256 of each file's parts in order; a task holds one part at a time."""
    kind = parts.schema[key].dataType.simpleString()
    rows = parts.select(key, "content", F.col(order).alias("_order")).repartition(key).sortWithinPartitions(key, "_order")

    def fold(batches):
        import hashlib

        import pyarrow as pa

        now, size, digest = (), 0, None
        for b in batches:
            out = []
            for name, content in zip(b.column(0), b.column(1), strict=True):
                if (name.as_py(),) != now:
                    if now:
                        out.append((*now, size, digest.hexdigest()))
                    now, size, digest = (name.as_py(),), 0, hashlib.sha256()
                own = content.as_py() or b""
                size += len(own)
                digest.update(own)
            yield table(pa, out, b.schema.field(0).type)
        if now:
            yield table(pa, [(*now, size, digest.hexdigest())], b.schema.field(0).type)

    def table(pa, out, of):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((of, pa.int64(), pa.string()))], names=[key, "bytes", "digest"])

    return rows.mapInArrow(fold, f"{key} {kind}, bytes long, digest string")


def byte_range(header: Column, size: Column) -> Column:
    """struct(offset, length) of a single-range header, or null if there is none or it starts past the end.

    An open end goes to the last byte, `bytes=-N` takes the last N, `bytes=-` takes all.
    """
    pattern = r"\Abytes=([0-9]*)-([0-9]*)\z"
    a, b = F.regexp_extract(header, pattern, 1), F.regexp_extract(header, pattern, 2)
    first, second = F.coalesce(a.try_cast("decimal(38,0)"), F.lit(0)), b.try_cast("decimal(38,0)")
    suffix = F.least(size, second)
    end = F.least(size - 1, F.coalesce(second, size - 1))
    span = F.greatest(F.lit(0), end - first + 1)
    both = lambda o, n: F.struct(o.cast("long").alias("offset"), n.cast("long").alias("length"))
    return (
        F.when(~F.coalesce(header.rlike(pattern), F.lit(False)), F.lit(None))
        .when((a == "") & (b != ""), F.when(suffix > 0, both(size - suffix, suffix)))
        .when(first < size, both(first, span))
    )


def range_status(wanted: Column, cap: int = RANGE_CAP) -> Column:
    """400 without a usable range, 416 for an empty or too long one, else 206."""
    return F.when(wanted.isNull(), 400).when((wanted["length"] < 1) | (wanted["length"] > cap), 416).otherwise(206)


def read_range(content: Column, wanted: Column) -> Column:
    return F.substring(content, (wanted["offset"] + 1).cast("int"), wanted["length"].cast("int"))


def chunk_plan(requests: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(id, i, start, end) of the chunks that cover the bytes [start, end) of each request, in order."""
    step = max(LEAST_CHUNK, chunk)
    n = F.ceil((F.col("end") - F.col("start")) / step).cast("long")
    rows = requests.filter(F.col("end") > F.col("start")).select("id", "start", "end", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    first = F.col("start") + F.col("i") * step
    return rows.select("id", "i", first.alias("start"), F.least(F.col("end"), first + step).alias("end"))


def retry_delay(attempt: Column) -> Column:
    """Milliseconds before the attempt after this one (from 0)."""
    return (F.lit(BACKOFF_MS) * F.pow(F.lit(2), attempt)).cast("long")


def content_range_ok(header: Column, start: Column, end: Column, size: Column) -> Column:
    """Whether a Content-Range header confirms the bytes [start, end) of a file of this size."""
    want = F.concat(F.lit("bytes "), start.cast("string"), F.lit("-"), (end - 1).cast("string"), F.lit("/"), size.cast("string"))
    return F.coalesce(header == want, F.lit(False))


def new_uploads(incoming: DataFrame, books: DataFrame) -> DataFrame:
    """Uploads whose file is not stored yet with that size."""
    return incoming.join(books.select("fingerprint", "size").distinct(), ["fingerprint", "size"], "left_anti")


def known_uploads(incoming: DataFrame, books: DataFrame) -> DataFrame:
    return incoming.join(books.select("fingerprint", "size").distinct(), ["fingerprint", "size"], "left_semi")
