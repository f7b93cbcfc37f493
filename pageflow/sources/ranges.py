"""Byte ranges of stored files: requests that share their fetches, and readers that take just the bytes asked for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.prefix import running, stretches
from .books import CHUNK, LEAST_CHUNK, RANGE_CAP
from .files import open_fs

#: Bytes of a file that a task looks after.
STRETCH = 1 << 26


def checked_ranges(requests: DataFrame) -> DataFrame:
    """Requests (id, request, start, end, size) with `valid`: whether [start, end) lies in a file of that size and is not empty."""
    good = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.col("size"))
    return requests.withColumn("valid", F.coalesce(good, F.lit(False)))


def joined_ranges(requests: DataFrame, span: int = STRETCH) -> DataFrame:
    """Requests (id, request, start, end) with `first`, where the union of ranges that theirs belongs to begins.

    Ranges that overlap or touch are one.  The largest end so far, and the newest beginning so far,
    run through a file in blocks, so a file may have any share of the requests.
    """
    block, order = stretches(F.col("start"), span), ["start", "end", "request"]
    reached = running(requests, ["id"], block, order, F.col("end"), "_reach", own=False)
    begins = F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach")), F.col("start"))
    return running(reached, ["id"], block, order, begins, "first").drop("_reach")


@dataclass(frozen=True)
class Shared:
    """What a set of requests that wait together needs.

    `fetches` (id, start, end) are the chunks to read, each once; `pieces` (id, request, chunk,
    start, end) say which bytes of which chunk (named by its start) a request gets, in order.
    """

    fetches: DataFrame
    pieces: DataFrame


def shared_chunks(requests: DataFrame, chunk: int = CHUNK, span: int = STRETCH) -> Shared:
    """Fetches for valid requests (id, request, start, end): chunks of the unions of their ranges."""
    step = max(LEAST_CHUNK, chunk)
    met = joined_ranges(requests.select("id", "request", "start", "end"), span)
    union = met.groupBy("id", "first").agg(F.max("end").alias("last"))
    each = lambda low, high: F.explode(F.sequence(F.floor(low / step), F.floor(high / step)))
    cut = union.withColumn("_i", each(F.lit(0), F.col("last") - 1 - F.col("first")))
    start = F.col("first") + F.col("_i") * step
    fetches = cut.select("id", start.alias("start"), F.least(F.col("last"), start + step).alias("end"))
    asked = met.withColumn("_i", each(F.col("start") - F.col("first"), F.col("end") - 1 - F.col("first")))
    pieces = asked.select("id", "request", start.alias("chunk"), F.greatest("start", start).alias("start"), F.least(F.col("end"), start + step).alias("end"))
    return Shared(fetches, pieces)


def read_ranges(ranges: DataFrame, cap: int = RANGE_CAP) -> DataFrame:
    """Ranges (file, start, end, ...) with `content`: just these bytes; null if a range is empty or beyond the cap.

    Tasks get stretches of files in order, so a file is opened about once a stretch.
    """
    dealt = ranges.repartition("file", F.floor(F.col("start") / STRETCH)).sortWithinPartitions("file", "start")
    at = [ranges.columns.index(c) for c in ("file", "start", "end")]

    def read(batches):
        import pyarrow as pa

        name, file = None, None
        for b in batches:
            held, size, first = [], 0, 0
            for k, (uri, start, end) in enumerate(zip(*(b.column(i).to_pylist() for i in at), strict=True)):
                if uri != name:
                    if file is not None:
                        file.close()
                    fs, path = open_fs(uri)
                    name, file = uri, fs.open_input_file(path)
                fits = 0 < end - start <= cap
                held.append(file.read_at(end - start, start) if fits else None)
                size += len(held[-1] or b"")
                if size >= 4 * cap:
                    yield pa.RecordBatch.from_arrays([*b.slice(first, len(held)).columns, pa.array(held, pa.binary())], names=[*b.schema.names, "content"])
                    held, size, first = [], 0, k + 1
            yield pa.RecordBatch.from_arrays([*b.slice(first, len(held)).columns, pa.array(held, pa.binary())], names=[*b.schema.names, "content"])
        if file is not None:
            file.close()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranges.schema) + ", content binary"
    return dealt.mapInArrow(read, schema)


@dataclass
class Stretch(InputPartition):
    """A stretch of a file."""

    path: str
    start: int
    end: int


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.chunk, self.split = options["path"], int(options.get("chunk", CHUNK)), int(options.get("split", STRETCH))

    def partitions(self):
        from pyarrow.fs import FileSelector, FileType

        fs, root = open_fs(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(root, recursive=True))
        step = max(1, self.split // self.chunk) * self.chunk  # a stretch holds whole chunks
        return [Stretch(f.path, at, min(f.size, at + step)) for f in sorted(files, key=lambda f: f.path) if f.type == FileType.File for at in range(0, f.size, step)]

    def read(self, partition):
        import pyarrow as pa

        fs, _ = open_fs(self.path)
        with fs.open_input_file(partition.path) as file:
            for at in range(partition.start, partition.end, self.chunk):
                content = file.read_at(min(self.chunk, partition.end - at), at)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([at // self.chunk]), pa.array([at]), pa.array([content], pa.binary())], names=["path", "i", "start", "content"])


class BookChunks(DataSource):
    """Files as rows of one chunk each: `spark.read.format("book_chunks").load(path)`.

    Options: `chunk`, bytes of a row (1 MiB), and `split`, bytes of a task (64 MiB).  A task reads
    one chunk after another, so no file is ever held whole.
    """

    @classmethod
    def name(cls):
        return "book_chunks"

    def schema(self):
        return "path string, i long, start long, content binary"

    def reader(self, schema):
        return ChunkReader(self.options)


def read_chunks(spark: SparkSession, path: str, chunk: int = CHUNK, split: int = STRETCH) -> DataFrame:
    """(path, i, start, content): the files under a path in chunks."""
    spark.dataSource.register(BookChunks)
    return spark.read.format("book_chunks").option("chunk", chunk).option("split", split).load(path)
