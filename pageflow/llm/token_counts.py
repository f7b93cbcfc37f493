"""Separator scan of flat token files (operator 2).

A flat token file is nothing but ids of a fixed width, with an end-of-document id after
each document and no index.  It is cut into blocks of fixed size wherever they fall.
Each block is searched on its own, in one vectorised comparison; what a document has in
earlier blocks comes from a prefix scan over the blocks' lengths and last separators,
which are a few numbers a block.

Behaviour: ids after the last separator of a file form an unfinished document, returned
with `ended` false; an empty file or table gives no rows; two separators in a row give a
document of one token, the separator itself.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_path, new_folder, shuffles_freed, text_groups, utf8, width, written
from .files import open_fs, read_range, write_whole

DTYPES = {2: "<u2", 4: "<u4", 8: "<u8"}


def flat_file_blocks(spark: SparkSession, path: str, id_bytes: int, block_mb: float = 16) -> DataFrame:
    """Blocks (file, block, payload) of the real flat files under a path; only lengths are listed first."""
    step = int(block_mb * 1e6) // id_bytes * id_bytes
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "length")
    odd = F.when(F.col("length") % id_bytes != 0, F.raise_error(F.concat(F.lit("length is no multiple of the id width: "), "file"))).otherwise(F.col("length"))
    cuts = found.select("file", odd.alias("length")).filter("length > 0")
    cuts = cuts.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step))).alias("block")).repartition(F.col("file"), F.col("block"))

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for f, n, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield pa.RecordBatch.from_pydict({"file": [f], "block": pa.array([k], pa.int64()), "payload": pa.array([read_range(f, k * step, min(step, n - k * step))], pa.binary())})

    return cuts.mapInArrow(read, "file string, block long, payload binary")


def separator_scan(blocks: DataFrame, end_id: int, id_bytes: int) -> DataFrame:
    """One row a document: file, ordinal in the file, start, n_tokens (with the end id), ended.

    The blocks' payloads are read once; from there on a block is its length and the
    places of its separators.
    """
    kind = DTYPES[id_bytes]

    def search(batches):
        import pyarrow as pa

        for b in batches:
            sizes, places = [], []
            for x in b.column(2):
                ids = np.frombuffer(x.as_buffer() or b"", kind)
                sizes.append(len(ids))
                places.append(np.flatnonzero(ids == end_id))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(pa.int64()))], names=["file", "block", "size", "places"])

    found = blocks.select("file", F.col("block").cast("long"), "payload").mapInArrow(search, "file string, block long, size long, places array<long>")
    return stitch(written(blocks.sparkSession, found, "separators")[0])


def stitch(found: DataFrame) -> DataFrame:
    """Join the pieces of documents across blocks (file, block, size, places).

    The prefix scan sees one short row a block; the places stay dealt by block and meet
    their block's base again by an equi-join.
    """
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    some = F.size("places") > 0
    scan = found.select("file", "block", "size", F.size("places").alias("n"), F.when(some, F.element_at("places", -1)).alias("last"))
    scan = scan.withColumn("base", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    scan = scan.withColumn("open", F.coalesce(F.max(F.col("base") + F.col("last") + 1).over(earlier), F.lit(0)))
    scan = scan.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    scan = scan.withColumn("total", F.sum("size").over(W.partitionBy("file")))
    tail = F.coalesce(F.col("base") + F.col("last") + 1, F.col("open"))
    placed = found.filter(some).select("file", "block", "places").join(scan.select("file", "block", "base", "open", "before"), ["file", "block"])
    docs = placed.select("file", "base", "open", "before", "places", F.posexplode("places").alias("i", "at")).select(
        "file",
        (F.col("before") + F.col("i")).alias("ordinal"),
        F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("base") + F.get("places", F.col("i") - 1) + 1).alias("start"),
        (F.col("base") + F.col("at") + 1).alias("end"),
        F.lit(True).alias("ended"),
    )
    # only a file's last block can hold its unfinished document
    rest = scan.filter((F.col("size") > 0) & (F.col("base") + F.col("size") == F.col("total")) & (tail < F.col("total")))
    rest = rest.select("file", (F.col("before") + F.col("n")).alias("ordinal"), tail.alias("start"), F.col("total").alias("end"), F.lit(False).alias("ended"))
    return docs.unionByName(rest).select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "ended")


# --------------------------------------------- flat files made from a documents table


def file_of(doc_id, files: int):
    """The number of the flat file that a document goes to."""
    return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(files)).cast("int")


def write_flat_files(docs: DataFrame, path: str, files: int, end_id: int = 1, offset: int = 3, only=None) -> None:
    """16-bit byte-level ids (byte + offset) of whole texts, with an end id after each, in flat files under `path`.

    A file holds the documents of one hash range in the order of their doc_ids, and nothing
    else.  It is written as a stream.
    """
    rows = docs.select(file_of(F.col("doc_id"), files).alias("f"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if only is not None:
        rows = rows.filter(only(F.col("f")))
    rows = rows.repartition(width(docs.sparkSession), "f").sortWithinPartitions("f", "doc_id", "text")

    def lay(batches):
        import pyarrow as pa

        end = np.array([end_id], "<u2").tobytes()

        def own(b):
            for f, text in zip(b.column(0).to_pylist(), utf8(b.column(2)), strict=True):
                yield f, (np.frombuffer(text, np.uint8).astype("<u2") + np.uint16(offset)).tobytes() + end

        done = []
        for f, parts in groupby((x for b in batches for x in own(b)), key=lambda x: x[0]):
            done.append((f, write_whole(f"{path}/{file_name(f)}", (x for _, x in parts))))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.int64()) for i in range(2)], names=["f", "size"])

    with shuffles_freed(docs.sparkSession):
        rows.mapInArrow(lay, "f long, size long").write.format("noop").mode("overwrite").save()


def file_name(f: int) -> str:
    return f"flat-{f:07d}.bin"


def count_documents(docs: DataFrame, rounds: int = 4, file_mb: float = 32, block_mb: float = 16) -> DataFrame:
    """doc_id, n_tokens (byte-level ids and the end id) of each row, by the scan of real flat files.

    The files take about twice the texts' bytes, so they are written and scanned in
    `rounds`, each with its share of the files, which then go.  Nothing tells the scan which
    document is which: a document is named by its place among those of its file, in the
    order of doc_ids.

    Behaviour: null and empty texts count their end id; a null doc_id is one like others;
    rows that repeat a doc_id are counted each; further columns are not read; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    files = max(rounds, text_groups(docs, file_mb / 2))
    found: DataFrame | None = None
    for r in range(rounds):
        path = new_folder(spark, "flat")
        write_flat_files(docs, path, files, only=lambda f, r=r: f % rounds == r)
        if not any_files(path):
            continue
        scanned, _ = written(spark, separator_scan(flat_file_blocks(spark, path, 2, block_mb), 1, 2), "counted")
        drop_path(spark, path)
        found = scanned if found is None else found.unionByName(scanned)
    if found is None:
        return spark.createDataFrame([], "doc_id long, n_tokens long")
    number = F.regexp_extract("file", r"flat-(\d+)\.bin$", 1).cast("int")
    place = F.row_number().over(W.partitionBy("f").orderBy("doc_id")) - 1
    named = docs.select(file_of(F.col("doc_id"), files).alias("f"), F.col("doc_id").cast("long").alias("doc_id")).withColumn("ordinal", place.cast("long"))
    return found.select(number.alias("f"), F.col("ordinal").cast("long"), "n_tokens").join(named, ["f", "ordinal"]).select("doc_id", "n_tokens")


def any_files(path: str) -> bool:
    from pyarrow.fs import FileSelector

    fs, own = open_fs(path)
    return any(x.is_file for x in fs.get_file_info(FileSelector(own, allow_not_found=True)))
