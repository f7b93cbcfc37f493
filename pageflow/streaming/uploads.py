"""Upload sessions as a stream of parts: a book appears once all its parts are there, and is registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import upsert_latest, valid_fingerprint
from ..sources.books import checked_parts
from ..sources.files import Appended

#: What each part says about its book.
BOOK = ("fingerprint", "name", "size", "page_count", "content_type", "parts")
SESSION = ("upload_id", "object_key", *BOOK)


def _there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _epochs(spark: SparkSession, root: str, kind: str, below: int | None = None) -> DataFrame | None:
    """What earlier micro-batches have written, or None."""
    if not _there(spark, f"{root}/{kind}"):
        return None
    rows = spark.read.parquet(f"{root}/{kind}")
    return rows if below is None else rows.filter(F.col("epoch") < below)


def complete_sessions(parts: DataFrame) -> DataFrame:
    """Sessions whose parts are numbered 1..n, add up to the size, and go to the place their fingerprint names."""
    said = [F.min(c).alias(c) for c in SESSION[1:]]
    same = [(F.min(c).eqNullSafe(F.max(c))).alias(f"_same_{c}") for c in SESSION[1:]]
    seen = parts.groupBy("upload_id").agg(*said, *same, F.count_distinct("part_number").alias("_n"), F.min("part_number").alias("_low"), F.max("part_number").alias("_high"), F.sum("length").alias("_bytes"))
    whole = (F.col("_n") == F.col("parts")) & (F.col("_low") == 1) & (F.col("_high") == F.col("parts")) & (F.col("_bytes") == F.col("size"))
    placed = valid_fingerprint(F.col("fingerprint")) & (F.col("object_key") == F.concat(F.lit("books/"), F.col("fingerprint"), F.lit(".pdf")))
    agreed = [F.col(f"_same_{c}") for c in SESSION[1:]]
    good = whole & placed & (F.length("name") > 0) & (F.col("page_count") > 0)
    for c in agreed:
        good = good & c
    return seen.filter(good).select(*SESSION)


def assemble_files(parts: DataFrame, sessions: DataFrame, root: str) -> DataFrame:
    """Write the sessions' books under `root`, part after part, and tell (upload_id, written, sha256) of each.

    A task holds one part at a time.  A file appears by a move once it is whole, and a task that
    runs again moves the same bytes to the same place.
    """
    rows = parts.select("upload_id", "part_number", "content").join(sessions.select("upload_id", "object_key"), "upload_id")
    rows = rows.repartition("upload_id").sortWithinPartitions("upload_id", "part_number")

    def write(batches):
        import hashlib

        import pyarrow as pa

        now, file, digest = None, None, None

        def done():
            file.commit()
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([file.size]), pa.array([digest.hexdigest()])], names=["upload_id", "written", "sha256"])

        try:
            for b in batches:
                for k in range(b.num_rows):
                    upload, content, key = (b.column(n)[k].as_py() for n in ("upload_id", "content", "object_key"))
                    if upload != now:
                        if now is not None:
                            yield done()
                        now, file, digest = upload, Appended(f"{root}/{key}"), hashlib.sha256()
                    file.append(content)
                    digest.update(content)
        except BaseException:
            if file is not None:
                file.abandon()
            raise
        if now is not None:
            yield done()

    return rows.mapInArrow(write, "upload_id string, written long, sha256 string")


def stream_uploads(source: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Take in parts (SESSION's columns, part_number, content, arrival), all that are there now, then stop.

    Each micro-batch refuses parts that are wrong or known, stores the others under `root`/parts,
    and assembles and registers the books of the sessions it has touched that are complete.  Parts
    may come in any order, twice, and over any number of micro-batches; what a micro-batch writes
    is named by its number, so one that is delivered again writes the same.
    """
    spark = source.sparkSession

    def take(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        good = checked_parts(batch).filter("rejected IS NULL")
        known = _epochs(spark, root, "parts", epoch)
        if known is not None:
            good = good.join(known.select("upload_id", "part_number").distinct(), ["upload_id", "part_number"], "left_anti")
        stored = good.select(*SESSION, "part_number", "content", F.octet_length("content").cast("long").alias("length"), "etag", "arrival")
        stored.write.mode("overwrite").parquet(f"{root}/parts/epoch={epoch}")
        touched = batch.select("upload_id").distinct()
        all_parts = spark.read.parquet(f"{root}/parts").filter(F.col("epoch") <= epoch).join(touched, "upload_id", "left_semi")
        ready = complete_sessions(all_parts.drop("content"))
        before = _epochs(spark, root, "books_done", epoch)
        if before is not None:
            ready = ready.join(before.select("upload_id"), "upload_id", "left_anti")
        done = assemble_files(all_parts, ready, root)
        arrived = all_parts.groupBy("upload_id").agg(F.max("arrival").alias("uploaded_at"))
        done.join(ready, "upload_id").join(arrived, "upload_id").write.mode("overwrite").parquet(f"{root}/books_done/epoch={epoch}")
        batch.unpersist()

    return source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def library_of(spark: SparkSession, root: str) -> DataFrame:
    """The registered books: one for each fingerprint, with its first id and what the last upload said."""
    rows = spark.read.parquet(f"{root}/books_done")
    rows = rows.select(F.col("upload_id").alias("id"), "fingerprint", "name", "object_key", "size", "page_count", "content_type", "uploaded_at", "sha256")
    return upsert_latest(rows, ["fingerprint"], "uploaded_at", fixed=("id",))
