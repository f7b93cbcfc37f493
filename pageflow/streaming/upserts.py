"""Upserts and task events as streams: state is a table that each micro-batch folds into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import upsert_versioned


BUCKET = "_bucket"


def state_path(root: str, version: int) -> str:
    return f"{root}/state-{version:012d}"


def _file_system(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """The complete versions of a state folder, in order."""
    path, fs = _file_system(spark, root)
    if not fs.exists(path(root)):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path(root))]
    found = [n for n in names if n.startswith("state-") and fs.exists(path(f"{root}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("state-")) for n in found)


def committed(spark: SparkSession, root: str) -> int:
    """The newest complete version of a state folder, or -1."""
    return max(versions(spark, root), default=-1)


def bucket_paths(spark: SparkSession, root: str, below: int | None = None) -> dict[int, list[str]]:
    """Of each bucket, the folders of all its versions (under `below`), the newest first."""
    path, fs = _file_system(spark, root)
    out: dict[int, list[str]] = {}
    for v in reversed(versions(spark, root)):
        if below is None or v < below:
            for f in fs.listStatus(path(state_path(root, v))):
                name = f.getPath().getName()
                if name.startswith(f"{BUCKET}="):
                    out.setdefault(int(name.partition("=")[2]), []).append(f"{state_path(root, v)}/{name}")
    return out


def stream_upsert(source: DataFrame, root: str, checkpoint: str, buckets: int = 16, **how) -> StreamingQuery:
    """Fold a stream of upserts into versioned state folders under `root`, all that is there now, then stop.

    The state lies in buckets of keys.  Each micro-batch reads the newest version of the
    buckets it touches, and writes these alone as its own version, named by the batch, so a
    batch that is delivered again gives the same folder.  A bucket's two newest versions
    stay, older ones go.  Late rows with a newer version apply; late older ones do not.
    """
    spark, key = source.sparkSession, how.get("key", "cache_key")
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def fold(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most `buckets` numbers
        before = bucket_paths(spark, root, epoch)
        paths = [before[b][0] for b in touched if b in before]
        rows = spark.read.parquet(*paths).unionByName(batch, allowMissingColumns=True) if paths else batch
        out = upsert_versioned(rows, **how).withColumn(BUCKET, bucket)
        out.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(state_path(root, epoch))
        batch.unpersist()
        path, fs = _file_system(spark, root)
        for own in bucket_paths(spark, root).values():
            for old in own[2:]:
                fs.delete(path(old), True)

    return source.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(spark: SparkSession, root: str) -> DataFrame:
    """The newest version of every bucket."""
    return spark.read.parquet(*(own[0] for own in bucket_paths(spark, root).values()))


def task_tokens(events: DataFrame) -> DataFrame:
    """Outcome of start / finish / cancel events of keyed tasks, in the order of `seq`.

    A start is refused while its key's task runs, unless it replaces; a finish counts only
    with the running task's token; a cancel frees the key.  One pass over the events, sorted
    by key and `seq`, that holds the running token alone.
    """
    kind = events.schema["key"].dataType.simpleString()
    rows = events.select("key", F.col("seq").cast("long").alias("seq"), "kind", "token", F.coalesce("replace", F.lit(False)).alias("replace"))
    rows = rows.repartition("key").sortWithinPartitions("key", "seq")

    def fold(batches):
        import pyarrow as pa

        last, running = (), None
        for b in batches:
            accepted = []
            for key, event, token, replace in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if (key,) != last:
                    last, running = (key,), None
                if event == "start":
                    good = running is None or replace
                    running = token if good else running
                else:
                    good = running is not None and (event != "finish" or running == token)
                    running = None if good else running
                accepted.append(good)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(accepted, pa.bool_())], names=["key", "seq", "accepted"])

    return rows.mapInArrow(fold, f"key {kind}, seq long, accepted boolean")


def without_repeats(stream: DataFrame, event_time: str, delay: str, key: list[str]) -> DataFrame:
    """Drop re-deliveries of the same content within the watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)
