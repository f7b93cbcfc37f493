"""Texts in portions: what a portion holds goes out by key, and answers come back to it.

A portion is some consecutive rows of one task of a scan, with about `mb` MB of text.  Its
rows are kept in one file of the shared folder, named by the task's partition and the
portion's place in it, so the text itself is never shuffled and meets its answers again by
name.  A task that runs twice writes the same file again.  The scan should read a table: its
partitions then hold the same rows in every attempt.

Keys are 64-bit hashes.  They are dealt to a fixed number of buckets by their upper bits, so a
portion sends one sorted segment a bucket at most, and a bucket's answers lie in the order of
the segment they answer.  The number of buckets follows the session's shuffle partitions, not
the table: the rows sent grow with the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession

from .common import width
from .files import open_fs, write_whole


def bucket_count(spark: SparkSession) -> int:
    """Four buckets a shuffle partition, so that they spread evenly."""
    return 4 * width(spark)


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of sorted keys begins, and the end."""
    own = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(own, np.arange(buckets + 1, dtype=np.uint64))


def portions(batches, at: int, most: float) -> Iterator:
    """Tables of consecutive rows with about `most` bytes in column `at`; a longer text ends its portion."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size, most = [], 0, min(most, 16 << ROW_BITS)
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(at)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        start = 0
        while start < b.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = min(b.num_rows, int(np.searchsorted(ends, base + most - size)) + 1)
            held.append(b.slice(start, stop - start))
            size += int(ends[stop - 1]) - base
            start = stop
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


#: Bits for the portions of a task, and for the rows of a portion (which count 16 bytes each at least).
TASK_BITS = ROW_BITS = 20


def portion_id(k: int) -> int:
    """The id of a task's k-th portion."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << TASK_BITS | k


def row_ids(g: int, first: int, n: int) -> np.ndarray:
    """Ids of a portion's rows from `first` on; no other row of the table has them."""
    return np.arange(first, first + n) + (g << ROW_BITS)


def _file(root: str, g: int) -> str:
    return f"{root}/portion-{g >> TASK_BITS:07d}-{g & (1 << TASK_BITS) - 1:06d}.arrow"


def keep_portion(root: str, g: int, rows) -> None:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for b in rows.to_batches(max_chunksize=1024):
            out.write_batch(b)
    write_whole(_file(root, g), [sink.getvalue()])


def read_portion(root: str, g: int):
    import pyarrow as pa

    fs, path = open_fs(_file(root, g))
    with fs.open_input_file(path) as f:
        return pa.ipc.open_stream(f.read_buffer()).read_all()
