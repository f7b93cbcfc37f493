"""Files of the shared folder, opened from Python workers by their URI.

Writers put a file under another name first and move it when it is whole, so a task
that runs twice or dies half-way leaves no torn file.
"""

from __future__ import annotations

import uuid


def open_fs(uri: str):
    """The pyarrow file system of a URI or plain path, and the path in it."""
    from pyarrow import fs

    if "://" not in uri:
        uri = f"file://{uri.removeprefix('file:')}"
    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, parts) -> int:
    """Write an iterable of byte strings to a file that appears only when it is complete; its size."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    size = 0
    with fs.open_output_stream(own) as out:
        for x in parts:
            out.write(x)
            size += len(x)
    fs.move(own, path)
    return size


def read_range(uri: str, start: int, size: int) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        f.seek(start)
        return f.read(size)
