"""Files of the shared folder, opened on executors by their URI."""

from __future__ import annotations

import uuid
from collections.abc import Iterable


def open_fs(uri: str):
    """The pyarrow file system of a URI or plain path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


class Appended:
    """A file that is written part by part under another name and appears by a move, whole or not at all."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out, self.size = self.fs.open_output_stream(self.temporary), 0

    def append(self, part: bytes) -> None:
        self.out.write(part)
        self.size += len(part)

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.path)

    def abandon(self) -> None:
        self.out.close()
        self.fs.delete_file(self.temporary)


def write_whole(uri: str, parts: Iterable[bytes]) -> int:
    """A file of these parts; its size."""
    file = Appended(uri)
    try:
        for x in parts:
            file.append(x)
    except BaseException:
        file.abandon()
        raise
    file.commit()
    return file.size
