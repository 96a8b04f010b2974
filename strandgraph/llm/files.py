"""Files of any format in the shared folder, from inside tasks.

A task's file gets a name of its own, so that a second attempt never changes what a first one wrote; only the
index rows that Spark keeps say which files count.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


#: Spark's names of object stores, and Arrow's for the same store.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder's address: file, hdfs, s3 (s3a, s3n), gs or abfss. Others are an error."""
    scheme, _, rest = folder.partition(":")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


class Appender:
    """Writes one file after another below a folder, each up to about `limit` bytes."""

    def __init__(self, folder: str, suffix: str, limit: int):
        self.fs, self.base = opened(folder)
        self.suffix, self.limit = suffix, limit
        self.name, self.stream, self.at = "", None, 0

    def room(self) -> bool:
        """Makes sure that a file is open; true if it is a new one."""
        if self.stream is not None and self.at < self.limit:
            return False
        self.close()
        self.fs.create_dir(self.base, recursive=True)
        self.name, self.at = f"{uuid.uuid4().hex}{self.suffix}", 0
        self.stream = self.fs.open_output_stream(f"{self.base}/{self.name}", compression=None)
        return True

    def write(self, data: bytes) -> tuple[str, int, int]:
        """The file, offset and length of what it wrote."""
        place = self.name, self.at, len(data)
        self.stream.write(data)
        self.at += len(data)
        return place

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


class Reader:
    """Byte ranges of the files below a folder."""

    def __init__(self, folder: str):
        self.fs, self.base = opened(folder)
        self.name, self.file = "", None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.base}/{name}")
        self.file.seek(offset)
        return self.file.read(length)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None
        self.name = ""
