"""Files that tasks read in parts, and files whose parts lie at places known beforehand."""

from __future__ import annotations

import os

import pyarrow.fs


class Bytes:
    """Random reads of a file at a path or at a URL that Arrow knows (file, hdfs, s3, gs)."""

    def __init__(self, path: str) -> None:
        store, inside = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
        self.file = store.open_input_file(inside)
        self.size = self.file.size()

    def at(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise ValueError(f"the file ends before byte {offset + length}")
        self.file.seek(offset)
        return self.file.read(length)

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> Bytes:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def mounted(path: str) -> str:
    """A path that the driver and all executors have mounted; stores without places in a file are refused."""
    path = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if "://" in path:
        raise ValueError("a file that tasks write in parts needs a mounted folder")
    return path


class Draft:
    """A file of known length that many tasks fill, each its own places, shown under its name when all are done.

    Tasks may be repeated: they write the same bytes to the same places.
    """

    def __init__(self, path: str) -> None:
        self.path = mounted(path)
        self.draft = self.path + ".draft"

    def begin(self, head: bytes, length: int) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        with open(self.draft, "wb") as f:
            f.write(head)
            f.truncate(length)

    def open(self) -> int:
        return os.open(self.draft, os.O_WRONLY)

    def commit(self) -> None:
        os.replace(self.draft, self.path)

    def abort(self) -> None:
        if os.path.exists(self.draft):
            os.unlink(self.draft)
