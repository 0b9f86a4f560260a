"""Files in the shared folder, by path or URI (local mounts, HDFS, object stores), through pyarrow."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def make_folder(uri: str) -> str:
    where, path = locate(uri)
    where.create_dir(path, recursive=True)
    return uri


class NewFile:
    """A file that gets its name when it is complete; a task that dies leaves only a temporary one."""

    def __init__(self, folder: str, suffix: str):
        self.uri = f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"
        self.where, self.path = locate(self.uri)
        self.out = self.where.open_output_stream(self.path + ".part", compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def done(self) -> str:
        self.out.close()
        self.where.move(self.path + ".part", self.path)
        return self.uri


def open_stream(uri: str):
    where, path = locate(uri)
    return where.open_input_stream(path, compression=None)


def open_random(uri: str):
    where, path = locate(uri)
    return where.open_input_file(path)


def parquet_tables(uri: str) -> Iterator[pa.Table]:
    """The files of a Parquet table that Spark wrote, one at a time; the driver's JVM reads none of it."""
    where, path = locate(uri)
    for found in sorted(where.get_file_info(fs.FileSelector(path)), key=lambda x: x.path):
        if found.is_file and found.path.endswith(".parquet"):
            with where.open_input_file(found.path) as source:
                yield pq.ParquetFile(source, pre_buffer=False).read(use_threads=False)


class Shared:
    """A value for tasks, in a file of the shared folder: a worker reads it once, and neither the driver's nor an executor's JVM holds it."""

    def __init__(self, folder: str, value):
        new = NewFile(make_folder(folder), ".pickle")
        new.write(pickle.dumps(value, pickle.HIGHEST_PROTOCOL))
        self.folder, self.uri = folder, new.done()

    @property
    def value(self):
        if self.uri not in _read:
            _read.clear()
            with open_stream(self.uri) as stream:
                _read[self.uri] = pickle.loads(stream.read())
        return _read[self.uri]


#: The last value that this worker read.
_read: dict[str, object] = {}
