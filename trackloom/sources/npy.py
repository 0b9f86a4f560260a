"""Structured `.npy` files as a Python Data Source: a partition a file, filters pushed into the reader.

    register(spark)
    spark.read.format("npy").option("pattern", "*.npy").load(folder).where("t_us between ...")

Columns: `path`, `t_us` (microseconds of the time in the file's name, null without one), and the fields of the
record type, which the header of the first file tells (a schema of some of them may be given instead). Comparisons of `t_us` with numbers leave
whole files out before any is opened; comparisons of a record's own number (`ts_ns` of radar) leave its rows out before they become Arrow.
Spark asks the reader only where `spark.sql.python.filterPushdown.enabled` is set, which `register` does for the session.
"""

from __future__ import annotations

import fnmatch
import io
import operator
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_type

#: Records that one Arrow batch holds.
BATCH = 65_536
_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
_KINDS = {"f4": T.FloatType(), "f8": T.DoubleType(), "i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(), "u1": T.ShortType(), "u2": T.IntegerType(), "u4": T.LongType(), "b1": T.BooleanType()}


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def name_time(name: str) -> int | None:
    """Microseconds of the ISO time after the last underscore of a file's name."""
    text = name.rsplit("/", 1)[-1].rsplit("_", 1)[-1].removesuffix(".npy")
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        return None
    gone = (at if at.tzinfo else at.replace(tzinfo=timezone.utc)) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (gone.days * 86_400 + gone.seconds) * 1_000_000 + gone.microseconds


def _header(stream) -> np.dtype:
    """The record type, from the first bytes of a file alone."""
    start = stream.read(12)
    size = struct.unpack("<H", start[8:10])[0] + 10 if start[6] == 1 else struct.unpack("<I", start[8:12])[0] + 12
    head = io.BytesIO(start + stream.read(size - 12))
    read = np.lib.format.read_array_header_1_0 if np.lib.format.read_magic(head) == (1, 0) else np.lib.format.read_array_header_2_0
    return read(head)[2]


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def files(self) -> list[str]:
        where, folder = located(self.options["path"])
        found = where.get_file_info(fs.FileSelector(folder, recursive=True)) if where.get_file_info(folder).type == fs.FileType.Directory else [where.get_file_info(folder)]
        return sorted(f.path for f in found if f.is_file and fnmatch.fnmatch(f.base_name, self.options.get("pattern", "*.npy")))

    def schema(self) -> T.StructType:
        files = self.files()
        if not files:
            raise FileNotFoundError(f"no .npy file under {self.options['path']}: give a schema to read none")
        with located(self.options["path"])[0].open_input_stream(files[0]) as stream:
            kind = _header(stream)
        fields = [T.StructField(n, _KINDS[kind[n].newbyteorder("=").str[1:]]) for n in kind.names or ()]
        return T.StructType([T.StructField("path", T.StringType()), T.StructField("t_us", T.LongType()), *fields])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return NpyReader(schema, self.options["path"], self.files())


class OneFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class NpyReader(DataSourceReader):
    def __init__(self, schema: T.StructType, root: str, files: list[str]):
        self.schema, self.root, self.files = schema, root, files
        self.by_file, self.by_row = [], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes comparisons of numbers; gives all others back to Spark."""
        numbers = {f.name for f in self.schema.fields if isinstance(f.dataType, T.NumericType)}
        for f in filters:
            column = f.attribute[0] if type(f) in _COMPARE and len(f.attribute) == 1 else None
            if column in numbers and isinstance(f.value, (int, float)):
                (self.by_file if column == "t_us" else self.by_row).append((column, _COMPARE[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Files whose time passes; a file without a time passes no comparison."""
        times = {f: name_time(f) for f in self.files}
        return [OneFile(f) for f in self.files if all(times[f] is not None and test(times[f], value) for _, test, value in self.by_file)]

    def read(self, partition: OneFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no partition passed
            return
        where, _ = located(self.root)
        if isinstance(where, fs.LocalFileSystem):
            rows = np.load(partition.path, mmap_mode="r")
        else:
            with where.open_input_stream(partition.path) as stream:
                rows = np.load(io.BytesIO(stream.read()))
        at = name_time(partition.path)
        for start in range(0, len(rows), BATCH):
            some = rows[start : start + BATCH]
            for column, test, value in self.by_row:
                some = some[test(some[column], value)]
            kinds = [pa.field(f.name, to_arrow_type(f.dataType)) for f in self.schema.fields]
            of_file = {"path": partition.path, "t_us": at}
            columns = [pa.array([of_file[f.name]] * len(some), f.type) if f.name in of_file else pa.array(np.ascontiguousarray(some[f.name])).cast(f.type) for f in kinds]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(kinds))


def write_scans(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows (scan, t_us, further columns of numbers) as one structured file a scan, named by sequence and time; returns scan, path and
    number of rows. A file gets its name when it is complete, and a task that runs twice writes the same."""
    fields = [c for c in rows.columns if c not in ("scan", "t_us")]

    def write(own: pa.Table) -> pa.Table:
        scan, at = own.column("scan")[0].as_py(), own.column("t_us")[0].as_py()
        data = np.rec.fromarrays([own.column(c).to_numpy() for c in fields], names=fields)
        data = np.sort(data, order=fields)  # whatever the order of arrival
        iso = (datetime(1970, 1, 1) + np.timedelta64(at, "us").astype(object)).isoformat()
        where, path = located(folder)
        where.create_dir(path, recursive=True)
        name = f"{path}/{scan}_{iso}Z.npy"
        buffer = io.BytesIO()
        np.save(buffer, data)
        part = f"{name}.{uuid.uuid4().hex}.part"
        with where.open_output_stream(part, compression=None) as out:
            out.write(buffer.getvalue())
        where.move(part, name)
        return pa.table([pa.array([str(scan)]), pa.array([name]), pa.array([len(data)], pa.int64())], names=["scan", "path", "n"])

    return rows.groupBy("scan", "t_us").applyInArrow(write, "scan string, path string, n long")
