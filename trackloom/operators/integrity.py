"""Checksums of what is published, and their comparison with what is there."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checksums(rows: DataFrame, name: str, content: str) -> DataFrame:
    return rows.select(F.col(name).cast("string").alias("path"), F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256).alias("sha256"))


#: On local disks Hadoop keeps hidden checksums of its own; they would turn a changed file into an error instead of a finding.
_RAW = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Bytes up to which a file is read whole into a row.
WHOLE_BYTES = 256 << 20


def _in_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of files read step by step, whatever their size."""
    for batch in batches:
        sums = []
        for path in batch.column("path").to_pylist():
            scheme, authority, name = re.fullmatch(r"([^:/]+):(?://([^/]*))?(/.*)", path, re.S).groups()  # paths come unescaped
            files, base = FileSystem.from_uri(f"{scheme}://{authority or ''}/")
            own = hashlib.sha256()
            with files.open_input_stream(base.rstrip("/") + name) as stream:
                while step := stream.read(1 << 24):
                    own.update(step)
            sums.append(own.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sums, pa.string())], ["path", "sha256"])


def file_checksums(spark, folder: str, relative: bool = False, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """path, sha256 of all files under a folder; `relative` paths start below it.

    Files up to `whole_bytes` are rows that Spark hashes; the filter on the length reaches the scan, so that larger ones (a row cannot hold 2 GB)
    are never loaded: tasks read them in steps.
    """
    found = spark.read.format("binaryFile").options(recursiveFileLookup="true", **_RAW).load(folder)
    small = found.where(F.col("length") <= whole_bytes).select("path", F.sha2("content", 256).alias("sha256"))
    large = found.where(F.col("length") > whole_bytes).select("path").mapInArrow(_in_steps, "path string, sha256 string")
    both = small.unionByName(large)
    if not relative:
        return both
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    base = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(own).toString()
    return both.withColumn("path", F.substring("path", len(base) + 2, 1 << 20))


def verify(listed: DataFrame, found: DataFrame) -> DataFrame:
    """What differs: MISSING (listed only), UNLISTED (found only), CHANGED."""
    both = listed.withColumnRenamed("sha256", "was").join(found.withColumnRenamed("sha256", "now"), "path", "full_outer")
    problem = F.when(F.col("now").isNull(), "MISSING").when(F.col("was").isNull(), "UNLISTED").when(F.col("was") != F.col("now"), "CHANGED")
    return both.select("path", problem.alias("problem")).where("problem is not null")
