"""Session factory: UTC, adaptive execution, shuffle partitions by the cluster's parallelism."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "trackloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The folder is the session's `spark.checkpoint.dir`. Only a local master (tests on one machine) may
    go without: then a temporary folder takes its place. Elsewhere that is an error, because executors
    would write to folders of their own machines.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("trackloom.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("trackloom.scratch.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


#: Paths handed out by `scratch` that were not cleared yet.
_made: list[str] = []


def clear_scratch(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Deletes scratch paths (all of this process without `paths`); results that are still read from them are lost. Returns how many."""
    gone = list(_made if paths is None else paths)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in gone:
        own = jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(conf).delete(own, True)
        if path in _made:
            _made.remove(path)
    return len(gone)


#: Spark drops an execution's shuffle files when it ends, instead of when the driver collects garbage.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writers = threading.Lock(), []


@contextmanager
def _released(spark: SparkSession) -> Iterator[None]:
    """The setting holds while anyone writes; the first writer sets it and the last one puts it back."""
    with _lock:
        if not _writers:
            _writers.append(spark.conf.get(_RELEASE))
            spark.conf.set(_RELEASE, "true")
        _writers.append("")
    try:
        yield
    finally:
        with _lock:
            _writers.pop()
            if len(_writers) == 1:
                spark.conf.set(_RELEASE, _writers.pop())


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back: lineage ends here, lost executors
    cannot take it along, and nondeterministic parts are fixed. Its shuffle files go at once."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with _released(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what `written` wrote for these tables; nothing may read them any more."""
    for df in tables:
        clear_scratch(df.sparkSession, [df._scratch])
