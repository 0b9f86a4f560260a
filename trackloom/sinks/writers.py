"""Writers: partitioned tables, documents, in-place changes, reports and snapshots."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity


def tracks(rows: DataFrame, path: str, by: str = "sequence_id") -> None:
    """Parquet by sequence; only the partitions that occur in `rows` are replaced."""
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(by).parquet(path)


def new_only(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not there yet (skip if exists)."""
    return rows.join(existing.select(*keys).distinct(), keys, "left_anti")


def documents(rows: DataFrame, path: str) -> None:
    """One JSON document a line."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("errorifexists").text(path)


@contextmanager
def replaced(spark: SparkSession, path: str, force: bool = False) -> Iterator[str]:
    """A fresh path beside `path`, which gets its name when the block ends without an error.

    An existing path is refused unless `force`d; then the old one is renamed, the new one takes its name, and the old one is deleted. Whatever fails
    before the last step, one of both is whole: a write that fails leaves the old one untouched, and if the new one cannot be
    renamed the old one gets its name back. Renames are one step on HDFS and local disks; object stores copy.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    mark = uuid.uuid4().hex
    own, fresh, old = hadoop(path), hadoop(f"{path}.staged-{mark}"), hadoop(f"{path}.replaced-{mark}")
    files = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = files.exists(own)
    if there and not force:
        raise FileExistsError(f"{path} is there already: force its replacement")
    try:
        yield fresh.toString()
        if there and not files.rename(own, old):
            raise OSError(f"{path} could not be renamed")
        if not files.rename(fresh, own):
            if there:
                files.rename(old, own)
            raise OSError(f"{fresh} could not be renamed")
    except BaseException:
        files.delete(fresh, True)
        raise
    if there:
        files.delete(old, True)


def replace(rows: DataFrame, path: str, force: bool = False) -> None:
    """Writes `rows` beside `path` and gives them its name when they are complete (see `replaced`). `rows` may read `path`."""
    with replaced(rows.sparkSession, path, force) as fresh:
        rows.write.parquet(fresh)


def restamp(spark: SparkSession, path: str, change) -> None:
    """Replaces a table by a function of itself."""
    replace(change(spark.read.parquet(path)), path, force=True)


def detections(images: DataFrame, path: str, by: str = "sequence_id") -> None:
    """The cache of detections (sequence_id, image, boxes: array of x1, y1, x2, y2, score; empty where nothing was found, so that the image is
    not asked for again): Parquet by sequence, only sequences that occur in `images` are replaced. `documents.detections` reads maps of the same boxes."""
    flat = images.withColumn("boxes", F.transform("boxes", lambda b: F.array(b["x1"], b["y1"], b["x2"], b["y2"], b["score"])))
    tracks(flat.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("image", "boxes")))).alias("images")), path, by)


def quality_table(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).mode("overwrite").csv(path)


def prefilled(worksheet: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """Worksheet rows whose key has a note get its merge target, and the note after their own."""
    both = worksheet.join(notes.select(*keys, F.col("merge_into").alias("_into"), F.col("note").alias("_note")), keys, "left")
    text = F.when(F.col("_note").isNull(), F.col("notes")).otherwise(F.concat_ws("; ", F.nullif(F.col("notes"), F.lit("")), F.col("_note")))
    return both.withColumn("merge_into", F.coalesce("_into", "merge_into")).withColumn("notes", text).drop("_into", "_note")


def report(counts: DataFrame, config: dict, failures: DataFrame | None = None) -> str:
    """A run's report as JSON: its configuration, one row of counts, failures cut at 200 characters (the first hundred)."""
    out = {"config": config, "counts": counts.first().asDict()}
    if failures is not None:
        out["failures"] = [r.asDict() for r in failures.select("key", F.substring("error", 1, 200).alias("error")).orderBy("key").limit(100).collect()]
    return json.dumps(out, sort_keys=True, default=str)


def snapshot(tables: dict[str, DataFrame], path: str, manifest: dict) -> DataFrame:
    """Writes tables, a manifest and the checksums of all files; refuses an existing path. Returns the checksums."""
    spark = next(iter(tables.values())).sparkSession
    counts = {}
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{path}/{name}")
        counts[name] = spark.read.parquet(f"{path}/{name}").count()
    text = json.dumps(manifest | {"rows": counts}, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/manifest")
    sums = integrity.file_checksums(spark, path)
    sums.orderBy("path").write.parquet(f"{path}_checksums")
    return spark.read.parquet(f"{path}_checksums")


def markdown(rows: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table: a report, at most `most` rows."""
    body = [" | ".join("" if v is None else str(v) for v in r) for r in rows.limit(most).collect()]
    return "\n".join(f"| {line} |" for line in [" | ".join(rows.columns), " | ".join("---" for _ in rows.columns), *body])
