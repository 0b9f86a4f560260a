"""Sensor files: listings by name, point clouds and radar from .npy, worksheets from CSV."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import cleaned, file_time, iso_to_micros, sequence_key

CLOUD = "path string, x float, y float, z float, intensity float"


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files with the time in their names (null where it is none); their contents are not read."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return paths.select("path", name.alias("name"), iso_to_micros(file_time(name)).alias("t_us"))


def point_clouds(spark: SparkSession, folder: str, pattern: str = "*.npy") -> DataFrame:
    """Points of structured .npy scans, one scan in a task's memory at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                scan = np.load(io.BytesIO(content.as_py()))
                columns = [pa.array(scan[c].astype(np.float32)) for c in ("x", "y", "z", "intensity")]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(scan), pa.string()), *columns], ["path", "x", "y", "z", "intensity"])

    return files.mapInArrow(run, CLOUD)


def radar_slice(radar: DataFrame, start_ns: int, end_ns: int, pad_ns: int = 0) -> DataFrame:
    """Returns in a closed interval, padded on both sides."""
    return radar.where(F.col("ts_ns").between(start_ns - pad_ns, end_ns + pad_ns))


def signals(spark: SparkSession, path: str | None) -> DataFrame:
    """One clock's signal (sequence_id, ts_ns, value) with seconds; no file, no rows."""
    if path is None:
        rows = spark.createDataFrame([], "sequence_id string, ts_ns long, value double")
    else:
        rows = spark.read.schema("sequence_id string, ts_ns long, value double").parquet(path)
    return rows.withColumn("t", F.col("ts_ns") / F.lit(1e9))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a byte order mark before the header is dropped by Spark."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def crosser_worksheet(spark: SparkSession, path: str) -> DataFrame:
    """Answered rows: sequence_id, pedestrian_id, said, offset, notes."""
    rows = _csv(spark, path).select(
        sequence_key(F.col("seq")).alias("sequence_id"),
        cleaned(F.col("pedestrian_id")).alias("pedestrian_id"),
        cleaned(F.col("human_cross")).alias("said"),
        cleaned(F.col("human_crossing_offset_s")).alias("offset"),
        cleaned(F.col("notes")).alias("notes"),
    )
    return rows.where("said <> ''")


def curation_worksheet(spark: SparkSession, path: str) -> DataFrame:
    """The same from the curation sheet, gold rows only."""
    rows = _csv(spark, path).where(F.lower(cleaned(F.col("tier"))) == "gold").select(
        sequence_key(F.col("seq")).alias("sequence_id"),
        cleaned(F.col("pedestrian_id")).alias("pedestrian_id"),
        cleaned(F.col("crossed_yes_no")).alias("said"),
        cleaned(F.col("crossing_start_frame")).alias("offset"),
        cleaned(F.col("notes")).alias("notes"),
    )
    return rows.where("said <> ''")


def disputed(spark: SparkSession, path: str | None) -> DataFrame:
    """Keys where geometry says no and the model says yes; no file, no rows."""
    if path is None:
        return spark.createDataFrame([], "sequence_id string, pedestrian_id string")
    said = lambda c: F.lower(cleaned(F.col(c)))
    rows = _csv(spark, path).where((said("geo_cross") == "false") & (said("pv_cross") == "true"))
    return rows.select(sequence_key(F.col("seq")).alias("sequence_id"), cleaned(F.col("primary_ped")).alias("pedestrian_id")).distinct()
