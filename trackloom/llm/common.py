"""Helpers that every corpus operator shares: tables, scratch space, Arrow slicing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import release, scratch, written

#: Bytes of text that one numpy step works on; memory of a task follows this, not the batch.
SLICE_BYTES = 1 << 20


__all__ = ["SLICE_BYTES", "release", "scratch", "table", "text_slices", "texts_of", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes of text (a longer text stands alone).

    What Arrow holds of batches that are gone goes back to the system, as a worker lives on beside others."""
    for batch in batches:
        pa.default_memory_pool().release_unused()
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(size.tolist()):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch; a null text is the empty one."""
    return [t or "" for t in batch.column(column).to_pylist()]
