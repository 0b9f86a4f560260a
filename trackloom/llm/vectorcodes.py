"""Vector codes by member-resident Lloyd rounds (operator 11).

Vectors become integers, are cut into equal consecutive parts, and each part position gets a codebook.
A part lives with its owner: the bucket of its (position, entry, salt) in a bucketed table. A round
reads every part where it lives and finds its nearest entry. Parts that stay are never shuffled: the next
round reads them from the same bucket. Only those that change entry migrate, in one shuffle, into
the bucket of their new owner; the union of both tables has the owners' partitioning, so that owners sum up
their members without an exchange. What then travels is one row of sums for each owner.

The salt is a part's row number modulo the number of salts, which grows with the table: even an entry that holds
all parts of its position is dealt to owners of about `resident_rows` parts each. Codebooks hold
`entries` x dimension integers and are all that reaches the driver.

Distances are exact: in doubles where every sum stays below 2^53, else in 64-bit integers.

Edge cases: vectors that are null, or hold a null, NaN or infinite component, are dropped; equal rows and rows of one vec_id are
rows of their own (ties among the first entries go by the vector); null vec_ids are kept and come last among the first
entries; null labels are one label; shorter vectors, and a dimension that the parts do not divide, are filled up with
zeros (to one component a part at least); components beyond +-2^25 (of the integers) count as +-2^25, so that errors fit a long; a label's error beyond
a long is null; fewer vectors than entries make a smaller codebook; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import clear_scratch, scratch
from .common import written

#: Largest integer component.
BOUND = 1 << 25
#: Parts that one numpy step compares with a codebook.
STEP = 4096
OWNER = ["position", "entry", "salt"]


@dataclass
class Codes:
    """`rows`: vec_id, label, entry numbers of the parts, error; `codebooks`: parts x entries x width."""

    rows: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components, decimal, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part the first of the nearest entries, and its squared distance, exactly."""
    entry, far = np.empty(len(parts), dtype=np.int64), np.empty(len(parts), dtype=np.int64)
    top = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    for at in range(0, len(parts), STEP):
        some = parts[at : at + STEP]
        if 4 * parts.shape[1] * top * top < 1 << 53:
            x, c = some.astype(np.float64), book.astype(np.float64)
            near = (c * c).sum(axis=1) - 2 * (x @ c.T)
            best = near.argmin(axis=1)
            gap = near[np.arange(len(x)), best] + (x * x).sum(axis=1)
        else:
            near = np.stack([((some - c) ** 2).sum(axis=1) for c in book], axis=1)
            best = near.argmin(axis=1)
            gap = near[np.arange(len(some)), best]
        entry[at : at + STEP], far[at : at + STEP] = best, gap
    return entry, far


def integers(vectors: DataFrame, vector: str, scale: int) -> DataFrame:
    """row, vec_id, label and the whole components of the rows that have a finite vector."""
    whole = F.col(vector).cast("array<double>")
    fine: Column = whole.isNotNull() & F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    limit = lambda x: F.greatest(F.least(x * F.lit(float(scale)), F.lit(float(BOUND))), F.lit(float(-BOUND)))
    kept = vectors.select("vec_id", "label", F.col(vector)).where(F.coalesce(fine, F.lit(False)))
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform(whole, lambda x: F.floor(limit(x)).cast("int")).alias("whole"))


class _Tables:
    """Bucketed tables of parts in the shared folder."""

    def __init__(self, like: DataFrame, buckets: int):
        self.spark, self.buckets, self.made = like.sparkSession, buckets, []

    def write(self, df: DataFrame, split: str | None = None) -> str:
        name = f"parts_{uuid.uuid4().hex}"
        out = df.write.bucketBy(self.buckets, *OWNER).option("path", path := scratch(self.spark, name))
        (out.partitionBy(split) if split else out).saveAsTable(name)
        self.made.append((name, path))
        return name

    def read(self, names: tuple[str, ...], columns: list[str]) -> DataFrame:
        """All parts: newcomers first, then those that stayed (in this order the union keeps the buckets)."""
        new, *stay = [self.spark.table(n) for n in names]
        return new.select(*columns).union(stay[0].where("not moves").select(*columns)) if stay else new.select(*columns)

    def drop(self, keep: tuple[str, ...] = ()) -> None:
        for name, path in [x for x in self.made if x[0] not in keep]:
            self.spark.sql(f"drop table {name}")
            clear_scratch(self.spark, [path])
            self.made.remove((name, path))


def _batch(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("part").flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def compress(vectors: DataFrame, entries: int = 256, parts: int = 4, rounds: int = 4, scale: int = 1024, vector: str = "embedding", resident_rows: int = 1 << 16) -> Codes:
    """Codes of all vectors after `rounds` rounds of assignment and update, and one more assignment."""
    spark = vectors.sparkSession
    rows = integers(vectors, vector, scale)
    label_type = rows.schema["label"].dataType
    known = rows.agg(F.count("*").alias("n"), F.max(F.size("whole")).alias("size")).first()
    width = max(1, -(-(known["size"] or 0) // parts))
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    salts = max(16, -(-known["n"] // resident_rows))

    def filled(lists: pa.Array) -> np.ndarray:
        """(rows, parts, width), with zeros behind shorter vectors."""
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros((len(size), parts * width), dtype=np.int64)
        out[np.arange(parts * width) < size[:, None]] = flat
        return out.reshape(len(size), parts, width)

    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).select("whole").collect()
    books = filled(pa.array([r["whole"] for r in first], pa.list_(pa.int32()))).transpose(1, 0, 2)
    fields = [("row", T.LongType()), ("vec_id", T.LongType()), ("label", label_type), ("position", T.IntegerType()), ("entry", T.IntegerType()), ("salt", T.IntegerType()), ("part", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def cut(batches: Iterator[pa.RecordBatch], books: np.ndarray = books):
        for batch in batches:
            whole = filled(batch.column("whole"))
            row = batch.column("row").to_numpy(zero_copy_only=False)
            for p in range(parts):  # vec_id and label travel with the first part alone
                own = [batch.column(c) if p == 0 else pa.nulls(len(row), batch.column(c).type) for c in ("vec_id", "label")]
                entry, _ = nearest(whole[:, p], books[p])
                lists = pa.FixedSizeListArray.from_arrays(pa.array(whole[:, p].ravel().astype(np.int32)), width).cast(pa.list_(pa.int32()))
                columns = [batch.column("row"), *own, np.full(len(row), p, dtype=np.int32), entry.astype(np.int32), (row % salts).astype(np.int32), lists]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema.names)

    def found(batch: pa.RecordBatch, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        position = batch.column("position").to_numpy(zero_copy_only=False)
        members, entry, far = _batch(batch, width), np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
        for p in np.unique(position).tolist():
            own = position == p
            entry[own], far[own] = nearest(members[own], books[p])
        return entry.astype(np.int32), far

    def moved(members: DataFrame, books: np.ndarray) -> DataFrame:
        """All columns, and the entry that a part goes to (null: it stays)."""

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                entry, _ = found(batch, books)
                stays = entry == batch.column("entry").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(entry, mask=stays), pa.array(~stays)], [*batch.schema.names, "goes_to", "moves"])

        return members.mapInArrow(run, T.StructType([*schema.fields, T.StructField("goes_to", T.IntegerType()), T.StructField("moves", T.BooleanType())]))

    def updated(members: DataFrame, books: np.ndarray) -> np.ndarray:
        """Each owner sums its members where they are; entries take floor(sum / count) over their owners."""
        owners = members.groupBy(*OWNER).agg(F.count("*").alias("n"), *[F.sum(F.col("part")[i].cast("long")).alias(f"s{i}") for i in range(width)])
        out = books.copy()
        for r in owners.groupBy("position", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]).collect():  # parts x entries rows at most
            out[r["position"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
        return out

    tables = _Tables(vectors, buckets)
    residents = (tables.write(rows.mapInArrow(cut, schema).repartition(buckets, *OWNER)),)
    for number in range(rounds):
        if number:  # the first assignment is that of the cut
            stay = tables.write(moved(tables.read(residents, schema.names), books), split="moves")
            go = spark.table(stay).where("moves").withColumn("entry", F.col("goes_to")).select(*schema.names)
            residents = (tables.write(go.repartition(buckets, *OWNER)), stay)
            tables.drop(keep=residents)
        books = updated(tables.read(residents, schema.names), books)

    def coded(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            entry, far = found(batch, books)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "vec_id", "label", "position")], pa.array(entry), pa.array(far)], ["row", "vec_id", "label", "position", "entry", "far"])

    kinds = T.StructType([*schema.fields[:5], T.StructField("far", T.LongType())])
    own = [F.max(F.when(F.col("position") == p, F.col("entry"))).alias(f"c{p}") for p in range(parts)]
    whole = tables.read(residents, schema.names).mapInArrow(coded, kinds).groupBy("row").agg(F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), F.sum("far").alias("error"), *own)
    out = written(whole.select("vec_id", "label", F.array(*[f"c{p}" for p in range(parts)]).alias("entries"), "error"), "codes")
    tables.drop()
    return Codes(out, books)


def digest(codes: Codes) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256 of every row."""
    sums = written(codes.rows.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    code = F.concat_ws("", F.transform("entries", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")))
    both = codes.rows.join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
    return both.select("vec_id", code.alias("code"), "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))
