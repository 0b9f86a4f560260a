"""SimHash near-duplicates by ball hashing from both sides (operator 9).

A fingerprint is made from the XXH64 values of a document's shingles. Two fingerprints that differ
in at most 2h bits have a value within h bits of both. So every distinct fingerprint emits all
values within h bits of itself (h = half the radius; 2,081 values for radius 4), the values are
shuffled, and fingerprints that meet at a value are linked. All that meet at one value lie within
2h bits of each other, so a star from the smallest of them keeps the same components as all pairs;
each such link is verified by its bit distance.

Shape of the work: exact copies share one fingerprint, so a group of copies counts once. The values
leave the tasks as packed arrays by bucket (10 bytes a value), in `slices` rounds over disjoint
parts of the value space, so that only one part's shuffle files exist at a time. A value's part is a
few parities of its bits; parities add up under exclusive or, so a fingerprint's part and a mask's part
tell the value's, and each round makes its own values only. Links, components
and joins are DataFrames; the driver gets none of them.

Edge cases: null text = empty; no word = fingerprint zero, linked like any other; fewer words than
a shingle = one shingle of all words; null doc_id stays null, and a component's id is the smallest
id that is not null (null if it has none); repeated rows each get a row; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import release, text_slices, texts_of, written
from .components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Values that one task of the meeting stage should get.
VALUES_PER_TASK = 1_000_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Bits whose parity is a bit of a value's part: alternating runs of 1, 2, 4, 8, 16 and 32 bits.
_PARITIES = [np.uint64(sum(1 << b for b in range(64) if b >> i & 1)) for i in range(6)]


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """Eight bytes, the highest bit first."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)])
    bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in text_slices(batches, "text"):
            raw = b"".join(fingerprint(t, shingle, seed) for t in texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.frombuffer(raw, dtype=">i8").astype(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def with_fingerprint(docs: DataFrame, name: str, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The documents with all their columns and one more, the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in text_slices(batches, "text"):
            raw = b"".join(fingerprint(t, shingle, seed) for t in texts_of(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.frombuffer(raw, dtype=">i8").astype(np.int64))], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def ball(half: int) -> np.ndarray:
    """All 64-bit masks of at most `half` set bits."""
    return np.array([sum(1 << b for b in c) for k in range(half + 1) for c in combinations(range(64), k)], dtype=np.uint64)


def part_of(values: np.ndarray, slices: int) -> np.ndarray:
    """The part of the value space: log2(slices) parities over fixed halves of the bits."""
    out = np.zeros(len(values), dtype=np.int64)
    for i in range(slices.bit_length() - 1):
        out |= (np.bitwise_count(values & _PARITIES[i]) & 1).astype(np.int64) << i
    return out


def meet(fps: DataFrame, radius: int = RADIUS, slices: int = 8) -> DataFrame:
    """Links (a, b) of distinct fingerprints, enough to connect all that differ in at most `radius` bits (an even number).
    `slices` is a power of two."""
    if slices & (slices - 1) or not 1 <= slices <= 1 << len(_PARITIES):
        raise ValueError("the number of slices is a power of two")
    spark = fps.sparkSession
    masks = ball(radius // 2)
    n = fps.count()
    tasks = max(1, -(-n * len(masks) // (slices * VALUES_PER_TASK)), min(n * len(masks) // 100_000, spark.sparkContext.defaultParallelism))
    spread = written(fps.select("fp").repartition(tasks, "fp"), "spread")  # a small table is few splits, but all tasks emit
    links = [written(_meet_part(spread, masks, radius, part, slices, tasks), "links") for part in range(slices)]
    release(spread)
    return reduce(DataFrame.union, links).distinct()


def _meet_part(fps: DataFrame, masks: np.ndarray, radius: int, part: int, slices: int, tasks: int) -> DataFrame:
    own_part = part_of(masks, slices)
    codes = [np.flatnonzero(own_part == k).astype(np.uint16) for k in range(slices)]

    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            every = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(every), 4_096):
                some = every[at : at + 4_096]
                kind = part_of(some, slices) ^ part  # the part of the masks that lead into this round's
                blocks = [(some[kind == k, None] ^ masks[codes[k]], codes[k]) for k in range(slices)]
                value = np.concatenate([v.ravel() for v, _ in blocks])
                code = np.concatenate([np.broadcast_to(c, v.shape).ravel() for v, c in blocks])
                with np.errstate(over="ignore"):
                    bucket = (((value * _SPREAD) >> np.uint64(44)) % np.uint64(tasks)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                value, code, bucket = value[order], code[order], bucket[order]
                cut = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = [*cut[1:], len(bucket)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cut]), pa.array([value[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()), pa.array([code[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())],
                    ["bucket", "value", "code"],
                )

    def collide(batches: Iterator[pa.RecordBatch]):
        values, codes = [], []
        for batch in batches:
            values += [np.frombuffer(x, dtype=np.uint64) for x in batch.column("value").to_pylist()]
            codes += [np.frombuffer(x, dtype=np.uint16) for x in batch.column("code").to_pylist()]
        if values:
            a, b = stars(np.concatenate(values), np.concatenate(codes), masks, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return fps.select("fp").mapInArrow(emit, "bucket long, value binary, code binary").repartitionById(tasks, F.col("bucket").cast("int")).mapInArrow(collide, "a long, b long")


def stars(value: np.ndarray, code: np.ndarray, masks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from the smallest fingerprint at each value to the others there; each link once."""
    none = np.zeros(0, dtype=np.uint64)
    ordered = np.sort(value)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return none, none
    with np.errstate(over="ignore"):
        short = lambda x: ((x * _SPREAD) >> np.uint64(20)) & np.uint64(0xFFFFF)
    seen = np.zeros(1 << 20, dtype=bool)
    seen[short(twice)] = True
    near = seen[short(value)]  # few others pass
    value, fp = value[near], value[near] ^ masks[code[near]]
    place = np.minimum(np.searchsorted(twice, value), len(twice) - 1)
    real = twice[place] == value
    value, fp = value[real], fp[real]
    order = np.lexsort((fp, value))
    value, fp = value[order], fp[order]
    first = np.flatnonzero(np.diff(value, prepend=value[0] ^ np.uint64(1)))
    least = np.repeat(fp[first], np.diff([*first, len(value)]))
    pairs = np.unique(np.stack([least, fp], axis=1)[least != fp], axis=0)
    close = np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= radius
    return np.ascontiguousarray(pairs[close, 0]), np.ascontiguousarray(pairs[close, 1])


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, slices: int = 8) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    return _labelled(docs, radius, shingle, seed, slices).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _labelled(docs: DataFrame, radius: int, shingle: int, seed: int, slices: int) -> DataFrame:
    if radius % 2:
        raise ValueError("the radius is even: both sides go half of it")
    prints = written(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(meet(distinct, radius, slices)).select(F.col("node").alias("fp"), "root")
    linked = distinct.join(roots, "fp")
    smallest = linked.groupBy("root").agg(F.min("first").alias("smallest"))
    known = distinct.join(linked.select("fp", "root").join(smallest, "root"), "fp", "left").select("fp", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("smallest")).alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return prints.join(written(known, "components"), "fp")


def one_of_each(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, slices: int = 8) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id.

    Ids may be null (these come last) or repeat, in one component or in several: of rows with the same id
    and fingerprint the first by text, then by all other columns that can be sorted, is taken, so the
    result is the same after a lost executor.
    """
    labelled = _labelled(docs, radius, shingle, seed, slices)
    chosen = labelled.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("r")).select("root", "r.doc_id", "r.fp")
    repeated = labelled.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1")
    known = written(chosen.join(repeated, "doc_id", "left").withColumn("odd", F.col("doc_id").isNull() | F.col("times").isNotNull()), "representatives")
    id_, fp, root, rank = _free_names(docs, "id", "fp", "root", "rank")
    own = F.col("doc_id").cast("long")
    kept = docs.join(known.where("not odd").select(F.col("doc_id").alias(id_)), own == F.col(id_), "left_semi")
    if known.where("odd").isEmpty():
        return kept
    odd = known.where("odd").select(F.col("root").alias(root), F.col("doc_id").alias(id_), F.col("fp").alias(f"{fp}2"))
    rows = with_fingerprint(docs.join(odd.select(id_).distinct(), own.eqNullSafe(F.col(id_)), "left_semi"), fp, shingle, seed)
    found = rows.join(odd, own.eqNullSafe(F.col(id_)) & (F.col(fp) == F.col(f"{fp}2")))
    sortable = [f.name for f in docs.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
    first = F.row_number().over(Window.partitionBy(root).orderBy("text", *[F.col(f"`{c}`") for c in sortable]))
    return kept.union(found.withColumn(rank, first).where(F.col(rank) == 1).select([F.col(f"`{c}`") for c in docs.columns]))


def _free_names(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of the documents has."""
    lead = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in docs.columns))
    return [lead + name for name in names]
