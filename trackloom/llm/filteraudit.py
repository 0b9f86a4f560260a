"""Filter interaction audit by truth-table survival words (operator 12).

Five filters A to E give each document a mask of failures. Its survival word has a bit for each of the 32
subsets of filters: 1 if the document passes all filters of the subset. The number of survivors of
each subset, for each part and label, is a positional popcount of these words; it is counted by carry-save adders:
three words of one weight become their bitwise sum and a carry of twice the weight, whole arrays at a time, until two words a
weight are left. Everything else follows from the 32 counts: what stays after the first k filters of an
order is the survivors of their set, what a step removes is the difference of two sets.

Duplicates (E) are told by the SHA-256 of the whole text: the smallest doc_id of each digest that occurs twice is
joined to narrow rows of digest, doc_id, part and mask; texts are never shuffled. Both sides of that join are written
tables, so that adaptive execution can split a digest that holds a third of all rows.

Edge cases: a null text is empty; a null source is the part ''; a null doc_id is neither
smaller nor larger than another, so it is no duplicate and makes none; rows that share the smallest id of a text are no duplicates either; equal label rows of one id count once, and one that says 1 is enough; labels of unknown documents are
ignored; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, texts_of, written

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
CLASSES = ("all", "good", "toxic")
_SIGNS = re.compile(r"[#$%&*|]")
_NOT_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)
#: Word of each failure mask.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & m) for m in range(SUBSETS)], dtype=np.uint32)
COUNTS = [f"{c}_{s}" for c in CLASSES for s in range(SUBSETS)]
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: str) -> int:
    """The mask of A (1), B (2), C (4) and D (8) of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # at ASCII white space alone
    capitals = len(raw.translate(None, _NOT_CAPITAL))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 2 * len(text)) << 2 | bool(_SIGNS.search(text)) << 3


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the words have each bit, by carry-save adders."""
    counts = np.zeros(SUBSETS, dtype=np.int64)
    level, weight = words.astype(np.uint32), 1
    while len(level):
        carries = []
        while len(level) > 2:
            third = len(level) // 3
            a, b, c = level[:third], level[third : 2 * third], level[2 * third : 3 * third]
            either = a ^ b
            carries.append(a & b | either & c)
            level = np.concatenate([either ^ c, level[3 * third :]])
        for word in level.tolist():
            counts += weight * (word >> np.arange(SUBSETS) & 1)
        level, weight = np.concatenate(carries) if carries else level[:0], 2 * weight
    return counts


def marked(docs: DataFrame) -> DataFrame:
    """digest, doc_id, part and the mask of A to D of every document. Written once."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for some in text_slices([batch], "text"):
                texts = texts_of(some)
                digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), some.column("doc_id"), some.column("part"), pa.array(list(map(failures, texts)), pa.int32())], ["digest", "doc_id", "part", "mask"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(run, "digest binary, doc_id long, part string, mask int"), "marks")


def survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part: how many documents survive each subset of filters, of all, of good and of toxic ones (`COUNTS`)."""
    marks = marked(docs)
    first = marks.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    flags = labels.where("quality = 1 or toxic = 1").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    told = marks.join(written(first, "firsts"), "digest", "left").select("doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)).alias("mask"))
    labelled = told.join(written(flags, "label-flags"), "doc_id", "left").select("part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in CLASSES[1:]])

    def count(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            parts = batch.column("part").dictionary_encode()
            part = parts.indices.to_numpy(zero_copy_only=False)
            words = WORDS[batch.column("mask").to_numpy(zero_copy_only=False)]
            flags = [np.ones(len(words), dtype=bool), *[batch.column(c).to_numpy(zero_copy_only=False) for c in CLASSES[1:]]]
            order = np.argsort(part, kind="stable")
            own = np.split(order, np.cumsum(np.bincount(part, minlength=len(parts.dictionary)))[:-1])
            table = np.array([[n for f in flags for n in positional_popcount(words[rows[f[rows]]])] for rows in own], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([parts.dictionary, *[pa.array(table[:, i]) for i in range(len(COUNTS))]], ["part", *COUNTS])

    counted = labelled.mapInArrow(count, ", ".join(["part string", *[f"{c} long" for c in COUNTS]]))
    return counted.groupBy("part").agg(*[F.sum(c).alias(c) for c in COUNTS])


def audit(survivors: DataFrame) -> DataFrame:
    """For each part, order of the filters and step what the filter does there."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    full = SUBSETS - 1

    def run(batches: Iterator[pa.RecordBatch]):
        before, after, bit = [], [], []
        for order in orders:
            seen = 0
            for f in order:
                before.append(seen)
                bit.append(1 << FILTERS.index(f))
                seen |= bit[-1]
                after.append(seen)
        before, after, bit = map(np.array, (before, after, bit))
        n = len(before)
        for batch in batches:
            for r in batch.to_pylist():
                alive, good, toxic = (np.array([r[f"{c}_{s}"] for s in range(SUBSETS)]) for c in CLASSES)
                removed = alive[before] - alive[after]
                by_filter = np.bincount(bit, weights=removed, minlength=SUBSETS).astype(np.int64)  # exact below 2^53 documents
                columns = [alive[after], removed, alive[0] - alive[bit] - removed, alive[full ^ bit] - alive[full], good[before] - good[after], toxic[before] - toxic[after], by_filter[bit]]
                names = [x.split()[0] for x in AUDIT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * n), pa.array(np.repeat(orders, len(FILTERS)).tolist()), pa.array(np.tile(np.arange(1, 6, dtype=np.int32), len(orders))), *map(pa.array, columns)], names)

    return survivors.mapInArrow(run, AUDIT)


#: The same in DuckDB SQL, from the documents' failures without words or popcounts.
ORACLE = r"""
with texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
split as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as first from texts),
fails as (
    select part, doc_id, len(words) < 200 as a, 100 * len(list_distinct(words)) < 50 * len(words) as b,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d, coalesce(doc_id > first, false) as e
    from split),
flags as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
docs as (
    select part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int as mask, coalesce(good, false) as good, coalesce(toxic, false) as toxic
    from fails left join flags using (doc_id)),
masses as (select part, mask, count(*) as n, count(*) filter (good) as n_good, count(*) filter (toxic) as n_toxic from docs group by all),
letters as (select unnest([{'f': 'A', 'bit': 1}, {'f': 'B', 'bit': 2}, {'f': 'C', 'bit': 4}, {'f': 'D', 'bit': 8}, {'f': 'E', 'bit': 16}], recursive := true)),
orders as (
    select v.f || w.f || x.f || y.f || z.f as filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] as bits
    from letters v, letters w, letters x, letters y, letters z where v.bit + w.bit + x.bit + y.bit + z.bit = 31 and len(list_distinct([v.bit, w.bit, x.bit, y.bit, z.bit])) = 5),
steps as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0) as earlier from orders, range(1, 6) s(step)),
counted as (
    select part, filter_order, step, bit,
        sum(n) filter (mask & (earlier | bit) = 0) as kept, sum(n) filter (mask & bit != 0 and mask & earlier = 0) as removed,
        sum(n) filter (mask & bit != 0 and mask & earlier != 0) as redundant, sum(n) filter (mask = bit) as unique_fails,
        sum(n_good) filter (mask & bit != 0 and mask & earlier = 0) as good_lost, sum(n_toxic) filter (mask & bit != 0 and mask & earlier = 0) as toxic_lost
    from masses cross join (select filter_order, step::int as step, bit::bigint as bit, earlier::bigint as earlier from steps) group by part, filter_order, step, bit)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
    coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
    coalesce(sum(removed) over (partition by part, bit), 0)::bigint as shapley
from counted
"""
