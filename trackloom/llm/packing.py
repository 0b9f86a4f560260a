"""Best-fit packing by linear grouping (operator 8).

Documents longer than a sequence are cut into full pieces, the first one shorter. What is left to
pack is known by its length alone, so the plan is made on the histogram of lengths: at most one row
for each possible length reaches the driver, whatever the number of documents.

The plan: large lengths (over `small` of a sequence) are sorted and dealt into groups of equal
cardinality, each rounded up to its longest member. For these few sizes the configurations of a
sequence are optimised: column generation solves the linear relaxation, its solution is rounded
down, and the rest is filled by the fullest configurations. The actual documents take the places of
their group, longest first, which leaves them with more room than planned. Small documents then go
best-fit, longest first, into the fullest sequence that has room, and into new ones at last.

Everything is kept in runs: "the documents of length l with ranks r .. r + n go to sequences s ..
s + n / k, k in each, at offset o". There are a few thousand runs at any size of the data. A
document finds its run by its length and its rank among all of that length; the rank is its rank in
its task plus the counts of earlier tasks.

Edge cases: null text = empty = the end id alone; null doc_ids and repeated rows are packed like any
other row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_slices, texts_of, written
from .tokens import STEP_BYTES, encoder

PIECES = "doc_id long, piece int, start long, length int, ids binary, part int, local long"


def cut(n: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, after a first one that may be shorter."""
    first = n % room or min(n, room)
    return [(0, first), *((at, room) for at in range(first, n, room))]


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, room: int, cut_at: str = "lead") -> DataFrame:
    """The pieces of all documents with their ids (little-endian, 16 bits if they fit, else 32),
    the writing task and the piece's rank there among pieces of its length. Written once."""

    def run(batches: Iterator[pa.RecordBatch]):
        part, seen = TaskContext.get().partitionId(), [0] * (room + 1)
        encode = encoder(tokenizer, cut_at)
        kind = "<u2" if max(encode.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        for batch in text_slices(batches, "text", STEP_BYTES):
            ids, sizes = encode.encode(texts_of(batch))
            ids = np.insert(ids, np.cumsum(sizes), end_id).astype(kind)
            rows, at = [], 0
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), (sizes + 1).tolist(), strict=True):
                for i, (start, length) in enumerate(cut(n, room)):
                    rows.append((doc_id, i, start, length, ids[at + start : at + start + length].tobytes(), part, seen[length]))
                    seen[length] += 1
                at += n
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(run, PIECES), "pieces")


@dataclass
class Plan:
    """Runs: length, first rank, number of pieces, first sequence, pieces in each sequence, offset there."""

    room: int
    sequences: int = 0
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)

    def new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n


def configurations(sizes: list[int], counts: list[int], room: int) -> list[tuple[list[int], int]]:
    """How often to use which configuration (pieces of each size in one sequence), to use up all counts.

    Column generation: the prices of the sizes under the present basis, and the most valuable
    configuration at these prices, until none is worth more than a sequence.
    """
    k, w = len(sizes), np.array(sizes)
    demand = np.array(counts, dtype=float)
    basis = np.diag([float(room // s) for s in sizes])
    for _ in range(50 * k):
        inverse = np.linalg.inv(basis)
        use, price = inverse @ demand, inverse.sum(axis=0)
        column, value = _best_configuration(w, price, room)
        if value <= 1 + 1e-9:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-12, use / np.where(step > 1e-12, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    use = np.linalg.solve(basis, demand)
    left, chosen = np.array(counts, dtype=np.int64), []
    for j in np.argsort(-use, kind="stable"):
        column = basis[:, j].round().astype(np.int64)
        times = int(min([use[j] + 1e-9, *(left[i] // column[i] for i in range(k) if column[i])]))
        if times > 0:
            chosen.append((column.tolist(), times))
            left -= times * column
    while left.any():  # the rest that rounding down leaves: the fullest configuration of what there is
        column = _fullest(w, left, room)
        times = int(min(left[i] // column[i] for i in range(k) if column[i]))
        chosen.append((column.tolist(), times))
        left -= times * column
    return chosen


def _best_configuration(w: np.ndarray, price: np.ndarray, room: int) -> tuple[np.ndarray, float]:
    """The most valuable multiset of sizes that fits (unbounded knapsack)."""
    value, last = np.zeros(room + 1), np.full(room + 1, -1)
    order = [i for i in range(len(w)) if price[i] > 0]
    for c in range(int(w.min()), room + 1):
        value[c], last[c] = value[c - 1], -1
        for i in order:
            if w[i] <= c and value[c - w[i]] + price[i] > value[c] + 1e-12:
                value[c], last[c] = value[c - w[i]] + price[i], i
    column, c = np.zeros(len(w)), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            column[last[c]] += 1
            c -= w[last[c]]
    return column, float(value[room])


def _fullest(w: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """Largest remaining size first, then whatever fills the sequence most (bounded subset sums)."""
    column = np.zeros(len(w), dtype=np.int64)
    top = int(np.argmax(np.where(left > 0, w, -1)))
    column[top] = 1
    free = room - int(w[top])
    reach: dict[int, tuple[int, ...]] = {0: ()}
    for i in range(len(w)):
        for _ in range(int(min(left[i] - column[i], free // w[i]))):
            more = {s + int(w[i]): (*p, i) for s, p in reach.items() if s + int(w[i]) <= free and s + int(w[i]) not in reach}
            if not more:
                break
            reach |= more
    for i in reach[max(reach)]:
        column[i] += 1
    return column


def make_plan(histogram: dict[int, int], room: int, groups: int = 24, small: float = 0.34) -> Plan:
    """Runs for `histogram` (pieces by length)."""
    plan = Plan(room)
    least = int(small * room)
    if full := histogram.get(room, 0):
        plan.runs.append((room, 0, full, plan.new(full), 1, 0))
    lengths = sorted((n for n in histogram if least < n < room and histogram[n]), reverse=True)
    total = sum(histogram[n] for n in lengths)
    queues: list[list[list[int]]] = []  # for each group its (length, first rank, count), longest first
    per_group, filled = -(-total // groups) if total else 0, 0
    for n in lengths:
        rank = 0
        while rank < histogram[n]:
            if filled % per_group == 0:
                queues.append([])
            take = min(histogram[n] - rank, per_group - filled % per_group)
            queues[-1].append([n, rank, take])
            rank, filled = rank + take, filled + take
    bins: list[tuple[int, int, int]] = []  # (first sequence, how many, filled)
    if queues:
        # groups of one size are one size
        sizes = sorted({q[0][0] for q in queues}, reverse=True)
        merged = {s: [run for q in queues if q[0][0] == s for run in q] for s in sizes}
        counts = [sum(run[2] for run in merged[s]) for s in sizes]
        for column, times in configurations(sizes, counts, room):
            state = [(plan.new(times), times, 0)]
            for size, n in zip(sizes, column, strict=True):
                for _ in range(n):
                    state = _substitute(plan, state, merged[size])
            bins += state
    _best_fit(plan, bins, {n: histogram[n] for n in sorted(histogram, reverse=True) if n <= least and histogram[n]})
    return plan


def _substitute(plan: Plan, state: list[tuple[int, int, int]], queue: list[list[int]]) -> list[tuple[int, int, int]]:
    """Gives each sequence of `state` the next document of the group's queue."""
    out = []
    for first, n, filled in state:
        while n:
            length, rank, count = queue[0]
            take = min(n, count)
            plan.runs.append((length, rank, take, first, 1, filled))
            out.append((first, take, filled + length))
            first, n = first + take, n - take
            queue[0][1:] = [rank + take, count - take]
            if not queue[0][2]:
                queue.pop(0)
    return out


def _best_fit(plan: Plan, bins: list[tuple[int, int, int]], small: dict[int, int]) -> None:
    """Small documents, longest first, each into the fullest sequence with room for it."""
    by_room: list[list[tuple[int, int]]] = [[] for _ in range(plan.room + 1)]
    for first, n, filled in bins:
        by_room[plan.room - filled].append((first, n))
    for length, count in small.items():
        rank = 0
        free = length
        while rank < count:
            while free <= plan.room and not by_room[free]:
                free += 1
            if free > plan.room:
                free = plan.room
                by_room[free].append((plan.new(-(-(count - rank) // (free // length))), -(-(count - rank) // (free // length))))
            first, n = by_room[free].pop()
            each = free // length
            whole = min(n, (count - rank) // each)
            if not whole:  # fewer documents than one sequence takes
                each, whole = count - rank, 1
            plan.runs.append((length, rank, whole * each, first, each, plan.room - free))
            rank += whole * each
            by_room[free - each * length].append((first, whole))
            if n > whole:
                by_room[free].append((first + whole, n - whole))


def placed(pieces: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, piece, start, length, rank (among pieces of the length), ids_crc32, sequence_id, offset of every piece; ids stay in `pieces`."""
    runs = np.array(sorted(plan.runs), dtype=np.int64).reshape(-1, 6)
    keys = (runs[:, 0] << 48) | runs[:, 1]

    def checksum(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            width = [len(x) // n for x, n in zip(batch.column("ids").to_pylist(), batch.column("length").to_pylist(), strict=True)]
            crc = [zlib.crc32(np.frombuffer(x, dtype=f"<u{w}").astype("<u4").tobytes()) for x, w in zip(batch.column("ids").to_pylist(), width, strict=True)]
            names = ["doc_id", "piece", "start", "length", "part", "local"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(crc, pa.int64())], [*names, "ids_crc32"])

    def place(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            own = runs[np.searchsorted(keys, (length << 48) | rank, side="right") - 1]
            at = rank - own[:, 1]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(length), pa.array(rank), batch.column("ids_crc32"), pa.array(own[:, 3] + at // own[:, 4]), pa.array(own[:, 5] + at % own[:, 4] * length)],
                ["doc_id", "piece", "start", "length", "rank", "ids_crc32", "sequence_id", "offset"],
            )

    narrow = pieces.mapInArrow(checksum, "doc_id long, piece int, start long, length int, part int, local long, ids_crc32 long")
    ranked = with_rank(narrow, pieces)
    return ranked.select("doc_id", "piece", "start", "length", "rank", "ids_crc32").mapInArrow(
        place, "doc_id long, piece int, start long, length long, rank long, ids_crc32 long, sequence_id long, offset long"
    )


def with_rank(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """Rows of pieces with their rank among all pieces of their length; length and rank name a piece."""
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    return rows.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("local"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, room: int = 2048, groups: int = 24, small: float = 0.34) -> tuple[DataFrame, DataFrame]:
    """The pieces with their ids, and the place of each piece."""
    pieces = tokenised(docs, tokenizer, end_id, room)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `room` rows
    return pieces, placed(pieces, make_plan(histogram, room, groups, small))


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (binary, 32 bits each, little-endian), doc_ids and lengths of its
    pieces in order. Pieces meet their places by length and rank, which are unique whatever the ids of the documents."""
    ranked = with_rank(pieces.select("doc_id", "length", "part", "local", "ids"), pieces).select("length", "rank", "ids")
    both = places.select("sequence_id", "offset", "doc_id", "length", "rank").join(ranked, ["length", "rank"])
    parts = both.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = batch.column("parts").to_pylist()
            ids = [b"".join(np.frombuffer(p["ids"], dtype=f"<u{len(p['ids']) // p['length']}").astype("<u4").tobytes() for p in row) for row in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("sequence_id"), pa.array(ids, pa.binary()), pa.array([[p["doc_id"] for p in row] for row in rows], pa.list_(pa.int64())), pa.array([[p["length"] for p in row] for row in rows], pa.list_(pa.int64()))],
                ["sequence_id", "ids", "doc_ids", "lengths"],
            )

    return parts.mapInArrow(run, "sequence_id long, ids binary, doc_ids array<long>, lengths array<long>")
