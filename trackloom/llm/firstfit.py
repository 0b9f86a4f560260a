"""First-fit decreasing packing with a tournament tree, in randomised groups (operator 13).

Every document gives its full sequences at once, where it is tokenised; they need no plan. What is left of it (shorter than
a sequence) goes to a random group. Groups are packed independently, longest rest first, each into the first
bin with room: a tournament tree holds the largest room of each range of bins, so that a place is found in log(bins) steps.
The number of groups grows with the rests, so a group has about `group_size` of them at any size of the
table, and its ids a few megabytes.

First fit leaves small gaps. A sequence is padded to full length unless its length is a power of two, so gaps cost; documents may be
cut. The emptiest bins are therefore taken apart and fill the gaps of the others, and what is left at last,
less than a sequence, is cut into sequences whose lengths are powers of two: a group ends without padding, and all documents
that first fit placed in bins it filled stay whole. `fill=False` leaves the gaps.

Edge cases: a null text is empty, an empty text the end id alone; null doc_ids and rows that repeat an id are packed like any
other (groups are dealt by the place of a row, not by its id); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, texts_of, written
from .tokens import STEP_BYTES, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: A piece with its ids before it has a place: the task that cut it and its number there name it.
CUT = "doc_id long, part int, local long, start long, length int, doc_tokens long, ids binary"
_NAMES = [x.split()[0] for x in PIECES.split(", ")]


class Tournament:
    """Rooms of bins; each inner node holds the larger room of its two children."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [room] * (2 * self.leaves)

    def first(self, need: int) -> int:
        """The first bin with room for `need`, which is taken there."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < need:
                at += 1
        found = at - self.leaves
        room[at] -= need
        while at > 1:
            at //= 2
            top = max(room[2 * at], room[2 * at + 1])
            if room[at] == top:
                break
            room[at] = top
        return found


def first_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """The bins, each a list of positions in `sizes`; longest first, ties by position."""
    tree, bins = Tournament(len(sizes), room), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = tree.first(sizes[i])
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def without_gaps(bins: list[list[int]], sizes: list[int], room: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (position, start, length) without padding: the emptiest bins fill the gaps of the others, the rest
    of less than a bin is cut into powers of two."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    full = sum(fill) // room  # so many bins stay
    order = sorted(range(len(bins)), key=lambda b: (-fill[b], b))
    out = [[(i, 0, sizes[i]) for i in bins[b]] for b in order[:full]]
    loose = [(i, 0, sizes[i]) for b in order[full:] for i in bins[b]]

    def take(n: int) -> list[tuple[int, int, int]]:
        got = []
        while n:
            i, start, length = loose.pop()
            some = min(n, length)
            got.append((i, start, some))
            if some < length:
                loose.append((i, start + some, length - some))
            n -= some
        return got

    for b, own in zip(order, out, strict=False):
        own += take(room - fill[b])
    rest = sum(n for _, _, n in loose)
    return out + [take(1 << k) for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, room: int, cut_at: str = "space") -> DataFrame:
    """Full sequences and rests of all documents with their ids (little-endian, 16 bits if they fit, else 32). Written once."""

    def run(batches: Iterator[pa.RecordBatch]):
        part, seen = TaskContext.get().partitionId(), 0
        encode = encoder(tokenizer, cut_at)
        kind = "<u2" if max(encode.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        names, kinds = [x.split()[0] for x in CUT.split(", ")], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        for batch in text_slices(batches, "text", STEP_BYTES):
            ids, sizes = encode.encode(texts_of(batch))
            ids = np.insert(ids, np.cumsum(sizes), end_id).astype(kind)
            rows, at = [], 0
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), (sizes + 1).tolist(), strict=True):
                for start in range(0, n, room):
                    length = min(room, n - start)
                    rows.append((doc_id, part, seen, start, length, n, ids[at + start : at + start + length].tobytes()))
                    seen += 1
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(run, CUT), "cut-documents")


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, room: int = 2048, group_size: int = 1024, fill: bool = True) -> DataFrame:
    """The place of every piece. Sequences of the groups have even numbers, full ones of a document odd numbers."""
    cut = tokenised(docs, tokenizer, end_id, room)
    rests = cut.where(F.col("length") < room)
    groups = -(-rests.count() // group_size) or 1

    def whole(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            some = batch.to_pydict()
            crc = [_crc(np.frombuffer(x, dtype=f"<u{len(x) // room}")) for x in some["ids"]]
            number = [(p << 40 | n) << 1 | 1 for p, n in zip(some["part"], some["local"], strict=True)]
            columns = [batch.column("doc_id"), batch.column("start"), pa.array(some["length"], pa.int64()), pa.array(crc, pa.int64()), batch.column("doc_tokens"), pa.array(number, pa.int64()), pa.array([0] * len(crc), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, _NAMES)

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("local", "ascending")])  # the same plan whatever the order of arrival
        own = table.to_pydict()
        ids = [np.frombuffer(x, dtype=f"<u{len(x) // n}") for x, n in zip(own["ids"], own["length"], strict=True)]
        bins = first_fit_decreasing(own["length"], room)
        placed = without_gaps(bins, own["length"], room) if fill else [[(i, 0, own["length"][i]) for i in b] for b in bins]
        rows = []
        for number, pieces in enumerate(placed):
            at = 0
            for i, start, n in pieces:
                rows.append((own["doc_id"][i], own["start"][i] + start, n, _crc(ids[i][start : start + n]), own["doc_tokens"][i], (own["bin_group"][i] << 32 | number) << 1, at))
                at += n
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=_NAMES)

    dealt = rests.withColumn("bin_group", F.pmod(F.xxhash64("part", "local"), F.lit(groups)))
    return cut.where(F.col("length") == room).mapInArrow(whole, PIECES).unionByName(dealt.groupBy("bin_group").applyInArrow(group, PIECES))
