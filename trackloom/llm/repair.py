"""Re-Pair grammar compression of token ids, one shard at a time, with random access (operator 7).

A shard is a row of documents' ids, each ended by the end id. That id may also occur inside a
document, so an end is a symbol of its own in the shard (number `vocabulary`; it is read as the end
id). Pairs of neighbours become nonterminals, the most frequent first, in rounds, until no pair occurs
`LEAST_COUNT` times in the shard (then a rule would cost more than it saves); their counts are exact, and
rules nest as deep as the ids repeat. Pairs never hold an end, so every document starts at a symbol of
its own. The shard file has the rules, the length that each rule expands to, and where each document
starts in symbols and in tokens: one document can be decoded without the others, and one token of it
without the rest. Symbols take as many bits as the shard's number of symbols needs (16 at least).

Documents are put in ascending doc_id order by a range partitioning (on the id, a hash of the text and
a number dealt to each row, so that one id with many rows, equal ones too, is dealt out); each task writes its shards under temporary names
and renames them, and the list of shards is a table that Spark writes.

Edge cases: null text = empty = the end id alone; null doc_ids come first; rows with equal doc_id
are ordered by a hash of the text and the text; an empty table gives no shard; further columns are
ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, text_slices, texts_of, written
from .files import NewFile, make_folder, open_random
from .tokens import STEP_BYTES, encoder

SHARD_TOKENS = 2_000_000
#: Places below which a pair is left alone: a rule costs two symbols and a length, about 6 bytes, a place saves about 2.
LEAST_COUNT = 4
#: A round takes all pairs at least 1 / ROUND_SHARE as frequent as the most frequent one.
ROUND_SHARE = 8
_MAGIC = b"RPAIR\x02\0\0"
_HEAD = struct.Struct("<8sIIQIIIQ")  # magic, vocabulary, end id, documents, rules, bits a symbol, bytes a length, symbols
MANIFEST = "part int, shard int, path string, documents long, tokens long, bytes long"


def _groups(keys: np.ndarray, places: np.ndarray, bits: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys that occur `least` times or more in order, how often they do, and their places one after the other, in order.

    Keys (of so many bits) and places are sorted as one number where both fit into 64 bits."""
    width = int(places[-1] if len(places) else 0).bit_length()
    if bits + width > 64:
        order = np.argsort(keys, kind="stable")
        keys, own = keys[order], places[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        pick = lambda at: own[at]
    else:
        keys <<= np.uint64(width)
        keys |= places.astype(np.uint64)
        keys.sort()
        first = np.concatenate([[0], 1 + np.flatnonzero((keys[1:] ^ keys[:-1]) >> np.uint64(width))]) if len(keys) else np.zeros(0, dtype=np.int64)
        pick = lambda at: (keys[at] & np.uint64((1 << width) - 1)).astype(np.int32)
    times = np.diff(first, append=len(keys))
    often = times >= least
    first, times = first[often], times[often]
    found = keys[first] if bits + width > 64 else keys[first] >> np.uint64(width)
    return found, times, pick(np.repeat(first - (np.cumsum(times) - times), times) + np.arange(int(times.sum())))


def compress(ids: np.ndarray, vocabulary: int, least: int = LEAST_COUNT, share: int = ROUND_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Symbols, and rules (n, 2): rule r is symbol `vocabulary + 1 + r`, and `vocabulary` ends a document.

    A round takes the pairs that occur at least 1 / `share` as often as the most frequent one. Where two
    of them overlap the more frequent one wins; a pair that keeps fewer than `least` places waits. Counts
    are exact: replacing takes the old pairs off, and the new pairs around a new symbol occur only there.

    Symbols stay where they are and are linked to their neighbours. A pair comes up in one round alone, which lists
    its places once; later some of them may hold another pair. So a round costs what it replaces, not the length of the shard.
    """
    n = len(ids)
    s = np.full(n + 1, vocabulary, dtype=np.uint32)  # one more end, which begins no pair
    s[:-1] = ids
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    pair = np.full(n + 1, -1, dtype=np.int32)  # number of the pair that begins at a place
    dead, marked = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=bool)
    rules, made = [np.zeros(0, dtype=np.uint64)], 0
    known, counts, start, size = np.zeros(0, dtype=np.uint64), *(np.zeros(0, dtype=np.int64) for _ in range(3))
    places: list[np.ndarray] = []  # of the pairs of each round; start counts through all of them
    listed, shift = 0, np.uint64(32)

    def count(at: np.ndarray) -> None:
        """Lists the pairs that begin at places where pairs are new; a pair with an end counts as never."""
        nonlocal known, counts, start, size, listed
        bits = int(vocabulary + made).bit_length()
        low = np.uint64(bits)
        key = (s[at] if made else s[:-1]).astype(np.uint64)
        key <<= low
        key |= s[after[at]] if made else s[1:]
        key, times, own = _groups(key, at, 2 * bits, least)
        left, right = key >> low, key & np.uint64((1 << bits) - 1)
        pair[own] = np.repeat(np.arange(len(known), len(known) + len(times), dtype=np.int32), times)
        start, size = np.concatenate([start, listed + np.cumsum(times) - times]), np.concatenate([size, times])
        known, counts = np.concatenate([known, (left << shift) | right]), np.concatenate([counts, np.where((left == vocabulary) | (right == vocabulary), 0, times)])
        places.append(own)
        listed += len(own)

    def listed_at(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs in order, and which of the pairs begins there."""
        by_list = np.searchsorted(ends, start[chosen], side="right")  # which round listed them
        at, own = [], []
        for k in np.unique(by_list).tolist():
            some = np.flatnonzero(by_list == k)
            times = size[chosen[some]]
            offset = start[chosen[some]] - (ends[k] - len(places[k]))
            at.append(places[k][np.repeat(offset - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))])
            own.append(np.repeat(some, times))
        at, own = np.concatenate(at), np.concatenate(own)
        holds = pair[at] == chosen[own]
        own, at = _grouped_by_place(at[holds], own[holds], len(chosen))
        return at, own

    count(np.arange(n, dtype=np.int32))
    while len(counts) and (most := int(counts.max())) >= least:
        chosen = np.flatnonzero(counts >= max(least, most // share))
        chosen = chosen[np.lexsort((known[chosen], -counts[chosen]))]
        ends = np.cumsum([len(x) for x in places])
        at, own = listed_at(chosen)
        touch = np.flatnonzero(at[1:] == after[at[:-1]])
        left, right = np.full(len(at), len(chosen)), np.full(len(at), len(chosen))
        left[touch + 1], right[touch] = own[touch], own[touch + 1]
        win, tie = (own <= left) & (own <= right), own == left
        if tie.any():  # of a row of equal ids every second pair is real
            row = np.arange(len(at))
            real = (row - np.maximum.accumulate(np.where(tie, 0, row))) % 2 == 0
            win &= real
            counts[chosen[np.bincount(own[real], minlength=len(chosen)) < least]] = 0
        good = np.bincount(own[win], minlength=len(chosen)) >= least
        win &= good[own]
        at, own = at[win], own[win]
        if not len(at):
            continue
        second = after[at]
        for gone_from in (second, at, before[at[before[at] >= 0]]):  # pairs that end with this round; one place may come twice
            gone = pair[gone_from]
            pair[gone_from] = -1
            counts -= np.bincount(gone[gone >= 0], minlength=len(counts))
        s[at] = (vocabulary + made + np.cumsum(good))[own]
        dead[second] = True
        follow = after[second]
        after[at] = follow
        before[follow] = at
        rules.append(known[chosen[good]])
        made += int(good.sum())
        marked[at] = True
        ahead = before[at]
        ahead = ahead[ahead >= 0]
        fresh = np.concatenate([at, ahead[~marked[ahead]]])
        marked[at] = False
        fresh.sort(kind="stable")  # two sorted runs
        count(fresh)
    keys = np.concatenate(rules)
    return s[:-1][~dead[:-1]], np.stack([keys >> shift, keys & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)


def _grouped_by_place(at: np.ndarray, own: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """(which, where) in order of the places."""
    bits = pairs.bit_length()
    both = np.sort((at.astype(np.int64) << bits) | own)
    return both & ((1 << bits) - 1), both >> bits


def expansion_lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """Ids that each rule stands for; rules refer to earlier rounds only."""
    size = np.zeros(len(rules), dtype=np.int64)
    done = np.zeros(len(rules), dtype=bool)
    while not done.all():
        parts = rules.astype(np.int64) - vocabulary - 1
        known = (parts < 0) | done[np.maximum(parts, 0)]
        now = known.all(axis=1) & ~done
        size[now] = np.where(parts < 0, 1, size[np.maximum(parts, 0)]).sum(axis=1)[now]
        done |= now
    return size


def expand(symbols: np.ndarray, rules: np.ndarray, vocabulary: int, end_id: int) -> np.ndarray:
    """The ids that a row of symbols stands for."""
    s = symbols.astype(np.uint32)
    while (deep := s > vocabulary).any():
        out = np.empty(len(s) + int(deep.sum()), dtype=np.uint32)
        at = np.arange(len(s)) + np.cumsum(deep) - deep
        out[at[~deep]] = s[~deep]
        own = rules[s[deep] - vocabulary - 1]
        out[at[deep]], out[at[deep] + 1] = own[:, 0], own[:, 1]
        s = out
    s[s == vocabulary] = end_id
    return s


def packed(symbols: np.ndarray, width: int) -> bytes:
    """The low 16 bits of all symbols, then each higher bit of all symbols as a plane of its own."""
    planes = [np.packbits((symbols >> b & 1).astype(np.uint8)).tobytes() for b in range(16, width)]
    return b"".join([(symbols & 0xFFFF).astype("<u2").tobytes(), *planes])


def unpacked(read, n: int, width: int, a: int, b: int) -> np.ndarray:
    """Symbols a .. b of the n that `packed` wrote; `read(at, size)` gives bytes."""
    out = np.frombuffer(read(2 * a, 2 * (b - a)), dtype="<u2").astype(np.uint32)
    for plane in range(width - 16):
        own = np.frombuffer(read(2 * n + plane * -(-n // 8) + a // 8, -(-b // 8) - a // 8), dtype=np.uint8)
        out |= np.unpackbits(own)[a % 8 : a % 8 + b - a].astype(np.uint32) << np.uint32(16 + plane)
    return out


def shard_bytes(ids: np.ndarray, sizes: np.ndarray, doc_ids: list[int | None], vocabulary: int, end_id: int) -> bytes:
    symbols, rules = compress(ids, vocabulary)
    lengths = expansion_lengths(rules, vocabulary)
    ends = np.flatnonzero(symbols == vocabulary) + 1
    width = max(16, (vocabulary + len(rules)).bit_length())
    size = 2 if lengths.max(initial=0) < 1 << 16 else 4
    known = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    return b"".join(
        [
            _HEAD.pack(_MAGIC, vocabulary, end_id, len(doc_ids), len(rules), width, size, len(symbols)),
            np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes(),
            known.tobytes(),
            np.concatenate([[0], ends]).astype("<u8").tobytes(),
            np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes(),
            lengths.astype(f"<u{size}").tobytes(),
            packed(rules.ravel(), width),
            packed(symbols, width),
        ]
    )


class Shard:
    """A shard file: its tables are read, its symbols only where asked for."""

    def __init__(self, path: str):
        self.file = open_random(path)
        magic, self.vocabulary, self.end_id, n, rules, self.width, size, self.n_symbols = _HEAD.unpack(self.file.read(_HEAD.size))
        if magic != _MAGIC:
            raise ValueError(f"{path} is no shard")
        own = np.frombuffer(self.file.read(8 * n), dtype="<i8")
        known = np.frombuffer(self.file.read(n), dtype=np.uint8)
        self.doc_ids = [int(x) if k else None for x, k in zip(own, known, strict=True)]
        self.symbol_start = np.frombuffer(self.file.read(8 * (n + 1)), dtype="<u8").astype(np.int64)
        self.token_start = np.frombuffer(self.file.read(8 * (n + 1)), dtype="<u8").astype(np.int64)
        self.lengths = np.frombuffer(self.file.read(size * rules), dtype=f"<u{size}").astype(np.int64)
        base = self.file.tell()
        self.rules = unpacked(self._reader(base), 2 * rules, self.width, 0, 2 * rules).reshape(-1, 2)
        self.base = base + 4 * rules + (self.width - 16) * -(-2 * rules // 8)

    def _reader(self, base: int):
        def read(at: int, size: int) -> bytes:
            self.file.seek(base + at)
            return self.file.read(size)

        return read

    def symbols(self, a: int, b: int) -> np.ndarray:
        return unpacked(self._reader(self.base), self.n_symbols, self.width, a, b)

    def all_ids(self) -> np.ndarray:
        """Ids of the whole shard: every rule is expanded once, then all symbols are looked up."""
        n = len(self.rules)
        plain = np.arange(self.vocabulary + 1, dtype=np.uint32)
        plain[-1] = self.end_id
        known = np.concatenate([plain, expand(self.vocabulary + 1 + np.arange(n), self.rules, self.vocabulary, self.end_id)])
        size_of = np.concatenate([np.ones(len(plain), dtype=np.int64), self.lengths])
        start_of = np.cumsum(size_of) - size_of
        own = self.symbols(0, self.n_symbols)
        size = size_of[own]
        before = np.cumsum(size) - size
        return known[np.repeat(start_of[own] - before, size) + np.arange(int(size.sum()))]

    def document(self, i: int) -> np.ndarray:
        """Ids of one document; no other is read or expanded."""
        return expand(self.symbols(self.symbol_start[i], self.symbol_start[i + 1]), self.rules, self.vocabulary, self.end_id)

    def token(self, i: int, at: int) -> int:
        """Id number `at` of document i, by the expansion lengths alone."""
        own = self.symbols(self.symbol_start[i], self.symbol_start[i + 1]).astype(np.int64)
        size = np.where(own <= self.vocabulary, 1, self.lengths[np.maximum(own - self.vocabulary - 1, 0)] if len(self.lengths) else 1)
        ends = np.cumsum(size)
        k = int(np.searchsorted(ends, at, side="right"))
        at, symbol = at - int(ends[k] - size[k]), int(own[k])
        while symbol > self.vocabulary:
            left, right = (int(x) for x in self.rules[symbol - self.vocabulary - 1])
            n = 1 if left < self.vocabulary else int(self.lengths[left - self.vocabulary - 1])
            symbol, at = (left, at) if at < n else (right, at - n)
        return self.end_id if symbol == self.vocabulary else symbol


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, shard_tokens: int = SHARD_TOKENS, cut: str = "space") -> DataFrame:
    """Encodes the documents, writes shards in doc_id order and returns their list."""
    folder = make_folder(scratch(docs.sparkSession, "shards"))

    def run(batches: Iterator[pa.RecordBatch]):
        part, made, held, held_ids, total = TaskContext.get().partitionId(), [], [], [], 0
        encode = encoder(tokenizer, cut).encode

        def flush():
            file = NewFile(folder, ".repair")
            ids, sizes = np.concatenate([x for x, _ in held]), np.concatenate([n for _, n in held])
            file.write(shard_bytes(ids, sizes, held_ids, vocabulary, end_id))
            made.append((part, len(made), file.done(), len(sizes), len(ids), file.size))

        for batch in text_slices(batches, "text", min(STEP_BYTES, 2 * shard_tokens)):
            ids, sizes = encode(texts_of(batch))
            ends = np.cumsum(sizes)
            held.append((np.insert(ids, ends, vocabulary), sizes + 1))
            held_ids += batch.column("doc_id").to_pylist()
            total += len(ids) + len(sizes)
            if total >= shard_tokens:
                flush()
                held, held_ids, total = [], [], 0
        if held:
            flush()
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], ["part", "shard", "path", "documents", "tokens", "bytes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.withColumn("_dealt", F.monotonically_increasing_id()).repartitionByRange(F.col("doc_id"), F.xxhash64("text"), F.col("_dealt")).drop("_dealt").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return written(ordered.mapInArrow(run, MANIFEST), "shard-list")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read from the shard files."""
    spark = shards.sparkSession
    # one row for each writing task: bounded by the number of partitions, not by the data
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect()
    bases = np.concatenate([[0], np.cumsum([r["n"] for r in parts])]).astype(np.int64).tolist()
    base = spark.createDataFrame([(r["part"], b) for r, b in zip(parts, bases, strict=False)], "part int, base long")
    before = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.withColumn("inside", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long"))).join(F.broadcast(base), "part")
    n = shards.count()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = Shard(path)
                ids = shard.all_ids().astype("<u4")
                at = shard.token_start.tolist()
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(shard.token_start[:-1] + start), pa.array(np.diff(shard.token_start)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = placed.select("path", (F.col("base") + F.col("inside")).alias("start"))
    return rows.repartition(max(1, min(n, 4 * spark.sparkContext.defaultParallelism + n // 8))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
