"""Benchmark decontamination (operator 4).

Every benchmark item of n words is looked for in every window of n words of every document; a document
of fewer words is one window as a whole, for every size at which it can still reach the similarity. Windows
and items get a SimHash over their five-word shingles, repeats included. The items' fingerprints are
indexed by blocks of bits and by item size: with radius r and b blocks, two fingerprints within r differ in at most
r // b bits in some block, so looking up every block value within that many bits finds all fingerprints
within the radius. Four blocks of 16 bits and radius 15 look at 4 % of the items of a window's size.
What is found is verified by the exact weighted similarity of the shingle multisets (sum of smaller
counts over sum of larger counts), which must be at least `similarity`. Words are compared
lower-cased, without ASCII punctuation.

Two multisets of m shingles that are similar to s share 2ms / (1 + s) of them at least, so fingerprints are made
only of windows that hold that many shingles of items of their size; the shingles' hashes tell, and nothing that
could be verified is left out by this. The radius is a choice: it reaches 99.7 % of pairs of similarity 0.8 to 0.85 and
99.9 % of closer ones (measured on edited items; `radius` is a parameter).

The benchmark is a query set: its size is measured, and it is matched against all documents in
blocks of `BLOCK_BYTES` of item text, one scan of the documents a block, no join or shuffle. The blocks lie in the
shared folder; tasks get their paths, and a Python worker builds a block once. The driver holds no item.

Edge cases: null text = empty; items or documents without a word match nothing; items shorter than
five words are one shingle; equal items match each on its own (they are kept once, with their number);
repeated documents give repeated rows; null ids stay null; an empty table gives no rows; further
columns are ignored (and kept by `without_contamination`).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, text_slices, texts_of, written
from .files import locate
from .wordhash import PUNCT, Ranges, Words, words

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 15, 4
#: Text of benchmark items that a task holds at once.
BLOCK_BYTES = 8 << 20
#: Window starts whose bit counts are in memory at once.
STARTS = 1 << 14

MATCH = "doc_id long, item_id long, similarity double, start_word long, n_words int"


def bits(hashes: np.ndarray) -> np.ndarray:
    """(n, 64) of 0 and 1."""
    return np.unpackbits(np.ascontiguousarray(hashes.astype(">u8")).view(np.uint8).reshape(-1, 8), axis=1)


def majority(ones: np.ndarray, total: int) -> np.ndarray:
    """Fingerprints of rows of 64 counts of ones among `total`."""
    return np.packbits(2 * ones > total, axis=1).view(">u8").astype(np.uint64).ravel()


class HammingIndex:
    """Fingerprints by blocks of bits and by group; finds all of the same group within `radius`."""

    def __init__(self, prints: np.ndarray, groups: np.ndarray | None = None, radius: int = RADIUS, blocks: int = BLOCKS):
        self.prints, self.radius, self.blocks, self.width = prints, radius, blocks, 64 // blocks
        self.groups = np.zeros(len(prints), dtype=np.int64) if groups is None else groups
        self.near = np.array([sum(1 << i for i in c) for n in range(radius // blocks + 1) for c in combinations(range(self.width), n)], dtype=np.uint64)
        self.slots = 1 << min(20, max(8, len(prints).bit_length() + 3))
        self.starts, self.items = [], []
        for own in self._split(prints):
            slot = self._slot(own, self.groups)
            self.items.append(np.argsort(slot, kind="stable"))
            self.starts.append(np.searchsorted(slot[self.items[-1]], np.arange(self.slots + 1)))

    def _split(self, prints: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64((1 << self.width) - 1)
        return [(prints >> np.uint64(b * self.width)) & mask for b in range(self.blocks)]

    def _slot(self, values: np.ndarray, groups: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (values + (groups.astype(np.uint64) << np.uint64(self.width))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(65 - self.slots.bit_length())).astype(np.int64)

    def within(self, prints: np.ndarray, groups: np.ndarray | None = None, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in `prints`, item) within the radius, each once."""
        groups = np.zeros(len(prints), dtype=np.int64) if groups is None else groups
        found = [np.zeros(0, dtype=np.int64)]
        for first in range(0, len(prints), step):
            asked, kind = prints[first : first + step], groups[first : first + step]
            for own, starts, items in zip(self._split(asked), self.starts, self.items, strict=True):
                slot = self._slot(own[:, None] ^ self.near, kind[:, None]).ravel()
                n = starts[slot + 1] - starts[slot]
                some = np.flatnonzero(n)
                slot, n = slot[some], n[some]
                query = np.repeat(some // len(self.near), n)
                item = items[np.repeat(starts[slot], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))]
                close = (self.groups[item] == kind[query]) & (np.bitwise_count(asked[query] ^ self.prints[item]) <= self.radius)
                found.append((query[close] + first) * len(self.prints) + item[close])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))


def shingles(own: list[bytes], k: int) -> Counter:
    return Counter(tuple(own[i : i + k]) for i in range(len(own) - k + 1))


def weighted_similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def least_shared(m: int, n: int, similarity: float) -> int:
    """How many shingles multisets of m and n shingles share at least if they reach the similarity."""
    return max(1, math.ceil((m + n) * similarity / (1 + similarity) - 1e-9))


class Benchmark:
    """Items with their sizes, shingles and fingerprints, and the hashes of all their shingles."""

    def __init__(self, items: list[tuple], radius: int = RADIUS, blocks: int = BLOCKS, shingle: int = SHINGLE):
        w = words([t.lower() for _, t in items], PUNCT)
        sizes = np.diff(w.bounds)
        kept = np.flatnonzero(sizes).tolist()
        self.ids, self.of_item = [items[i][0] for i in kept], sizes[kept]
        self.shingle, self.counts, prints = shingle, [], [np.zeros(0, dtype=np.uint64)]
        hashes: dict[int, list[np.ndarray]] = {}
        of_size: dict[int, list[np.ndarray]] = {}
        for i, n in zip(kept, self.of_item.tolist(), strict=True):
            k = min(shingle, n)
            own = grams_at(w, np.arange(w.bounds[i], w.bounds[i + 1] - k + 1), k)
            hashes.setdefault(k, []).append(own)
            of_size.setdefault(k, []).append(np.full(len(own), n))
            prints.append(majority(bits(own).sum(axis=0, dtype=np.int64)[None, :], len(own)))
            self.counts.append(shingles(word_bytes(w, w.bounds[i], w.bounds[i + 1]), k))
        self.index = HammingIndex(np.concatenate(prints), self.of_item, radius, blocks)
        self.known, self.filters, self.sizes = {}, {}, {}
        for k in hashes:
            pairs = np.unique(np.stack([np.concatenate(hashes[k]), np.concatenate(of_size[k]).astype(np.uint64)], axis=1), axis=0)
            self.known[k], first = np.unique(pairs[:, 0], return_index=True)
            self.filters[k] = _marked(self.known[k])
            self.sizes[k] = (np.append(first, len(pairs)), pairs[:, 1].astype(np.int64))  # the sizes of each hash's items

    def find(self, k: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes of some item's k-word shingles, and which they are among the known ones."""
        some = np.flatnonzero(self.filters[k][(hashes >> np.uint64(44)).astype(np.int64)])
        own = self.known[k]
        which = np.minimum(np.searchsorted(own, hashes[some]), len(own) - 1)
        real = own[which] == hashes[some]
        return some[real], which[real]

    def places_by_size(self, k: int, at: np.ndarray, which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each item size the places that have a shingle of an item of that size."""
        starts, sizes = self.sizes[k]
        n = starts[which + 1] - starts[which]
        size = sizes[np.repeat(starts[which], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))]
        place = np.repeat(at, n)
        for own in np.unique(size).tolist():
            yield own, place[size == own]


def _marked(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, dtype=bool)
    out[(hashes >> np.uint64(44)).astype(np.int64)] = True
    return out


def grams_at(w: Words, at: np.ndarray, k: int) -> np.ndarray:
    return Ranges(w.hashes).hash(at, at + k)


def word_bytes(w: Words, first: int, last: int) -> list[bytes]:
    return [w.data[a:b].tobytes() for a, b in zip(w.start[first:last].tolist(), w.end[first:last].tolist(), strict=True)]


def touched(texts: list[str], bench: Benchmark) -> list[int]:
    """Texts that have a shingle of some item."""
    w = words([t.lower() for t in texts], PUNCT)
    found = np.zeros(len(texts), dtype=bool)
    doc = w.doc
    for k in bench.known:
        at, grams = w.grams(k)
        found[doc[at[bench.find(k, grams)[0]]]] = True
    return np.flatnonzero(found).tolist()


def matches(text: str, bench: Benchmark, similarity: float) -> list[tuple]:
    """(item_id, similarity, start_word, n_words) of the best window for each item, the first of equals."""
    w = words([text.lower()], PUNCT)
    n = len(w.hashes)
    best: dict[int, tuple[float, int]] = {}
    own_words: list[bytes] | None = None
    for k in bench.known:
        if n < k:
            continue
        grams = w.grams(k)[1]
        places = list(bench.places_by_size(k, *bench.find(k, grams)))
        for starts, sizes, prints in windows(grams, places, k, n, similarity):
            at, items = bench.index.within(prints, sizes)
            for s, size, item in zip(starts[at].tolist(), sizes[at].tolist(), items.tolist(), strict=True):
                own_words = own_words or word_bytes(w, 0, n)
                sim = weighted_similarity(shingles(own_words[s : s + size], k), bench.counts[item])
                if sim >= similarity and (sim, -s) > best.get(item, (0.0, 0)):
                    best[item] = (sim, -s)
    order = sorted(best, key=lambda i: (bench.of_item[i], i))
    return [(bench.ids[i], round(best[i][0], 9), -best[i][1], int(min(bench.of_item[i], n))) for i in order]


def windows(grams: np.ndarray, places: list[tuple[int, np.ndarray]], k: int, n: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, item sizes and fingerprints of the windows of a document of n words that can reach the similarity."""
    parts = []
    for size, own in places:
        m = min(size, n) - k + 1
        least = least_shared(m, size - k + 1, similarity)
        if least <= m and len(own) >= least:
            inside = np.zeros(len(grams) + 1, dtype=np.int64)
            inside[own + 1] = 1
            np.cumsum(inside, out=inside)
            at = np.flatnonzero(inside[m:] - inside[: len(inside) - m] >= least)
            if len(at):
                parts.append((at, size, m))
    for first in range(0, len(grams), STARTS):
        here = [(at[(at >= first) & (at < first + STARTS)], size, m) for at, size, m in parts]
        here = [p for p in here if len(p[0])]
        if here:
            base, reach = min(int(at[0]) for at, _, _ in here), max(int(at[-1]) + m for at, _, m in here)
            ones = np.zeros((reach - base + 1, 64), dtype=np.int32)
            np.cumsum(bits(grams[base:reach]), axis=0, out=ones[1:], dtype=np.int32)
            prints = [majority(ones[at - base + m] - ones[at - base], m) for at, _, m in here]
            yield np.concatenate([at for at, _, _ in here]), np.repeat([s for _, s, _ in here], [len(at) for at, _, _ in here]), np.concatenate(prints)


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Writes the items to the shared folder in blocks of about `block_bytes` of text; the blocks' paths."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).groupBy("item_id", "text").agg(F.count("*").alias("copies"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n, path = max(1, -(-size // block_bytes)), scratch(benchmark.sparkSession, "benchmark")
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    blocks.repartition(n, "block").write.partitionBy("block").parquet(path)
    known = blocks.select("block").distinct().orderBy("block").collect() if size else []  # a row for each block
    return [f"{path}/block={r['block']}" for r in known]


_built: dict[tuple, Benchmark] = {}


def built(path: str, radius: int) -> Benchmark:
    """A block as this Python worker holds it: one at a time, built once; ids are (item_id, copies)."""
    if (path, radius) not in _built:
        where, own = locate(path)
        rows = pq.read_table(own, filesystem=where, partitioning=None, columns=["item_id", "copies", "text"]).to_pylist()
        rows.sort(key=lambda r: (r["item_id"] is not None, r["item_id"] or 0, r["text"]))
        _built.clear()
        _built[path, radius] = Benchmark([((r["item_id"], r["copies"]), r["text"]) for r in rows], radius)
    return _built[path, radius]


def contaminations(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row of MATCH for each document and item with a window of at least `similarity`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.sparkSession.createDataFrame([], MATCH)
    for path in benchmark_blocks(benchmark, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], path=path):
            bench = built(path, radius)
            for batch in text_slices(batches, "text"):
                texts, ids = texts_of(batch), batch.column("doc_id").to_pylist()
                out = [(ids[d], item, *m) for d in touched(texts, bench) for (item, copies), *m in matches(texts[d], bench, similarity) for _ in range(copies)]
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "item_id", "similarity", "start_word", "n_words"])

        found = found.union(rows.mapInArrow(run, MATCH))
    return found


def without_contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that match no item, with all their columns. What one block leaves is written before the next is matched."""
    for i, path in enumerate(benchmark_blocks(benchmark, block_bytes)):

        def run(batches: Iterator[pa.RecordBatch], path=path):
            bench = built(path, radius)
            for batch in text_slices(batches, "text"):
                texts = texts_of(batch)
                clean = np.ones(len(texts), dtype=bool)
                for d in touched(texts, bench):
                    clean[d] = not matches(texts[d], bench, similarity)
                yield batch.filter(pa.array(clean))

        docs = (written(docs, "clean-so-far") if i else docs).mapInArrow(run, docs.schema)
    return docs
