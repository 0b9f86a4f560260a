"""Toxicity by a convolutional text classifier, trained in numpy (operator 3).

A word's vector is the sum of three hashed embeddings: of the word, and of its first four and six
bytes, so that forms of a word never seen in training still have a known part. Filters of width one,
two and three run over the word vectors of the whole text, each filter's largest response is kept,
and a logistic unit makes the score. Training (Adagrad on the log loss; only the windows that won
the pooling get gradients, and words are
at times shown by their beginnings alone) goes over all learnable rows, `passes` times: they are dealt by a hash of their id to shards of some `SHARD_CHARS`
characters; a task trains on one shard from the common model, and the changes of all shards are averaged (of an
embedding over the shards that changed it). The first pass starts from random parameters and the classes' shares among all rows. Learnable rows of at most `START_CHARS`
characters in all are a single small shard: with these, several epochs over all of them but the tenth below come first. No sample is drawn unless a caller asks for one with `positives` and
`negatives` (then so many documents with the smallest hashes of their ids make the starting point, until a class has `class_chars` characters).
Rows whose crc32(doc_id) is divisible by five are never learned from; all others are. A decision threshold for each language, and one for rows without a
language (0.5 where there are few toxic rows), needs scores of rows that a model has not seen: a twin of the model makes the same passes without a tenth of the
learnable rows, and its scores of that whole tenth calibrate. The score itself sees nothing but the text.

Edge cases: null or empty text = no word = the score of no response; null doc_id is scored, and is
not held out; a document with several labels counts as toxic if one of them says so; rows that repeat an id all count; null labels are
left out; without labels of both kinds every score is the share of toxic labels (0 if there is
none); repeated rows are scored one by one; an empty table gives no rows; further columns are
ignored by `score` and kept by `without_toxic`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import clear_scratch
from .common import release, scratch, text_slices, texts_of, written
from .files import Shared, parquet_tables
from .wordhash import PUNCT, Words, words

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 16, 8, (1, 2, 3)
PREFIXES = (4, 6)
#: Text that one step of scoring works on.
STEP_BYTES = 1 << 20
#: Words that one step of training works on (a longer text stands alone).
STEP_WORDS = 1 << 18
#: Text that one task trains on from the common model, and rows of the table whose changes are averaged together.
SHARD_CHARS, SLOT = 24_000_000, 256
#: Text of all learnable rows up to which they are taken at once, before the passes.
START_CHARS = 1_000_000
FOLDS, SEED = 5, 17


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(words, 3) rows of the embedding table, and where each text's words begin (one more for the end)."""
    w: Words = words([t.lower() for t in texts], PUNCT)
    parts = [w.hashes, *[w.ranges.hash(w.start, np.minimum(w.start + p, w.end)) for p in PREFIXES]]
    return np.stack([(h >> np.uint64(48)).astype(np.int64) + i * BUCKETS for i, h in enumerate(parts)], axis=1), w.bounds


def all_features(texts: list[str], step: int = STEP_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """The same for any number of texts, worked on in steps of text so that memory follows the step."""
    parts, bounds, at, size = [np.zeros((0, 1 + len(PREFIXES)), dtype=np.int32)], [np.zeros(1, dtype=np.int64)], 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= step or i == len(texts) - 1:
            rows, own = features(texts[at : i + 1])
            parts.append(rows.astype(np.int32))
            bounds.append(own[1:] + bounds[-1][-1])
            at, size = i + 1, 0
    return np.concatenate(parts), np.concatenate(bounds)


@dataclass
class Model:
    table: np.ndarray  #: embeddings
    kernels: list[np.ndarray]  #: for each width (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    base: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each text, 0 at least."""
        n = len(bounds) - 1
        result = np.zeros((n, FILTERS * len(WIDTHS)), dtype=np.float32)
        if not len(rows):
            return result
        x = self.table[rows[:, 0]]
        for i in range(1, rows.shape[1]):
            x += self.table[rows[:, i]]
        doc = np.repeat(np.arange(n), np.diff(bounds))
        some = np.flatnonzero(np.diff(bounds))
        for k, width in enumerate(WIDTHS):
            if len(x) < width:
                continue
            z = np.full((len(x), FILTERS), -np.inf, dtype=np.float32)
            m = len(x) - width + 1
            z[:m] = self.bias[k]
            for j in range(width):
                z[:m] += x[j : j + m] @ self.kernels[k][j]
            z[:m][doc[:m] != doc[width - 1 :]] = -np.inf
            result[some, k * FILTERS : (k + 1) * FILTERS] = np.maximum(np.maximum.reduceat(z, bounds[some], axis=0), 0)
        return result

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.scores_of(*features(texts))

    def scores_of(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.round(_sigmoid(self.pooled(rows, bounds).astype(np.float64) @ self.out + self.base), 6)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Adagrad:
    def __init__(self, rate: float):
        self.rate, self.sums = rate, {}

    def step(self, name: str, value: np.ndarray, gradient: np.ndarray, rows: np.ndarray | None = None) -> None:
        if name not in self.sums:
            self.sums[name] = np.full(value.shape, 1e-4, dtype=np.float32)
        total = self.sums[name]
        if rows is None:
            total += gradient**2
            value -= self.rate * gradient / np.sqrt(total)
        else:
            total[rows] += gradient**2
            value[rows] -= self.rate * gradient / np.sqrt(total[rows])


def untrained(rng: np.random.Generator, base: float = 0.0) -> Model:
    return Model(
        rng.normal(0, 0.05, ((1 + len(PREFIXES)) * BUCKETS, DIM)).astype(np.float32),
        [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS],
        rng.normal(0.3, 0.1, FILTERS * len(WIDTHS)).astype(np.float32),
        base,
    )


def train(texts: list[str], toxic: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.05, seed: int = SEED) -> Model:
    rng = np.random.default_rng(seed)
    model = untrained(rng)
    share = float(np.mean(toxic)) if len(toxic) else 0.0
    if share in (0.0, 1.0):
        model.out[:], model.base = 0, 30.0 * (2 * share - 1)
        return model
    rows, bounds = all_features(texts)
    step, base = _Adagrad(rate), np.array([np.log(share / (1 - share))], dtype=np.float32)
    for _ in range(epochs):
        _learn(model, base, step, rows, bounds, rng.permutation(len(texts)), toxic, batch, rng)
    model.base = float(base[0])
    return model


def _learn(model: Model, base: np.ndarray, step: _Adagrad, rows: np.ndarray, bounds: np.ndarray, order: np.ndarray, toxic: np.ndarray, batch: int, rng: np.random.Generator) -> None:
    at = 0
    while at < len(order):
        fits = np.searchsorted(np.cumsum(np.diff(bounds)[order[at : at + batch]]), STEP_WORDS, side="right")
        members = order[at : at + max(1, int(fits))]
        _update(model, base, step, rows, bounds, members, toxic, rng)
        at += len(members)


def _update(model: Model, base: np.ndarray, step: _Adagrad, rows: np.ndarray, bounds: np.ndarray, members: np.ndarray, toxic: np.ndarray, rng: np.random.Generator) -> None:
    own = [rows[bounds[d] : bounds[d + 1]] for d in members]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in own])])
    flat = np.concatenate(own)
    chance = rng.random(len(flat))  # at times a word is known by its beginning only, as words never seen before are
    shown = np.stack([chance >= 0.7, np.ones(len(flat), dtype=bool), chance >= 0.5], axis=1)
    x = model.table[flat[:, 1]]
    for i in (0, 2):
        at = np.flatnonzero(shown[:, i])
        x[at] += model.table[flat[at, i]]
    pooled = np.zeros((len(members), FILTERS * len(WIDTHS)), dtype=np.float32)
    winner = np.full(pooled.shape, -1, dtype=np.int64)
    for k, width in enumerate(WIDTHS):
        m = len(x) - width + 1
        if m <= 0:
            continue
        z = model.bias[k] + sum(x[j : j + m] @ model.kernels[k][j] for j in range(width))
        for d in range(len(members)):
            a, b = ends[d], ends[d + 1] - width + 1
            if b > a:
                best = z[a:b].argmax(axis=0)
                value = z[a + best, np.arange(FILTERS)]
                columns = slice(k * FILTERS, (k + 1) * FILTERS)
                pooled[d, columns] = np.maximum(value, 0)
                winner[d, columns] = np.where(value > 0, a + best, -1)
    error = (_sigmoid(pooled @ model.out + base[0]) - toxic[members]).astype(np.float32) / len(members)
    back = np.where(winner >= 0, error[:, None] * model.out[None, :], 0).astype(np.float32)
    step.step("out", model.out, pooled.T @ error + 1e-5 * model.out)
    step.step("base", base, np.array([error.sum()], dtype=np.float32))
    words_at, gradients = [], []
    for k, width in enumerate(WIDTHS):
        columns = slice(k * FILTERS, (k + 1) * FILTERS)
        d, f = np.nonzero(winner[:, columns] >= 0)
        place, g = winner[:, columns][d, f], back[:, columns][d, f]
        kernel = np.zeros_like(model.kernels[k])
        for j in range(width):
            np.add.at(kernel[j].T, f, g[:, None] * x[place + j])
            words_at.append(place + j)
            gradients.append(g[:, None] * model.kernels[k][j].T[f])
        step.step(f"bias{k}", model.bias[k], np.bincount(f, weights=g, minlength=FILTERS).astype(np.float32))
        step.step(f"kernel{k}", model.kernels[k], kernel)
    place, gradient = np.concatenate(words_at), np.concatenate(gradients)
    if len(place):
        part = shown[place].ravel()
        used, inverse = np.unique(flat[place].ravel()[part], return_inverse=True)
        total = np.zeros((len(used), DIM), dtype=np.float32)
        np.add.at(total, inverse.ravel(), np.repeat(gradient, flat.shape[1], axis=0)[part])
        step.step("table", model.table, total, used)


def calibrate(model: Model, texts: list[str], toxic: np.ndarray, langs: list[str | None], least: int = 20, weights: tuple[float, float] = (1.0, 1.0)) -> dict[str, float]:
    """For each language with enough toxic samples the threshold of best F1; of equals that nearest to 0.5.

    `weights` are the rows that a sampled clean and a sampled toxic row stand for.
    """
    scores = np.concatenate([np.zeros(0), *[model.scores(texts[at : at + 50]) for at in range(0, len(texts), 50)]])
    return best_thresholds(_counted(scores, toxic, langs), least, weights)


#: Thresholds that calibration chooses from.
GRID = np.round(np.linspace(0.05, 0.95, 19), 2)


def _counted(scores: np.ndarray, toxic: np.ndarray, langs: list[str | None]) -> dict[str, np.ndarray]:
    """For each language how many clean and how many toxic rows (2 rows of counts) reach so many thresholds of the grid."""
    reach, out = np.searchsorted(GRID, scores, side="right"), {}
    for lang in set(langs):
        at = np.array([x == lang for x in langs])
        out[lang] = np.stack([np.bincount(reach[at & (toxic == kind)], minlength=len(GRID) + 1) for kind in (0, 1)])
    return out


def best_thresholds(counts: dict[str, np.ndarray], least: int = 20, weights: tuple[float, float] = (1.0, 1.0)) -> dict[str, float]:
    out = {}
    for lang, own in sorted(counts.items(), key=lambda p: (p[0] is not None, p[0])):
        if own[1].sum() < least:
            continue
        clean, hit = (w * (own[kind].sum() - np.cumsum(own[kind])[:-1]) for kind, w in enumerate(weights))  # at or above each threshold
        f1 = 2 * hit / np.maximum(clean + hit + weights[1] * own[1].sum(), 1)
        out[lang] = float(min(zip(GRID, f1, strict=True), key=lambda p: (-p[1], abs(p[0] - 0.5)))[0])
    return out


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, positives: int | None = None, negatives: int | None = None, class_chars: int = 4_000_000, passes: int = 6) -> Model:
    """The model trained on all learnable rows, in tasks, and thresholds by its twin. Rows reach the driver only where all of them have `START_CHARS` characters at most, or where a caller asks for a
    starting point of few rows; else averaged changes of the model and counts."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # shuffled at every size: the rows of a shard meet in one file, in the order of their hashes
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-chars // SHARD_CHARS))
    joined = written(texts.hint("merge").join(known.hint("merge"), "doc_id"), "toxicity-known")  # by itself, so that the files of two shuffles never lie side by side
    rows = joined.withColumn("h", F.xxhash64("doc_id")).withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    rows = written(_hashed(rows.repartition(shards, "shard").sortWithinPartitions("shard", "h", "doc_id", "text", "lang")), "toxicity-rows")
    kinds = rows.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).collect()
    every = {r["toxic"]: r["n"] for r in kinds}
    known_kinds = all(every.get(kind) for kind in (0, 1))
    if not known_kinds:
        model = untrained(np.random.default_rng(SEED), 30.0 if every.get(1) else -30.0)
        model.out[:] = 0
    elif positives is not None or negatives is not None or sum(r["chars"] for r in kinds) <= START_CHARS:
        model = _start(joined.withColumn("h", F.xxhash64("doc_id")), every, positives, negatives, class_chars)
    else:
        model = _even(every)
    release(joined)
    twin = model
    for k in range(passes if known_kinds else 0):  # the same passes with and without the rows that calibrate
        twin = _one_pass(rows.where(~_calibrates(F.col("doc_id"))), twin, k)
        model = _one_pass(rows, model, k)
    model.thresholds = best_thresholds(_calibration(rows.where(_calibrates(F.col("doc_id"))), twin))
    release(rows)
    return model


def _hashed(rows: DataFrame) -> DataFrame:
    """The rows with `words`, the hashed parts of their words (16 bits each) instead of the text, and its number of characters; all passes read them."""
    kept = ["doc_id", "lang", "toxic", "shard", "chars"]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in text_slices(batches, "text", STEP_BYTES):
            found, bounds = features(texts_of(batch))
            parts = (found - BUCKETS * np.arange(found.shape[1])).astype(np.uint16)
            words = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((bounds * parts.shape[1] * 2).astype(np.int32)), pa.py_buffer(parts.tobytes())])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], words], [*kept, "words"])

    sized = rows.withColumn("chars", F.length("text"))
    return sized.mapInArrow(run, T.StructType([*[sized.schema[c] for c in kept], T.StructField("words", T.BinaryType())]))


def _hashed_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """What `features` gives for the texts of these rows."""
    width = 1 + len(PREFIXES)
    parts = np.frombuffer(b"".join(batch.column("words").to_pylist()), dtype=np.uint16).reshape(-1, width)
    sizes = pc.binary_length(batch.column("words")).to_numpy(zero_copy_only=False) // (2 * width)
    return parts.astype(np.int64) + BUCKETS * np.arange(width), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _even(every: dict[int, int]) -> Model:
    """Random parameters, and a base that stands for the classes' shares among all rows."""
    return untrained(np.random.default_rng(SEED), float(np.log(every[1] / every[0])))


def _start(rows: DataFrame, every: dict[int, int], positives: int | None, negatives: int | None, class_chars: int) -> Model:
    """A model from all rows but those that calibrate, or from so many of each class; its base stands for the classes' shares among all rows."""
    some = rows.where(~_calibrates(F.col("doc_id")))
    if positives is not None or negatives is not None:
        taken = []
        for kind, n in ((1, positives), (0, negatives)):
            sizes = rows.where(F.col("toxic") == kind).select("h", "doc_id", F.length("text").alias("n")).orderBy("h", "doc_id")
            total = 0
            for r in (sizes if n is None else sizes.limit(n)).toLocalIterator():
                if total >= class_chars:
                    break
                taken.append(r["doc_id"])
                total += r["n"]
        some = some.where(F.col("doc_id").isin(taken)) if taken else some.where("false")
    first = sorted(some.select("doc_id", "text", "toxic").collect(), key=lambda r: (r["doc_id"], r["text"]))
    toxic = np.array([r["toxic"] for r in first], dtype=np.float32)
    stand = [every[kind] / max(int((toxic == kind).sum()), 1) for kind in (0, 1)]
    if not 0 < toxic.sum() < len(toxic):
        return _even(every)
    model = train([r["text"] for r in first], toxic)
    model.base += float(np.log(stand[1] / stand[0]))
    return model


def _calibrates(doc_id):
    """Whether a row (a number or a column) is kept for the thresholds."""
    return doc_id // 7 % 10 == 0 if isinstance(doc_id, int) else F.pmod(F.floor(doc_id / 7), F.lit(10)) == 0


def _for_tasks(rows: DataFrame, model: Model) -> Shared:
    """The model as tasks read it. Neither it nor its changes (12 MB each) pass through the driver's JVM, whose heap a broadcast and rows for every pass fill."""
    return Shared(scratch(rows.sparkSession, "toxicity-model"), model)


def _small(model: Model) -> np.ndarray:
    """All parameters but the table, in a row."""
    return np.concatenate([*[x.ravel() for x in (*model.kernels, *model.bias, model.out)], [model.base]]).astype(np.float64)


def _moved(model: Model, small: np.ndarray, table: np.ndarray) -> Model:
    parts, at = [], 0
    for x in (*model.kernels, *model.bias, model.out):
        parts.append(small[at : at + x.size].reshape(x.shape).astype(np.float32))
        at += x.size
    n = len(WIDTHS)
    return Model(table, parts[:n], parts[n : 2 * n], parts[2 * n], float(small[-1]))


def _one_pass(rows: DataFrame, model: Model, number: int, batch: int = 32, rate: float = 0.05) -> Model:
    """Every shard trains from the model; the changes of all shards are averaged."""
    sent = _for_tasks(rows, model)
    kinds = pa.schema([("slot", pa.int32()), ("n", pa.int64()), ("place", pa.binary()), ("change", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]):
        shard, seen, own = None, 0, None

        def changes():
            before, now = sent.value, _moved(sent.value, np.append(_small(own)[:-1], base[0]), own.table)
            out = [(-1, seen, b"", (_small(now) - _small(before)).tobytes())]
            used = np.flatnonzero((now.table != before.table).any(axis=1))
            for at in np.split(used, np.flatnonzero(np.diff(used // SLOT)) + 1) if len(used) else []:
                out.append((int(at[0] // SLOT), seen, (at % SLOT).astype(np.uint16).tobytes(), (now.table[at] - before.table[at]).tobytes()))
            return pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in out], kinds)

        for whole in text_slices(batches, "words", STEP_BYTES):
            shards = whole.column("shard").to_numpy()
            for part in np.split(np.arange(len(shards)), np.flatnonzero(np.diff(shards)) + 1):
                if shards[part[0]] != shard:
                    if seen:
                        yield changes()
                    shard, seen = int(shards[part[0]]), 0
                    own, step, rng = _moved(sent.value, _small(sent.value), sent.value.table.copy()), _Adagrad(rate), np.random.default_rng([17, number, shard])
                    base = np.array([sent.value.base], dtype=np.float32)
                some = whole.slice(int(part[0]), len(part))
                found, bounds = _hashed_words(some)
                _learn(own, base, step, found, bounds, rng.permutation(len(part)), some.column("toxic").to_numpy().astype(np.float32), batch, rng)
                seen += len(part)
        if seen:
            yield changes()

    def averaged(groups):
        slot, n = groups.column("slot")[0].as_py(), np.array(groups.column("n").to_pylist(), dtype=np.float64)
        order = sorted(range(len(n)), key=lambda i: (n[i], groups.column("change")[i].as_py()))  # sums do not depend on which task came first
        if slot < 0:
            total = sum(n[i] * np.frombuffer(groups.column("change")[i].as_py()) for i in order) / n.sum()
        else:
            total, times = np.zeros((SLOT, DIM)), np.zeros((SLOT, 1))
            for i in order:
                at = np.frombuffer(groups.column("place")[i].as_py(), dtype=np.uint16)
                total[at] += np.frombuffer(groups.column("change")[i].as_py(), dtype=np.float32).reshape(-1, DIM)
                times[at] += 1
            total = total / np.maximum(times, 1)
        return pa.table({"slot": pa.array([slot], pa.int32()), "change": pa.array([total.astype(np.float64 if slot < 0 else np.float32).tobytes()], pa.binary())})

    made = written(rows.select("shard", "words", "toxic").mapInArrow(run, "slot int, n long, place binary, change binary"), "toxicity-changes")
    mean = written(made.groupBy("slot").applyInArrow(averaged, "slot int, change binary"), "toxicity-means")
    table, small = model.table.copy(), _small(model)
    for part in parquet_tables(mean._scratch):
        for slot, change in zip(part.column("slot").to_pylist(), part.column("change"), strict=True):
            if slot < 0:
                small = small + np.frombuffer(change.as_buffer())
            else:
                table[slot * SLOT : (slot + 1) * SLOT] += np.frombuffer(change.as_buffer(), dtype=np.float32).reshape(-1, DIM)
    release(made, mean)
    clear_scratch(rows.sparkSession, [sent.folder])
    return _moved(model, small, table)


def _calibration(rows: DataFrame, model: Model) -> dict[str, np.ndarray]:
    """What `_counted` counts, over all rows."""
    sent = _for_tasks(rows, model)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in text_slices(batches, "words", STEP_BYTES):
            counts = _counted(sent.value.scores_of(*_hashed_words(batch)), batch.column("toxic").to_numpy(), batch.column("lang").to_pylist())
            found = [(lang, kind, at, int(own[kind, at])) for lang, own in counts.items() for kind, at in zip(*np.nonzero(own), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate([pa.string(), pa.int32(), pa.int32(), pa.int64()])], ["lang", "kind", "reach", "n"])

    out: dict[str, np.ndarray] = {}
    for r in rows.select("words", "toxic", "lang").mapInArrow(run, "lang string, kind int, reach int, n long").groupBy("lang", "kind", "reach").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r["lang"], np.zeros((2, len(GRID) + 1), dtype=np.int64))[r["kind"], r["reach"]] = r["n"]
    clear_scratch(rows.sparkSession, [sent.folder])
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted (score of 0.5 or more), flagged (the threshold of the document's language)."""
    sent = _for_tasks(docs, model)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in text_slices(batches, "text", STEP_BYTES):
            scores = sent.value.scores(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array(flags(scores, batch.column("lang").to_pylist(), sent.value))], ["doc_id", "score", "flagged"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    out = rows.mapInArrow(run, "doc_id long, score double, flagged boolean")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "flagged")


def flags(scores: np.ndarray, langs: list[str | None], model: Model) -> np.ndarray:
    return scores >= np.array([model.thresholds.get(x, 0.5) for x in langs], dtype=float)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not flagged, with all their columns."""
    sent = _for_tasks(docs, model)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in text_slices(batches, "text", STEP_BYTES):
            yield batch.filter(pa.array(~flags(sent.value.scores(texts_of(batch)), batch.column("lang").to_pylist(), sent.value)))

    return docs.mapInArrow(run, docs.schema)
