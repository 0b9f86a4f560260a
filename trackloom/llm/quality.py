"""Quality rules (operator 1).

Base rules count words, symbols, repeated lines and repeated 8-word windows. What passes them is
judged by the method: hashed word n-grams (one and two words) are counted in a trusted target
(documents labelled good) and in the raw corpus; a document's score is the mean log-likelihood
ratio of its n-grams under the two multinomials, so length cancels out. A document is kept if its
score reaches the threshold, which is a low quantile of the scores of the target itself.

The raw counts cover every document, the target and the threshold every document labelled good: the
ids meet the documents in a join. Counts leave the tasks as one row for each bucket that occurs; what
reaches the driver is one row a bucket. Documents are scored once; the quantile is taken over their
scores by ten-thousandths (an error of 0.00005 at most), of which there are few at any size.

Edge cases: null text = empty; no word = base_failed, score 0; null doc_id is kept as null (it is
never in the target); repeated rows are scored one by one; an empty table, or no labels, gives
ratios of 0; further columns, also of the same names as results, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, texts_of, written
from .wordhash import SPACE, Words, mix, words

BUCKETS = 1 << 16
WINDOW = 8
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_ASCII_SPACE = " \t\n\v\f\r"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, llr double, kept boolean"
)


def repeated_words(w: Words, window: int = WINDOW) -> np.ndarray:
    """For each text, its words that lie in a window found at least twice in the same text."""
    at, grams = w.grams(window)
    out = np.zeros(len(w.bounds) - 1, dtype=np.int64)
    if len(at) == 0:
        return out
    with np.errstate(over="ignore"):
        keys = grams + mix(w.doc[at].astype(np.uint64) + np.uint64(1))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice) == 0:
        return out
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    hit = at[twice[place] == keys]
    cover = np.zeros(len(w.hashes) + 1, dtype=np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    return w.per_word_sum((np.cumsum(cover)[:-1] > 0).astype(np.int64))


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_ASCII_SPACE)]
    return len(lines) - len(set(lines))


def buckets(w: Words, n: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the one-word and two-word n-grams, each with the text it belongs to."""
    at, pairs = w.grams(2)
    doc = w.doc
    salt = np.uint64(0x5851F42D4C957F2D)
    ids = np.concatenate([mix(w.hashes ^ salt), pairs]) % np.uint64(n)
    return ids.astype(np.int64), np.concatenate([doc, doc[at]])


def ngram_counts(docs: DataFrame, target_ids: DataFrame | np.ndarray, n: int = BUCKETS) -> DataFrame:
    """bucket, raw, target: n-grams of all documents and of those whose id is in `target_ids` (distinct `doc_id`, or a small array)."""
    if isinstance(target_ids, np.ndarray):
        target_ids = docs.sparkSession.createDataFrame([(int(i),) for i in target_ids], "doc_id long")

    def count(batches):
        raw, target = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for batch in text_slices(batches, "text"):
            ids, doc = buckets(words(texts_of(batch)), n)
            raw += np.bincount(ids, minlength=n)
            known = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
            target += np.bincount(ids[known[doc]], minlength=n)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = target_ids.select("doc_id", F.lit(True).alias("good")).hint("merge")  # grows with the input: never sent whole to tasks, and one plan at every size
    marked = rows.join(known, "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    parts = marked.mapInArrow(count, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, n: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw by bucket, with one added to each count; at most `n` rows come to the driver."""
    raw, target = np.zeros(n), np.zeros(n)
    for r in counts.toLocalIterator():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if target.sum() == 0:
        return np.zeros(n)
    return np.log((target + 1) / (target.sum() + n)) - np.log((raw + 1) / (raw.sum() + n))


def score(docs: DataFrame, ratios: np.ndarray, threshold: float) -> DataFrame:
    """One row of SCHEMA for each document."""
    n = len(ratios)

    def run(batches):
        for batch in text_slices(batches, "text"):
            texts = texts_of(batch)
            w = words(texts)
            n_words = np.diff(w.bounds)
            lead = (w.data & 0xC0) != 0x80
            repeats = repeated_words(w)
            ids, doc = buckets(w, n)
            total = np.bincount(doc, weights=ratios[ids], minlength=len(texts))
            llr = np.round(total / np.maximum(np.bincount(doc, minlength=len(texts)), 1), 9)
            failed = (n_words < 20) | (100 * repeats > 30 * n_words)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n_words.astype(np.int64)),
                    pa.array(w.per_text(lead & ~SPACE[w.data])),
                    pa.array(w.per_text(SYMBOLS[w.data])),
                    pa.array([repeated_lines(t) for t in texts], pa.int64()),
                    pa.array(repeats.astype(np.int64)),
                    pa.array(failed),
                    pa.array(llr),
                    pa.array(~failed & (llr >= threshold)),
                ],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The distinct ids labelled good."""
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def quality_rules(docs: DataFrame, labels: DataFrame, keep_target: float = 0.995, slack: float = 0.02, n: int = BUCKETS) -> DataFrame:
    """Base counts, the score and the verdict for every document.

    The threshold is the score that `keep_target` of the target documents (those that pass the
    base rules) reach, less `slack`; without a target it is 0.
    """
    good = written(trusted_ids(labels), "good-ids")
    ratios = log_ratios(written(ngram_counts(docs, good, n), "ngram-counts"), n)
    scored = written(score(docs, ratios, 0.0).drop("kept"), "quality-scores")
    threshold = 0.0
    if ratios.any():
        known = scored.where(~F.col("base_failed")).join(good, "doc_id", "left_semi").groupBy(F.round("llr", 4).alias("llr")).count()
        low = known.agg(F.percentile("llr", F.lit(1 - keep_target), F.col("count"))).first()[0]
        threshold = round((low if low is not None else 0.0) - slack, 6)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
