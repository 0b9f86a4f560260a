"""Secret scans (operator 6): fixed patterns first, then inferred grammars over all candidates.

The patterns (assignments, access keys, long hex runs) give the base spans, which stay. What they
match are the labelled credentials: for each kind all distinct values go into a prefix tree whose
statistically compatible states are merged to a
probabilistic automaton. A further automaton is learned from all distinct ordinary long tokens. Automata see classes of characters only, so
values are counted by shape, in a table; an automaton grows by steps of at most `batch_chars` characters (and one value): tasks send every shape through it, those
of smallest hashes among the shapes that leave it are added, until none leaves it. Its counts are then those of all values, and
so are the levels and the threshold. Then every
candidate (a maximal run of the credential alphabet of at least `min_length` characters) gets
the log-likelihood ratio of its best credential automaton against the ordinary one, by
character; candidates above the threshold that touch no base span become spans of kind `format`.
The threshold is a high quantile of the ratios of ordinary tokens that were held out, and not
less than `least_ratio`. Credentials that nobody labelled are among the ordinary tokens, and must neither be learned as ordinary nor set
the threshold. So every token that a credential automaton expects nearly as much as values that it has not seen is first set aside (but never
letters of one case or numbers, which are words and amounts), however many there are. The ordinary automaton is learned from
the rest; what it explains of the tokens set aside comes back, and it is learned again, until nothing changes. What stays aside is taken for unlabelled credentials.

Candidates of less than `min_length` characters are not scored: a format so short is not told from words and numbers by classes
of characters (the patterns still find such values where they are labelled).

Positions are code points, ends exclusive. Edge cases: null text = empty; null doc_id stays null;
repeated rows are scanned one by one; with an empty table, or no credential to learn from, there
are base spans only; further columns are ignored by `find_secrets` and kept by `redact`, which needs
no n_chars but counts it again, in its own type, where it is a number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .automata import BLIND, CLASSES, Automaton
from .common import release, text_slices, texts_of, written

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs of 32 and more
KINDS = ("assign", "access", "hex", "format")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]+")
LEAST = 16
_ALPHABET = np.zeros(256, dtype=bool)
_ALPHABET[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
SPANS = "spans array<struct<kind:string,start:int,end:int,score:double>>"


def with_long_run(texts: list[str], least: int = LEAST) -> list[bool]:
    """Whether a text has a run of the credential alphabet of `least` characters; all at once in numpy."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    flags = np.zeros(int(ends[-1]) + 1 if len(raw) else 1, dtype=np.int8)
    if len(raw):
        flags[1:] = _ALPHABET[np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)]
    edge = np.diff(flags)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = start[end - start >= least]
    out = np.zeros(len(raw), dtype=bool)
    out[np.searchsorted(ends, long, side="right")] = True
    return out.tolist()


def base_spans(text: str, runs: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches; `runs` False: the text is known to have no long run."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "key" in low or not low.isascii():
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if runs:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]], least: int = LEAST) -> Iterator[re.Match]:
    """Long runs of the alphabet that no base span touches; runs and spans are swept once, side by side."""
    reach = at = 0
    for m in CANDIDATE.finditer(text):
        if m.end() - m.start() >= least:
            while at < len(base) and base[at][0] < m.end():
                reach = max(reach, base[at][2])
                at += 1
            if reach <= m.start():
                yield m


def _values(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[str, str]]:
    for start, kind, end in base:
        match = text[start:end]
        yield KINDS[kind], ASSIGN.fullmatch(match)[2] if kind == 0 else match


def samples(docs: DataFrame, sample_size: int, ordinary_size: int, min_length: int, sample_chars: int) -> dict[str, list[str]]:
    """A look at the values, for readers; `train` learns from all of them. Distinct values by kind, those of smallest hashes: at most `sample_size` of each and `ordinary_size`
    ordinary ones, until they have `sample_chars` characters. A task gives no more of each than that."""
    most = {**dict.fromkeys(KINDS[:3], sample_size), "ordinary": ordinary_size}

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[str, set[tuple[int, str]]] = {kind: set() for kind in most}

        def note(kind: str, value: str) -> None:
            if len(value) > sample_chars:
                return
            held[kind].add((xxhash.xxh64_intdigest(value, 42), value))
            if len(held[kind]) >= 2 * most[kind] + 1_000:
                held[kind] = set(sorted(held[kind])[: most[kind]])

        for batch in text_slices(batches, "text"):
            texts = texts_of(batch)
            for text, runs in zip(texts, with_long_run(texts, min(LEAST, min_length)), strict=True):
                base = base_spans(text, runs)
                for kind, value in _values(text, base):
                    note(kind, value)
                if runs:
                    for m in candidates(text, base, min_length):
                        note("ordinary", m[0])
        for kind, found in held.items():
            for h, value in sorted(found)[: most[kind]]:
                yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([h - (1 << 63)], pa.int64()), pa.array([value])], ["kind", "hash", "value"])

    values = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind string, hash long, value string").distinct()
    values = written(values, "secret-values").withColumn("n", F.length("value"))
    out = {}
    for kind, size in most.items():
        chosen = values.where(F.col("kind") == kind).orderBy("hash", "value").limit(size)
        chars = list(accumulate((r["n"] for r in chosen.select("hash", "value", "n").orderBy("hash", "value").select("n").collect()), initial=0))
        fits = sum(c < sample_chars for c in chars[:-1])
        out[kind] = [r["value"] for r in chosen.orderBy("hash", "value").limit(fits).collect()]
    return out


#: How much likelier by character than blind guessing a token must be to be set aside.
_MARGIN = 0.1
#: Words and amounts.
_PLAIN = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+|[0-9.]+")


def _level(values: list[str]) -> float:
    """How likely by character an automaton finds practically all values of its kind that it has not seen: below their lowest
    hundredth by half of what that is below the middle; but more than blind guessing."""
    halves = (values[::2], values[1::2]) if len(values) > 1 else (values, values)
    seen = [a.log_likelihood(x) / (len(x) + 1) for own, others in (halves, halves[::-1]) for a in [Automaton(own)] for x in others]
    low, middle = np.quantile(seen, [0.01, 0.5])
    return max(float(1.5 * low - 0.5 * middle), BLIND + _MARGIN)


class Formats:
    """Automata of the credential kinds against that of ordinary tokens."""

    def __init__(self, samples: dict[str, list[str]], least_ratio: float = 0.3, quantile: float = 0.999):
        labelled = [samples[k] for k in KINDS[:3] if samples.get(k)]
        self.kinds, levels = [Automaton(values) for values in labelled], [_level(values) for values in labelled]
        tokens = samples.get("ordinary", [])
        expected = lambda x: any(a.log_likelihood(x) / (len(x) + 1) >= level for a, level in zip(self.kinds, levels, strict=True))
        aside = {x for x in tokens if not _PLAIN.fullmatch(x) and expected(x)}
        while True:
            ordinary = [x for x in tokens if x not in aside]
            self.ordinary = Automaton(self._shouted(ordinary))
            back = {x for x in aside if self.ratio(x) <= least_ratio / 2} if ordinary else aside  # without any other token nothing tells them apart
            if not back:
                break
            aside -= back
        held_out = []
        for own, others in ((0, 1), (1, 0)) if self.kinds else ():
            half = Automaton(self._shouted(ordinary[own::2]))
            held_out += [self.ratio(x, half) for x in self._shouted(ordinary[others::2])]
        self.threshold = max(least_ratio, float(np.quantile(held_out, quantile)) if held_out else 0.0)

    @classmethod
    def of(cls, kinds: list[Automaton], ordinary: Automaton, threshold: float) -> Formats:
        own = cls.__new__(cls)
        own.kinds, own.ordinary, own.threshold = kinds, ordinary, threshold
        return own

    @staticmethod
    def _shouted(words: list[str]) -> list[str]:
        """Ordinary words are shouted at times."""
        return [x for word in words for x in (word, word.upper())]

    def ratio(self, text: str, ordinary: Automaton | None = None) -> float:
        best = max(a.log_likelihood(text) for a in self.kinds)
        return (best - (ordinary or self.ordinary).log_likelihood(text)) / (len(text) + 1)


def all_spans(text: str, runs: bool, formats: Formats, min_length: int = LEAST) -> list[tuple[int, int, int, float | None]]:
    base = base_spans(text, runs)
    found: list[tuple[int, int, int, float | None]] = [(*x, None) for x in base]
    if runs and formats.kinds:
        for m in candidates(text, base, min_length):
            ratio = formats.ratio(m[0])
            if ratio > formats.threshold:
                found.append((m.start(), 3, m.end(), round(ratio, 9)))
    return sorted(found, key=lambda x: x[:2])


#: A letter for each class of characters: a shape is a value with classes for characters.
_LETTERS = "abcdefghijk"
_CAPITALS = str.maketrans("bc", "de")
#: Words and amounts, as shapes.
_PLAIN_SHAPE = re.compile(r"[bc]+|[de][bc]*|[de]+|[ai]+")


def shapes(docs: DataFrame, min_length: int) -> DataFrame:
    """kind (a credential kind or `ordinary`), shape, h, and how many distinct values have it: `even` and `odd` ones by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in text_slices(batches, "text"):
            texts, found = texts_of(batch), set()
            for text, runs in zip(texts, with_long_run(texts, min(LEAST, min_length)), strict=True):
                base = base_spans(text, runs)
                found.update(_values(text, base))
                if runs:
                    found.update(("ordinary", m[0]) for m in candidates(text, base, min_length))
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["kind", "value"])

    values = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind string, value string").distinct()
    shape = F.translate("value", "".join(CLASSES), "".join(x * len(group) for x, group in zip(_LETTERS, CLASSES, strict=True)))
    odd = F.pmod(F.xxhash64("value"), F.lit(2))
    return values.groupBy("kind", shape.alias("shape")).agg(F.sum(1 - odd).alias("even"), F.sum(odd).alias("odd")).withColumn("h", F.xxhash64("shape"))


def _symbols(shape: str) -> list[int]:
    return [ord(x) - 97 for x in shape]


def _shown(kind: str, shape: str) -> tuple[str, ...]:
    """Ordinary words are shouted at times."""
    return (shape, shape.translate(_CAPITALS)) if kind == "ordinary" else (shape,)


#: The parts of the values that an automaton is learned from: all, or a half.
_PARTS = {"all": (1, 1), "even": (1, 0), "odd": (0, 1)}


def learned(rows: DataFrame, names: list[tuple[str, str]], batch_chars: int) -> dict[tuple[str, str], Automaton]:
    """Automata by (kind, part) from the table of shapes; parts that have no value get none."""
    spark, done, todo = rows.sparkSession, {}, {name: Automaton(()) for name in names}
    while todo:
        sent = spark.sparkContext.broadcast(todo)

        def run(batches: Iterator[pa.RecordBatch], sent=sent):
            counts: dict[tuple, int] = {}
            lost: dict[tuple[str, str], list] = {name: [] for name in sent.value}
            for batch in batches:
                for r in batch.to_pylist():
                    for (kind, part), own in sent.value.items():
                        times = r["even"] * _PARTS[part][0] + r["odd"] * _PARTS[part][1]
                        if kind != r["kind"] or not times:
                            continue
                        paths = [(own.walk(symbols), symbols) for symbols in map(_symbols, _shown(kind, r["shape"]))]
                        if any(path is None for path, _ in paths):
                            counts[kind, part, -1, 0] = 1
                            lost[kind, part].append((r["h"], r["shape"], times))
                            if len(lost[kind, part]) > 2 * batch_chars:
                                lost[kind, part] = sorted(lost[kind, part])[:batch_chars]  # a shape has a character at least
                            continue
                        for path, symbols in paths:
                            for at, x in zip(path, [*symbols, -1], strict=True):
                                counts[kind, part, at, x] = counts.get((kind, part, at, x), 0) + times
            out = [(*k, n, None, None) for k, n in counts.items()]
            for (kind, part), own in lost.items():
                own.sort()
                before = accumulate((len(shape) for _, shape, _ in own), initial=0)
                out += [(kind, part, -2, 0, times, h, shape) for (h, shape, times), chars in zip(own, before, strict=False) if chars < batch_chars]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["kind", "part", "state", "symbol", "n", "h", "shape"])

        found = written(rows.select("kind", "shape", "h", "even", "odd").mapInArrow(run, "kind string, part string, state int, symbol int, n long, h long, shape string"), "secret-steps")
        counts: dict[tuple[str, str], dict[tuple[int, int], int]] = {name: {} for name in todo}
        for r in found.where("state >= -1").groupBy("kind", "part", "state", "symbol").agg(F.sum("n").alias("n")).collect():
            counts[r["kind"], r["part"]][r["state"], r["symbol"]] = r["n"]
        for name, own in list(todo.items()):
            more = counts[name].pop((-1, 0), 0)
            own.recount(counts[name])
            if more:
                first, chars = [], 0
                for r in found.where((F.col("state") == -2) & (F.col("kind") == name[0]) & (F.col("part") == name[1])).orderBy("h", "shape").select("shape", "n").limit(batch_chars).toLocalIterator():
                    first += [(_symbols(shape), r["n"]) for shape in _shown(name[0], r["shape"])]
                    chars += len(r["shape"])
                    if chars >= batch_chars:
                        break
                own.grow(first)
            else:
                del todo[name]
                if own.seen[0]:
                    done[name] = own
        release(found)
        sent.unpersist()
    return done


def _measured(rows: DataFrame, measure) -> DataFrame:
    """The rows with `measure(kind, shape, even, odd)`, a list of (value rounded to four places, how many values it stands for)."""

    def run(batches: Iterator[pa.RecordBatch]):
        kind = pa.list_(pa.struct([("x", pa.float64()), ("n", pa.int64())]))
        for batch in batches:
            found = [[{"x": round(x, 4), "n": n} for x, n in measure(r["kind"], r["shape"], r["even"], r["odd"]) if n] for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "found"])

    return rows.mapInArrow(run, "kind string, shape string, even long, odd long, h long, found array<struct<x:double,n:long>>")


def _by_char(own: Automaton, shape: str) -> float:
    return own.chance(_symbols(shape)) / (len(shape) + 1)


def _quantiles(measured: DataFrame, shares: list[float]) -> dict[str, list[float]]:
    rows = measured.select("kind", F.inline("found")).groupBy("kind", "x").agg(F.sum("n").alias("n"))
    return {r["kind"]: r["q"] for r in rows.groupBy("kind").agg(F.percentile("x", F.array(*map(F.lit, shares)), F.col("n")).alias("q")).collect()}


def _halves(automata: dict[tuple[str, str], Automaton], kind: str) -> dict[str, Automaton]:
    """For the even and the odd values the automaton that has not seen them (where there is none: that of all)."""
    return {"even": automata.get((kind, "odd"), automata.get((kind, "all"))), "odd": automata.get((kind, "even"), automata.get((kind, "all")))}


def train(docs: DataFrame, min_length: int = LEAST, batch_chars: int = 100_000, least_ratio: float = 0.3, quantile: float = 0.999) -> Formats:
    """`Formats` of all values of the documents; what reaches the driver are automata, their counts and `batch_chars` of shapes at a time."""
    rows = written(shapes(docs, min_length), "secret-shapes").select("kind", "shape", "even", "odd", "h")
    known = learned(rows.where("kind <> 'ordinary'"), [(kind, part) for kind in KINDS[:3] for part in _PARTS], batch_chars)
    names = [kind for kind in KINDS[:3] if (kind, "all") in known]
    kinds = [known[kind, "all"] for kind in names]
    if not kinds:
        return Formats.of([], Automaton(()), least_ratio)
    half = {kind: _halves(known, kind) for kind in names}
    seen = _quantiles(_measured(rows.where("kind <> 'ordinary'"), lambda kind, shape, even, odd: [(_by_char(half[kind]["even"], shape), even), (_by_char(half[kind]["odd"], shape), odd)]), [0.01, 0.5])
    levels = [max(1.5 * seen[kind][0] - 0.5 * seen[kind][1], BLIND + _MARGIN) for kind in names]
    expected = lambda shape: not _PLAIN_SHAPE.fullmatch(shape) and any(_by_char(a, shape) >= level for a, level in zip(kinds, levels, strict=True))
    best = lambda shape: max(_by_char(a, shape) for a in kinds)
    tokens = _measured(rows.where("kind = 'ordinary'"), lambda kind, shape, even, odd: [(0.0, 1)] if expected(shape) else [])
    aside = F.size("found") > 0
    while True:
        tokens = written(tokens, "secret-ordinary")
        usual = tokens.where(~aside).drop("found")
        ordinary = learned(usual, [("ordinary", "all")], batch_chars).get(("ordinary", "all"))
        if ordinary is None:  # without any other token nothing tells them apart
            if not tokens.take(1):
                ordinary = Automaton(())
                break
            tokens = tokens.withColumn("found", F.slice("found", 1, 0))
            continue
        back = _measured(tokens.where(aside).drop("found"), lambda kind, shape, even, odd, ordinary=ordinary: [(0.0, 1)] if best(shape) - _by_char(ordinary, shape) > least_ratio / 2 else [])
        back = written(back, "secret-aside")
        if not back.where(~aside).take(1):
            break
        tokens = tokens.where(~aside).unionByName(back)
    halves = _halves(learned(usual, [("ordinary", "even"), ("ordinary", "odd")], batch_chars) | {("ordinary", "all"): ordinary}, "ordinary")

    def ratios(kind: str, shape: str, even: int, odd: int):
        for own in _shown(kind, shape):
            for part, n in (("even", even), ("odd", odd)):
                yield best(own) - _by_char(halves[part], own), n

    held_out = _quantiles(_measured(usual, ratios), [quantile])
    threshold = max(least_ratio, held_out["ordinary"][0] if held_out else 0.0)
    return Formats.of(kinds, ordinary, threshold)


def find_secrets(docs: DataFrame, formats: Formats, min_length: int = LEAST) -> DataFrame:
    """doc_id and the spans (kind, start, end, score) of every document."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in text_slices(batches, "text"):
            texts = texts_of(batch)
            spans = [
                [{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, k, b, s in all_spans(t, runs, formats, min_length)]
                for t, runs in zip(texts, with_long_run(texts, min(LEAST, min_length)), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {SPANS}")


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of the output of `find_secrets`."""
    line = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(line(F.filter("spans", lambda x: x["kind"] != "format")), 256).alias("base_sha256"),
        line("spans").alias("spans"),
    )


def redact(docs: DataFrame, formats: Formats, min_length: int = LEAST) -> DataFrame:
    """The documents, with every span replaced by `[kind]` and n_chars counted again; other columns stay."""
    columns = docs.columns
    counted = "n_chars" in columns and isinstance(docs.schema["n_chars"].dataType, IntegralType)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in text_slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            sizes = batch.column("n_chars").to_pylist() if counted else [None] * len(texts)
            for i, runs in enumerate(with_long_run([t or "" for t in texts], min(LEAST, min_length))):
                spans = all_spans(texts[i] or "", runs, formats, min_length)
                if spans:
                    at, parts = 0, []
                    for a, k, b, _ in spans:
                        if a >= at:
                            parts += [texts[i][at:a], f"[{KINDS[k]}]"]
                        at = max(at, b)
                    texts[i] = "".join([*parts, texts[i][at:]])
                    sizes[i] = len(texts[i])
            out = {name: batch.column(name) for name in columns} | {"text": pa.array(texts, pa.string())}
            if counted:
                out["n_chars"] = pa.array(sizes, batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([out[c] for c in columns], columns)

    return docs.mapInArrow(run, docs.schema)
