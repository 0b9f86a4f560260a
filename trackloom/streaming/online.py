"""Streaming twins: windowed counts with late data, and tracks born frame by frame."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.tracking import AXES, BORN, Births, Motion, candidates_by_time, finished_tracks
from ..session import scratch


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream of its files. The path is given as a pattern, since a stream takes
    a plain path for a folder and the table may be one file."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{path[:-1]}[{path[-1]}]")


def windowed_counts(events: DataFrame, length: str, delay: str, by: str = "event_type", slide: str | None = None) -> DataFrame:
    """Counts and sums in tumbling windows, or in sliding ones with `slide`; a window is final once the watermark has passed it, later rows are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    own = timed.groupBy(F.window("ts", length, slide), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return own.select(F.unix_micros("window.start").alias("start_us"), by, "n", "total")


def sessions(events: DataFrame, quiet: str, delay: str, by: str = "user_id") -> DataFrame:
    """Runs of events of a key without a pause of `quiet`; a session is final once the watermark has passed its end."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    own = timed.groupBy(F.session_window("ts", quiet), by).agg(F.count("*").alias("n"))
    return own.select(by, F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "n")


#: What a stream of births puts out besides its keys: rows of tracks (`late` is false), and candidates that came too late.
BORN_ROWS = f"{BORN}, late boolean"
#: The end of time: what a clip's last step becomes when the clip is over.
_OVER = float("inf")
#: Candidates of a step and tracks are packed (float64, row by row: t, x, y, z; t, seen, x, y, z): each value of a state is pickled on its way, which costs far more than it.
_HELD = "closes long, rows binary"
_ACTIVE = "t double, missed long, state binary, log binary"
#: Candidates in one element of the list; a fuller step has several.
_HELD_ROWS = 1 << 15
_KNOWN = "last double, emitted long, opened long, due long, ends long"


def _restored(rows: Iterable, opened: int, motion: Motion) -> Births:
    """Births with the active tracks of the state, in their order."""
    births, rows = Births(motion), list(rows)
    births.opened = opened
    if rows:
        own, n = np.array([np.frombuffer(r[2]) for r in rows]), len(AXES)
        births.states.joined(own[:, :n])
        births.states.speed, births.states.p = own[:, n : 2 * n].copy(), own[:, 2 * n :].copy()
        births.t, births.missed = np.array([r[0] for r in rows], dtype=float), np.array([r[1] for r in rows], dtype=np.int64)
        logs = [np.frombuffer(r[3]).reshape(-1, 2 + n) for r in rows]
        births.logs = [[(t, bool(seen), at) for t, seen, at in zip(log[:, 0].tolist(), log[:, 1].tolist(), log[:, 2:], strict=True)] for log in logs]
    return births


def _state(births: Births) -> list[tuple]:
    own = np.concatenate([births.states.at, births.states.speed, births.states.p], axis=1)
    return [
        (float(births.t[i]), int(births.missed[i]), own[i].tobytes(), np.array([(t, seen, *at) for t, seen, at in log], dtype=float).tobytes())
        for i, log in enumerate(births.logs)
    ]


def _held(closes: np.ndarray, rows: np.ndarray) -> list[tuple[int, bytes]]:
    """Elements of the list of held candidates: those of a step together."""
    order = np.argsort(closes, kind="stable")
    closes, rows = closes[order], rows[order]
    steps = np.split(np.arange(len(closes)), np.flatnonzero(np.diff(closes)) + 1)
    return [(int(closes[own[0]]), rows[own[at : at + _HELD_ROWS]].tobytes()) for own in steps if len(own) for at in range(0, len(own), _HELD_ROWS)]


def _taken(births: Births, held: list[tuple]) -> list[list]:
    """Takes the held rows of complete steps in time order; the tracks that retire."""
    if not held:
        return []
    rows = np.frombuffer(b"".join(r[1] for r in held)).reshape(-1, 1 + len(AXES))
    return [log for t, found in candidates_by_time(rows[:, 0], rows[:, 1:]) for log in births.frame(t, found)]


class BirthProcessor(StatefulProcessor):
    """State of a clip: candidates of steps that are not complete (list), active tracks (list, a row each), and a value with
    the last step taken, the counts and the moment of the one timer that is set."""

    def __init__(self, by: tuple[str, ...], motion: Motion):
        self.by, self.motion = by, motion

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held, self.active = handle.getListState("held", _HELD), handle.getListState("active", _ACTIVE)
        self.known = handle.getValueState("known", _KNOWN)

    def _frame(self, key: tuple, columns: dict, late: bool) -> pd.DataFrame:
        n = len(columns["t"])
        return pd.DataFrame({**{c: [v] * n for c, v in zip(self.by, key, strict=True)}, **columns, "late": [late] * n})

    def _timer(self, due: int, closes: int) -> int:
        """One timer a clip, at the first moment that completes a step."""
        if due < 0 or closes < due:
            if due >= 0:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(closes)
            return closes
        return due

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        last, emitted, opened, due, ends = self.known.get() if self.known.exists() else (float("-inf"), 0, 0, -1, -1)
        for batch in rows:
            late = batch["t"] <= last
            if late.any():
                own = batch[late]
                yield self._frame(key, {"track": pd.array([None] * len(own), dtype="Int64"), "t": own["t"].to_numpy(), "observed": own["x"].notna().to_numpy(), **{c: own[c].to_numpy(dtype=float) for c in AXES}, "confidence": np.full(len(own), np.nan)}, True)
            fresh = batch[~late]
            if len(fresh):
                self.held.appendList(_held(fresh["closes"].to_numpy(dtype=np.int64), fresh[["t", *AXES]].to_numpy(dtype=float)))
                due = self._timer(due, max(0, int(fresh["closes"].min())))
                ends = max(ends, int(fresh["ends"].max()))
        self.known.update((last, emitted, opened, due, ends))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        """Takes all steps that the watermark has passed; ends the clip if it has passed its end."""
        last, emitted, opened, _, ends = self.known.get()
        mark = timerValues.getCurrentWatermarkInMs()
        held = list(self.held.get())
        ready, rest = [r for r in held if r[0] <= mark], [r for r in held if r[0] > mark]
        births = _restored(self.active.get(), opened, self.motion)
        done = _taken(births, ready)
        last = max([last, *(float(np.frombuffer(r[1])[:: 1 + len(AXES)].max()) for r in ready)])
        if not rest and 0 <= ends <= mark:
            done, last = done + births.rest(), _OVER
            births.keep(np.zeros(0, dtype=np.int64))
        self.active.put(_state(births)) if births.logs else self.active.clear()
        self.held.put(rest) if rest else self.held.clear()
        due = self._timer(-1, min(r[0] for r in rest)) if rest else self._timer(-1, ends) if ends > mark else -1
        self.known.update((last, emitted + len(done), births.opened, due, ends))
        if done:
            yield self._frame(key, finished_tracks(done, emitted, self.motion), False)


def born_stream(candidates: DataFrame, motion: Motion = Motion(), by: Sequence[str] = ("seq",)) -> DataFrame:
    """Tracks as they retire, smoothed, from a stream of candidates (`by`, t, closes, x, y, z) with a watermark on `closes`.

    `closes` is the moment when the step t of its candidates is complete. Candidates are held until the watermark
    has passed it, so neither the files' order nor where micro-batches cut a step matters. A candidate of a step that was taken
    comes out at once as a row of its own (`late`), instead of being dropped. With a column `ends` (the moment when the clip is over) a clip's active tracks retire
    once the watermark has passed it. State grows with the delay and the tracks that are active, not with the stream; of a clip that is
    over only five numbers stay, which tell later rows as late. (`closes` goes on as a number: Spark itself would drop late rows of a column with a watermark.)
    """
    kinds = ", ".join(f"{c} {candidates.schema[c].dataType.simpleString()}" for c in by)
    ends = F.unix_millis("ends") if "ends" in candidates.columns else F.lit(-1).cast("long")
    rows = candidates.select(*by, "t", F.unix_millis("closes").alias("closes"), ends.alias("ends"), *AXES)
    return rows.groupBy(*by).transformWithStateInPandas(BirthProcessor(tuple(by), motion), f"{kinds}, {BORN_ROWS}", "Append", "eventTime")


def finished(spark: SparkSession, state: str, like: DataFrame, motion: Motion = Motion(), by: Sequence[str] = ("seq",)) -> DataFrame:
    """What a stream of births still holds when its input has ended: the held steps are taken, then the tracks that are active and
    confirmed come out. Spark's reader of states gives the variables with their types; `like` has the columns `by`."""
    read = lambda name, column: spark.read.format("statestore").option("stateVarName", name).load(state).select(*[F.col(f"key.{c}").alias(c) for c in by], F.col(column).alias(name))
    gathered = lambda name: read(name, "list_element").groupBy(*by).agg(F.collect_list(name).alias(name))
    rows = read("known", "value").join(gathered("held"), list(by), "left").join(gathered("active"), list(by), "left")
    kinds = ", ".join(f"{c} {like.schema[c].dataType.simpleString()}" for c in by)
    names = [x.split()[0] for x in BORN_ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for r in batch.to_pylist():
                births = _restored([tuple(a.values()) for a in r["active"] or []], r["known"]["opened"], motion)
                done = _taken(births, [tuple(h.values()) for h in r["held"] or []])
                columns = finished_tracks(done + births.rest(), r["known"]["emitted"], motion)
                n = len(columns["t"])
                yield pa.RecordBatch.from_arrays([*[pa.array([r[c]] * n, batch.column(c).type) for c in by], *map(pa.array, columns.values()), pa.array([False] * n)], [*by, *names])

    return rows.mapInArrow(run, f"{kinds}, {BORN_ROWS}")


def all_born(candidates: DataFrame, motion: Motion = Motion(), delay: str = "1 day", by: Sequence[str] = ("seq",)) -> tuple[DataFrame, DataFrame]:
    """All tracks of a stream that ends with what is there now: the rows that the stream put out, and those that were left in its state."""
    spark = candidates.sparkSession
    state = scratch(spark, "births-state")
    streamed = drained(born_stream(candidates.withWatermark("closes", delay), motion, by), "births", state)
    return streamed, finished(spark, state, candidates, motion, by)


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(stream: DataFrame, name: str, state: str | None = None, out: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now, and returns what it wrote to the shared folder (or to `out`, which a restart with the same `state` goes on with).

    States live in RocksDB, which typed state needs and which keeps them off the heap."""
    spark = stream.sparkSession
    out = out or scratch(spark, name)
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state or scratch(spark, f"{name}-state")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(out)
