"""Live positions: distance of trips, throttled events, and incremental compiles, as Structured Streaming queries."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarn.functions.geo import HAVERSINE_RADIUS_M

FIXES = "trip_id long, ts timestamp, seq long, event string, lng double, lat double, accuracy double"
_TRIP = "trip_id long, segment long, metres double, fixes long"
_TIMED = f"{_TRIP}, ended boolean"
_TIMED_NAMES = ["trip_id", "segment", "metres", "fixes", "ended"]
_TIMED_STATE = "segment long, active boolean, lng double, lat double, metres double, fixes long, us long, seq long"
_STATE = "segment long, active boolean, lng double, lat double, metres double, fixes long, ts timestamp, seq long"


def metres(lng1: float, lat1: float, lng2: float, lat2: float) -> float:
    a, b = math.sin(math.radians(lat2 - lat1) / 2), math.sin(math.radians(lng2 - lng1) / 2)
    return 2 * HAVERSINE_RADIUS_M * math.asin(math.sqrt(a * a + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * b * b))


def _folded(parts: Iterator[pd.DataFrame], held: tuple | None) -> tuple[tuple, list[tuple[int, float, int]]]:
    """What is held of a trip after a batch, and (segment, metres, fixes) to tell; events not newer than the last one seen are dropped.

    A batch is worked through by columns: segments are counted openings, a fix counts where the event before it that is
    no fix has opened one, and steps go from each counted fix to the next of its segment.
    """
    segment, active, lng, lat, total, fixes, ts, seq = held or (0, False, None, None, 0.0, 0, None, None)
    rows = pd.concat(list(parts)).sort_values(["ts", "seq"]).drop_duplicates(["ts", "seq"])
    if ts is not None:
        rows = rows[(rows["ts"] > ts) | ((rows["ts"] == ts) & (rows["seq"] > seq))]
    if len(rows):
        event = rows["event"].to_numpy()
        opens, pauses = np.isin(event, ("start", "resume")), event == "pause"
        own = segment + np.cumsum(opens)
        since = np.maximum.accumulate(np.where(opens | pauses, np.arange(1, len(rows) + 1), 0))
        on = np.where(since > 0, opens[since - 1], active)
        counted = on & ~opens & ~pauses
        # Fixes that count, after the one that the state ended with.
        x, y = np.append(lng or 0.0, rows["lng"].to_numpy(float)[counted]), np.append(lat or 0.0, rows["lat"].to_numpy(float)[counted])
        of = np.append(segment if lng is not None else -1, own[counted])
        a, b = np.sin(np.radians(np.diff(y)) / 2), np.sin(np.radians(np.diff(x)) / 2)
        step = 2 * HAVERSINE_RADIUS_M * np.arcsin(np.sqrt(a * a + np.cos(np.radians(y[:-1])) * np.cos(np.radians(y[1:])) * b * b))
        step[(of[1:] != of[:-1]) | ~(step > 1.0)] = 0.0
        numbers = np.arange(segment, own[-1] + 1)
        sums = np.bincount(of[1:] - segment, step, len(numbers)).astype(float)
        counts = np.bincount(of[1:] - segment, minlength=len(numbers))
        sums[0], counts[0] = sums[0] + total, counts[0] + fixes
        last = np.searchsorted(own, numbers, "right") - 1
        ends_on = np.where(last >= 0, on[last], active)
        if counted.any():
            lng, lat = (float(x[-1]), float(y[-1])) if of[-1] == numbers[-1] else (None, None)
        elif len(numbers) > 1:
            lng = lat = None
        told = ends_on | (counts > 0)
        told[-1] = True
        out = [(int(n), float(m), int(c)) for n, m, c, t in zip(numbers, sums, counts, told, strict=True) if t]
        segment, active, total, fixes = int(numbers[-1]), bool(ends_on[-1]), float(sums[-1]), int(counts[-1])
        ts, seq = rows["ts"].iloc[-1], int(rows["seq"].iloc[-1])
    else:
        out = [(segment, total, fixes)]
    return (segment, active, lng, lat, total, fixes, ts, seq), [o for o in out if o[0] > 0]


def _advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = None
    if state.exists:
        *rest, ts, seq = state.get
        held = (*rest, None if ts is None else pd.Timestamp(ts), seq)
    (*rest, ts, seq), out = _folded(parts, held)
    state.update((*rest, None if ts is None else ts.to_pydatetime(), seq))
    yield pd.DataFrame([(key[0], *o) for o in out], columns=["trip_id", "segment", "metres", "fixes"])


def trip_updates(fixes: DataFrame) -> DataFrame:
    """trip_id, segment, metres, fixes after each batch, for a stream (or table) of FIXES.

    The state of a trip is one row, whatever its length.  Start and resume open a segment, pause closes it; steps up to
    a metre are jitter, but the last fix always moves on.  The last update of a segment is its total.
    """
    return fixes.groupBy("trip_id").applyInPandasWithState(_advance, _TRIP, _STATE, "update", GroupStateTimeout.NoTimeout)


class _TimedTrip(StatefulProcessor):
    """A trip's totals until it has been idle for so many milliseconds of event time."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trip = handle.getValueState("trip", _TIMED_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.trip.get() if self.trip.exists() else None
        held, out = _folded(rows, held and tuple(held))
        held = (*held[:6], int(held[6]), held[7])
        self.trip.update(held)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(held[6] // 1000 + self.idle_ms)
        yield pd.DataFrame([(key[0], *o, False) for o in out], columns=_TIMED_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        segment, _, _, _, total, fixes, _, _ = self.trip.get()
        self.trip.clear()
        yield pd.DataFrame([(key[0], segment, total, fixes, True)] if segment > 0 else [], columns=_TIMED_NAMES)

    def close(self) -> None:
        pass


def timed_trip_updates(fixes: DataFrame, *, idle: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """trip_id, segment, metres, fixes, ended of a stream of FIXES, as `trip_updates`, for trips that end by themselves.

    A trip whose last event is ``idle`` behind the watermark (the newest event of the stream less ``late``) is over: its
    last segment is told once more with ``ended``, and its state and timer go, so what is kept grows with the trips
    under way and not with all there ever were.  An event that comes after is a new trip of that id, from segment 1.
    Events behind the watermark are dropped.  Needs the state store in RocksDB, which this sets for the session.
    """
    spark = fixes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = fixes.withWatermark("ts", late).select("trip_id", F.unix_micros("ts").alias("us"), "ts", "seq", "event", "lng", "lat")
    return rows.withColumnRenamed("ts", "at").withColumnRenamed("us", "ts").groupBy("trip_id").transformWithStateInPandas(_TimedTrip(idle_ms), _TIMED, "Update", "EventTime")


def _let_through(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(parts)).sort_values(["ms", "seq"])
    keep = []
    for ms in rows["ms"]:
        ok = last is None or ms - last >= 120
        last = int(ms) if ok else last
        keep.append(ok)
    if last is not None:
        state.update((last,))
    yield rows[keep][["trip_id", "ms", "seq"]]


def throttled(events: DataFrame) -> DataFrame:
    """Events (trip_id, ms, seq) of a stream that come 120 ms or more after the last one let through of their trip."""
    return events.groupBy("trip_id").applyInPandasWithState(_let_through, "trip_id long, ms long, seq long", "last long", "append", GroupStateTimeout.NoTimeout)


def fingerprint(options: dict) -> str:
    """Name of a job's options; other options mean another checkpoint, so a changed job starts afresh."""
    return hashlib.sha256(json.dumps(options, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def run_slices(spark: SparkSession, source: str, schema: str, checkpoint: str, options: dict, write: Callable[[DataFrame, int], None], files_per_slice: int = 8) -> int:
    """Works off what is new in a folder of Parquet files, some files at a time, and returns the number of slices done.

    A slice is a micro-batch: its offsets are in the checkpoint before it runs and it is committed after ``write``, which
    gets the batch and its number and should be idempotent in that number.  A killed run goes on where it stopped.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_slice).parquet(source)
    done = []

    def batch(df: DataFrame, number: int) -> None:
        write(df, number)
        done.append(number)

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/{fingerprint(options)}").trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)


def upsert_slices(target: str) -> Callable[[DataFrame, int], None]:
    """A writer that keeps each slice under its number, so that a repeated slice replaces itself."""

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/slice={number}")

    return write


class Progress(StreamingQueryListener):
    """Calls ``tell(rows, batch)`` after each micro-batch."""

    def __init__(self, tell: Callable[[int, int], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.tell(event.progress.numInputRows, event.progress.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def slice_budget(base_ms: int, state: str) -> tuple[int, int]:
    """(milliseconds of work, pause) of a slice in a thermal state."""
    from tarn.functions.text import THERMAL

    scale, pause = next((s, p) for name, s, p in THERMAL if name == state)
    return int(base_ms * scale), pause


def worker_width(cores: int, state: str) -> int:
    """Tasks at once: all but two cores, half of them when warm, one when hot."""
    full = max(1, cores - 2)
    return full if state == "nominal" else max(1, full // 2) if state == "fair" else 1


def retried(action: Callable[[], object], attempts: int = 3, wait_s: float = 1.0, transient: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] | None = None) -> object:
    """Result of ``action``; transient errors are tried again after waits that double."""
    import time

    for k in range(attempts + 1):
        try:
            return action()
        except Exception as e:
            if k == attempts or not transient(e):
                raise
            (sleep or time.sleep)(wait_s * 2**k)


#: Moves of a background job's record: state, event -> state.
MOVES = {
    ("idle", "enqueue"): "pending",
    ("pending", "yield"): "pending",
    ("pending", "finish"): "finished",
    ("pending", "fail"): "failed",
    ("finished", "acknowledge"): "idle",
    ("failed", "acknowledge"): "idle",
    ("failed", "enqueue"): "pending",
}


def job_states(events: DataFrame) -> DataFrame:
    """job_id, state after all events (job_id, seq, event) in order; events that do not apply leave the state.

    Folded by an aggregation over each job's sorted events, in the JVM.
    """
    moves = F.create_map(*(F.lit(x) for (s, e), to in MOVES.items() for x in (f"{s} {e}", to)))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq", "event"))), lambda x: x["event"])
    state = F.aggregate(ordered, F.lit("idle"), lambda s, e: F.coalesce(F.try_element_at(moves, F.concat_ws(" ", s, e)), s))
    return events.groupBy("job_id").agg(state.alias("state"))
