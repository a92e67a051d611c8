"""Streams with state of their own: a parser that keeps its tail, runs that replace each other, silent sessions.

The state is one record a session in the session's state store (RocksDB: ``state_store``), so that
queries survive restarts and lost executors by their checkpoints. It travels to Python and back with the
session's rows, once a batch, and not value by value.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .events import IDLE_SECONDS, LAST_EVENTS

_PROVIDER, _WITHOUT_DATA = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"
PAYLOAD = "struct<text:string,tool:string,output:string,error:string>"


@contextmanager
def state_store(spark: SparkSession, timers_wait: bool = True):
    """Have queries that are started here keep their state in RocksDB, as these operators need; settings are put back.

    ``timers_wait``: batches without data run for timers. A query that is to end when its input does must not
    wait for timers of processing time, or it never ends.
    """
    wanted = {_PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", _WITHOUT_DATA: str(timers_wait).lower()}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _parser(idle_seconds: int):
    """Chunks of bytes to frames; chunks that come too early wait, those that came before are dropped."""

    def follow(key, batches, state: GroupState) -> Iterator[pd.DataFrame]:
        chunk, number, tail, early = state.get if state.exists else (0, 0, b"", [])
        if state.hasTimedOut:
            state.remove()
            yield _frames(key, number, [("error", '{"text":"no event for too long"}')])
            return
        came = {n: data for n, data in early}
        for some in batches:
            for n, data in zip(some["chunk"].tolist(), some["data"].tolist(), strict=True):
                if n >= chunk:
                    came.setdefault(n, data or b"")
        parts = [bytes(tail)]
        while chunk in came:
            parts.append(bytes(came.pop(chunk)))
            chunk += 1
        *frames, tail = b"".join(parts).split(b"\n\n")
        told = [t for t in map(frame_fields, frames) if t]
        state.update((chunk, number + len(told), tail, [(n, bytes(data)) for n, data in came.items()]))
        state.setTimeoutDuration(idle_seconds * 1000)
        if told:
            yield _frames(key, number, told)

    return follow


def _frames(key, number: int, frames: list[tuple[str, str]]) -> pd.DataFrame:
    return pd.DataFrame({"session_id": [key[0]] * len(frames), "number": range(number, number + len(frames)), "event": [f[0] for f in frames], "data": [f[1] for f in frames]})


def frame_fields(frame: bytes) -> tuple[str, str] | None:
    """Event and data of a frame; None without data. Of several lines of a kind the last counts."""
    event = data = ""
    for line in frame.decode("utf-8", "replace").split("\n"):
        if line.startswith("event: "):
            event = line.removeprefix("event: ").strip()
        elif line.startswith("data: "):
            data = line.removeprefix("data: ").strip()
    return (event, data) if data else None


def parse_stream(chunks: DataFrame, idle_seconds: int = IDLE_SECONDS, payload: str = PAYLOAD) -> DataFrame:
    """``session_id, number, event, data`` of byte streams that arrive in chunks, cut anywhere.

    chunks: ``session_id, chunk (from 0), data``. State holds the bytes after the last complete frame and
    chunks whose turn has not come. Events without data, or whose data is no JSON, are left out; a chunk that
    comes again is ignored; null data is an empty chunk. A session that is silent for ``idle_seconds``
    (of processing time) is given up: an ``error`` event, its tail is dropped, and it begins anew at chunk 0.
    """
    rows = chunks.where("session_id IS NOT NULL AND chunk >= 0").select("session_id", F.col("chunk").cast("long").alias("chunk"), F.col("data").cast("binary").alias("data"))
    kind = rows.schema["session_id"].dataType.simpleString()
    frames = rows.groupBy("session_id").applyInPandasWithState(
        _parser(idle_seconds), f"session_id {kind}, number long, event string, data string", "next_chunk long, next_event long, tail binary, early array<struct<chunk:long,data:binary>>",
        "append", GroupStateTimeout.ProcessingTimeTimeout,
    )
    return frames.where(F.try_parse_json("data").isNotNull()).withColumn("data", F.from_json("data", payload))


def _runs(idle_seconds: float):
    """Holds a session's events until its run ends; a new run takes the place of the one under way."""
    idle = int(idle_seconds * 1000)

    def told(key, run: int, status: str, events: list[tuple]) -> pd.DataFrame:
        n = len(events)
        return pd.DataFrame({"session_id": [key[0]] * n, "run_id": [run] * n, "status": [status] * n, "seq": [e[0] for e in events], "event": [e[1] for e in events], "text": [e[2] for e in events]})

    def follow(key, batches, state: GroupState) -> Iterator[pd.DataFrame]:
        run, began, ended, last, held, replaced = state.get if state.exists else (None, 0, "", 0, [], [])
        held, replaced = list(map(tuple, held)), dict.fromkeys(replaced)
        if not state.hasTimedOut:
            gone: list[tuple] = []
            for seq, of, event, text, ms in sorted((r for some in batches for r in some[["seq", "run_id", "event", "text", "ms"]].itertuples(index=False, name=None)), key=lambda r: r[0]):
                if of != run:
                    if run is not None:
                        if of in replaced or seq < began:
                            continue
                        replaced[run] = None
                        gone.append((run, held[0]))
                    run, began, ended, last, held = of, seq, "", ms, []
                last = max(last, ms)
                held.append((seq, event, text))
                if event in LAST_EVENTS:
                    ended = event
            if gone:
                yield told(key, 0, "replaced", [e for _, e in gone]).assign(run_id=[r for r, _ in gone])
            if run is None:
                return
            if last + idle >= state.getCurrentWatermarkMs():
                state.update((run, began, ended, last, held, list(replaced)))
                state.setTimeoutTimestamp(max(1, last + idle))
                return
        # Its time has passed, maybe before its rows came.
        if state.exists:
            state.remove()
        yield told(key, run, ended or "idle", sorted(held, key=lambda e: e[0]))

    return follow


def run_stream(events: DataFrame, idle_seconds: float = IDLE_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """Events of each session's last run, when the session has been silent for ``idle_seconds`` of event time.

    events: ``session_id, run_id, seq, event, text, ts``. A run of later first event replaces the one under way,
    whose events are dropped, those still to come as well; it leaves one row (its first event) of status
    ``replaced``. The others have the status of the run's last end (done, error or cancelled), else ``idle``.
    Rows without a session, run, number or time are left out; text may be null.
    """
    told = events.where("session_id IS NOT NULL AND run_id IS NOT NULL AND seq IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = told.withWatermark("ts", delay).select("session_id", F.col("run_id").cast("long").alias("run_id"), F.col("seq").cast("long").alias("seq"), "event", "text", F.unix_millis("ts").alias("ms"), "ts")
    kind = rows.schema["session_id"].dataType.simpleString()
    return rows.groupBy("session_id").applyInPandasWithState(
        _runs(idle_seconds), f"session_id {kind}, run_id long, status string, seq long, event string, text string",
        "run_id long, began long, ended string, last_ms long, held array<struct<seq:long,event:string,text:string>>, replaced array<long>", "append", GroupStateTimeout.EventTimeTimeout,
    )


def idle_stream(events: DataFrame, seconds: int = IDLE_SECONDS, ts: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """``session_id, begins, ends, n_events`` of runs of events with no silence longer than ``seconds``, by event time.

    A run is told once the watermark (the latest time seen, less ``delay``) has passed its end. An event later
    than that is dropped, unless it joins a run that is still open. The same runs as ``idle_gaps``, in which a
    silence of just ``seconds`` ends nothing. State is one row a run that is open.
    """
    timed = events.where(F.col("session_id").isNotNull() & F.col(ts).isNotNull()).withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", delay)
    gap = F.session_window("_at", f"{seconds} seconds 1 microsecond")
    return timed.groupBy("session_id", gap.alias("w")).agg(F.min(ts).alias("begins"), F.max(ts).alias("ends"), F.count(F.lit(1)).alias("n_events")).drop("w")
