"""Event streams of chat sessions: parsing, and folding into messages and tool calls.

Events are rows ``session_id, seq, event, tool, text``. The batch folds are plain aggregates and
windows; the stream fold keeps the same state per session and ends a session on its last event or
after ``IDLE_SECONDS`` without one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Events that end a session, seconds of silence that do, and cancellation texts.
LAST_EVENTS = ("done", "error", "cancelled")
IDLE_SECONDS = 300
CANCELLED, CANCELLED_MARK = "Execution cancelled by user.", "\n\n*[Execution Cancelled]*"


def encode(event: Column, data: Column) -> Column:
    """A server-sent event; data is a struct."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))


def parse(buffer: Column, schema: str = "struct<text:string,tool:string,output:string,error:string>") -> tuple[Column, Column]:
    """The complete events of a buffer, and its tail, which waits for more.

    Events without data, or whose data is no JSON, are left out.
    """
    parts = F.split(buffer, "\n\n", -1)
    done = F.slice(parts, F.lit(1), F.size(parts) - 1)
    told = F.transform(
        done, lambda p: F.struct(F.trim(F.regexp_extract(p, r"(?m)^event: (.*)$", 1)).alias("event"), F.trim(F.regexp_extract(p, r"(?m)^data: (.*)$", 1)).alias("data"))
    )
    whole = F.filter(told, lambda e: (e["data"] != "") & F.try_parse_json(e["data"]).isNotNull())
    return F.transform(whole, lambda e: F.struct(e["event"].alias("event"), F.from_json(e["data"], schema).alias("data"))), F.element_at(parts, -1)


def fold_messages(events: DataFrame) -> DataFrame:
    """Per session ``content`` of the answer, ``errors`` after it, last ``info``, ``finished``.

    Tokens append, done overwrites, cancelled marks or replaces an empty answer. What counts is
    what follows the last done; all of it is one aggregate a session.
    """
    ordered = F.sort_array(F.collect_list(F.struct("seq", "event", "text")))

    def step(acc, e):
        text = F.coalesce(e["text"], F.lit(""))
        return (
            F.when(e["event"] == "token", F.concat(acc, text)).when(e["event"] == "done", text)
            .when((e["event"] == "cancelled") & (acc == ""), F.lit(CANCELLED)).when(e["event"] == "cancelled", F.concat(acc, F.lit(CANCELLED_MARK)))
            .otherwise(acc)
        )

    folded = events.groupBy("session_id").agg(ordered.alias("e"))
    told = lambda kind: F.transform(F.filter("e", lambda x: x["event"] == kind), lambda x: x["text"])
    return folded.select(
        "session_id",
        F.aggregate(F.filter("e", lambda x: x["event"].isin("token", "done", "cancelled")), F.lit(""), step).alias("content"),
        F.transform(told("error"), lambda t: F.concat(F.lit("Error: "), F.coalesce(t, F.lit("Unknown error")))).alias("errors"),
        F.try_element_at(told("info"), F.lit(-1)).alias("info"),
        F.exists("e", lambda x: x["event"].isin(*LAST_EVENTS)).alias("finished"),
    )


def tool_calls(events: DataFrame) -> DataFrame:
    """One row per start of a tool: ``session_id, tool, seq, status, ended``.

    A completion or error ends every running call of that tool in its session: a call ends at the
    first such event after it.
    """
    # Read backwards the frame only grows, so each call costs one step.
    after = Window.partitionBy("session_id", "tool").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    end = F.last(F.when(F.col("event").isin("tool_complete", "tool_error"), F.struct("seq", "event")), ignorenulls=True).over(after)
    calls = events.where(F.col("event").isin("tool_start", "tool_complete", "tool_error")).withColumn("end", end).where(F.col("event") == "tool_start")
    status = F.when(F.col("end.event") == "tool_complete", "completed").when(F.col("end.event") == "tool_error", "error").otherwise("running")
    return calls.select("session_id", "tool", "seq", status.alias("status"), F.col("end.seq").alias("ended"))


def latest_run(events: DataFrame) -> DataFrame:
    """A new request replaces the one under way: only events of each session's run (``run_id``) that began last."""
    runs = events.groupBy("session_id", "run_id").agg(F.min("seq").alias("began"))
    last = runs.groupBy("session_id").agg(F.max_by("run_id", "began").alias("run_id"))
    return events.join(last, ["session_id", "run_id"], "left_semi").select(*events.columns)


def tool_stream(events: DataFrame, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """``tool_calls`` over a stream: a row a call when it ends; calls of a session that falls silent, or ends, stay running."""

    def follow(key, batches, state: GroupState):
        running = [tuple(r) for r in state.get[0]] if state.exists else []
        out: list[tuple] = []
        if state.hasTimedOut:
            out, running = [(tool, seq, "running", None) for tool, seq in running], []
        rows = [r for batch in batches for r in batch[["seq", "event", "tool"]].itertuples(index=False)]
        for seq, event, tool in sorted(rows, key=lambda r: r[0]):
            if event == "tool_start":
                running.append((tool, seq))
            elif event in ("tool_complete", "tool_error"):
                status = "completed" if event == "tool_complete" else "error"
                out += [(t, s, status, seq) for t, s in running if t == tool]
                running = [r for r in running if r[0] != tool]
            elif event in LAST_EVENTS:
                out += [(t, s, "running", None) for t, s in running]
                running = []
        if running:
            state.update((running,))
            state.setTimeoutDuration(idle_seconds * 1000)
        elif state.exists:
            state.remove()
        if out:
            tools, seqs, statuses, ends = zip(*out, strict=True)
            yield pd.DataFrame({"session_id": [key[0]] * len(out), "tool": tools, "seq": seqs, "status": statuses, "ended": pd.array(ends, dtype="Int64")})

    return events.groupBy("session_id").applyInPandasWithState(
        follow, "session_id string, tool string, seq long, status string, ended long", "running array<struct<tool:string,seq:long>>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def idle_gaps(events: DataFrame, seconds: int = IDLE_SECONDS, ts: str = "ts") -> DataFrame:
    """Runs of each session's events with no silence longer than ``seconds``: the idle timeout."""
    order = Window.partitionBy("session_id").orderBy(ts, "seq")
    gap = F.col(ts).cast("timestamp").cast("double") - F.lag(F.col(ts).cast("timestamp").cast("double")).over(order)
    runs = events.withColumn("new", (F.coalesce(gap, F.lit(0.0)) > seconds).cast("int")).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("session_id", "run").agg(F.min(ts).alias("begins"), F.max(ts).alias("ends"), F.count(F.lit(1)).alias("n_events"))


def fold_stream(events: DataFrame, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """The fold over a stream: one row a session when it ends, by an event or by silence.

    Tokens arrive in order within a session (a partition's order); state is one row a session.
    """

    def fold(key, batches, state: GroupState):
        content, n, finished = state.get if state.exists else ("", 0, False)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "content": [content], "n_events": [n], "ended_by": ["idle"]})
            return
        for batch in batches:
            for event, text in batch.sort_values("seq")[["event", "text"]].itertuples(index=False):
                if finished:
                    break
                n, text = n + 1, text or ""
                if event == "token":
                    content += text
                elif event == "done":
                    content = text
                elif event == "cancelled":
                    content = content + CANCELLED_MARK if content else CANCELLED
                finished = event if event in LAST_EVENTS else False
        if finished:
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "content": [content], "n_events": [n], "ended_by": [finished]})
        else:
            state.update((content, n, False))
            state.setTimeoutDuration(idle_seconds * 1000)

    return events.groupBy("session_id").applyInPandasWithState(
        fold, "session_id string, content string, n_events long, ended_by string", "content string, n long, finished boolean", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
