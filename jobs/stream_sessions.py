"""Job 2, chat histories as a stream: a log of turns and a summary of each session, from new files only.

    spark-submit jobs/stream_sessions.py --conversations PATH --out PATH --checkpoint PATH [--config jobs/stream_sessions.json]

A file stream reads what has come since the last run (its checkpoint knows) and ends when that is done. Each
batch is appended to ``out/turns`` as partitions of its own, ``bucket`` and ``batch`` (the batch's number):
a batch that a failure makes run again overwrites these and nothing else. Then the sessions that the batch
speaks of are summed up anew from the log, and their buckets of ``out/sessions`` overwritten; other sessions
of these buckets are carried over, other buckets are not touched. So every step of a batch may be repeated.

``sessions``: ``session_id, n_turns, n_user, n_chars, title`` (beginning of the user's first message),
``last_role, last_message`` (beginning), ``last_turn``, partitioned by ``bucket``.

Defined results: turns without a session are left out; a turn that comes twice counts once (of different
versions the first in the order of role and text, nulls first); a null text is an empty message; a session
without messages of a user has a null title; an empty input writes nothing. No session's turns are gathered
in one place: everything is sums, minima and maxima, so one session may hold any share of the rows.
"""

from __future__ import annotations

import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from jobs.settings import bucket_of, checked_settings, command_line, load_settings, log, read_if_there

DEFAULTS = {"buckets": 32, "preview": 60, "files_per_batch": 64}
SOURCE = "conv_id long, turn long, role string, text string"
TURNS = "session_id long, turn long, role string, content string, bucket int, batch long"
SESSIONS = "session_id long, n_turns long, n_user long, n_chars long, title string, last_role string, last_message string, last_turn long, bucket int"


def read_sessions(spark: SparkSession, out: str) -> DataFrame:
    return read_if_there(spark, f"{out}/sessions", SESSIONS)


def read_turns(spark: SparkSession, out: str) -> DataFrame:
    return read_if_there(spark, f"{out}/turns", TURNS)


def summed_up(turns: DataFrame, preview: int) -> DataFrame:
    """Sessions of turns ``session_id, turn, role, content, bucket``."""
    once = turns.groupBy("bucket", "session_id", "turn").agg(F.min(F.struct("role", "content")).alias("m")).select("bucket", "session_id", "turn", "m.*")
    asked = F.col("role") == "user"
    return once.groupBy("bucket", "session_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.count_if(asked).alias("n_user"), F.sum(F.length("content")).alias("n_chars"),
        F.min_by(T.preview(F.col("content"), preview), F.when(asked, F.struct("turn"))).alias("title"),
        F.max(F.struct("turn", "role", T.preview(F.col("content"), preview).alias("said"))).alias("last"),
    ).select("session_id", "n_turns", "n_user", "n_chars", "title", F.col("last.role").alias("last_role"), F.col("last.said").alias("last_message"), F.col("last.turn").alias("last_turn"), "bucket")


def _overwrite(rows: DataFrame, path: str, *parts: str) -> None:
    rows.hint("rebalance", *parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def write_batch(batch: DataFrame, number: int, out: str, config: dict) -> None:
    """Everything that one batch changes; to run it again changes nothing more."""
    spark = batch.sparkSession
    told = batch.where("conv_id IS NOT NULL").select(F.col("conv_id").alias("session_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("content"))
    _overwrite(told.withColumns({"bucket": bucket_of(F.col("session_id").cast("string"), config["buckets"]), "batch": F.lit(number).cast("long")}), f"{out}/turns", "bucket", "batch")
    log_of = read_turns(spark, out)
    mine = log_of.where(F.col("batch") == number).select("session_id", "bucket").distinct()
    sizes = mine.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a bucket
    touched = [r["bucket"] for r in sizes]
    if touched:
        all_turns = log_of.where(F.col("bucket").isin(touched)).join(mine.select("session_id"), "session_id", "left_semi")
        kept = read_sessions(spark, out).where(F.col("bucket").isin(touched)).join(mine.select("session_id"), "session_id", "left_anti")
        _overwrite(summed_up(all_turns, config["preview"]).unionByName(kept), f"{out}/sessions", "bucket")
    log.info("batch %s: %s sessions in %s of %s buckets of %s", number, sum(r["n"] for r in sizes), len(touched), config["buckets"], out)


def stream_sessions(spark: SparkSession, conversations: str, out: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """One run over what is new; returns when it is done, with the batches and rows that it read."""
    config = checked_settings(config or {}, DEFAULTS)
    source = spark.readStream.schema(SOURCE).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(conversations)
    stream = source.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, out, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        stream.awaitTermination()
        batches = [p for p in stream.recentProgress if p.numInputRows]
    finally:
        stream.stop()
    done = {"batches": len(batches), "rows": sum(p.numInputRows for p in batches)}
    log.info("read %(rows)s rows in %(batches)s batches", done)
    return done


if __name__ == "__main__":
    command_line(
        "stream-sessions: a log of turns and a summary of each chat session from new files",
        {"conversations": "folder of Parquet files, or a pattern of files", "out": "folder of both tables", "checkpoint": "folder of the stream's checkpoint"},
        lambda spark, config, conversations, out, checkpoint: stream_sessions(spark, conversations, out, checkpoint, load_settings(spark, config, DEFAULTS)),
    )
