"""Stream operators as queries: the given events are replayed through a stream, and what it wrote is returned.

Every query stages its input in a folder of its own below ``spark.checkpoint.dir``, in the order in which it
would come, and runs the stream to the end of what is there, again and again over one checkpoint.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import event_source
from ..streaming import events as E
from ..streaming import stateful
from .catalogue import ORACLE_SQL as CATALOGUE_SQL
from .catalogue import session_events

#: Far beyond any silence in the events: closes what is open.
LATER = "INTERVAL 1000 DAYS"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one; below the warehouse where that is unset, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def few_partitions(spark: SparkSession):
    """Streams that begin here have as many state stores as there are cores; the setting is put back."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def run_to_end(stream: DataFrame, top: str, timers_wait: bool = True) -> None:
    """Append what the stream makes of all that is there to ``top/out``."""
    spark = stream.sparkSession
    with few_partitions(spark), stateful.state_store(spark, timers_wait):
        running = stream.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start()
        try:
            running.awaitTermination()
        finally:
            running.stop()


def replay(spark: SparkSession, top: str, parts: list[DataFrame], operator, timers_wait: bool = True) -> DataFrame:
    """The output of a stream operator that is stopped and restarted after each of its input's parts."""
    schema = parts[0].schema
    for part in parts:
        part.write.mode("append").parquet(f"{top}/in")
        run_to_end(operator(spark.readStream.schema(schema).parquet(f"{top}/in")), top, timers_wait)
    return spark.read.parquet(f"{top}/out")


def _last(events: DataFrame) -> DataFrame:
    """One event of no session that is asked for, much later than all others."""
    last = events.agg(F.max("ts").alias("at"), F.max("seq").alias("seq")).where("at IS NOT NULL")
    told = {"session_id": F.lit(-1).cast("long"), "run_id": F.lit(-1).cast("long"), "seq": F.col("seq") + 1, "ts": F.expr(f"at + {LATER}")}
    return last.select(*(told.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields))


def event_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events through the event source, restarted in the middle; the fold of what came."""
    event_source.register(spark)
    top, events = new_folder(spark, "event-replay"), session_events(spark, sf_dir)
    half = F.col("seq") < events.agg(F.coalesce(F.percentile_approx("seq", 0.5), F.lit(0)).alias("half")).first()["half"]
    for n, some in enumerate((half, ~half)):
        events.where(some).write.parquet(f"{top}/in/part={n}")
        run_to_end(spark.readStream.format("session_events").schema(events.schema).option("path", f"{top}/in").option("rows", 2000).load(), top)
    return E.fold_messages(spark.read.parquet(f"{top}/out")).select("session_id", "content", F.size("errors").cast("long").alias("n_errors"), "info", "finished")


def event_parse_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bytes, cut at random places into chunks that come out of order over three batches, parsed with state."""
    events = session_events(spark, sf_dir)
    coded = E.encode(F.col("event"), F.struct("text", F.col("seq").cast("string").alias("tool"))).cast("binary")
    placed = events.select("session_id", "seq", coded.alias("frame"), (F.row_number().over(Window.partitionBy("session_id").orderBy("seq")) - 1).alias("n"))
    cut = (F.pmod(F.xxhash64("session_id", "seq"), F.length("frame") + 1)).cast("int")
    halves = F.array(F.substring("frame", F.lit(1), cut), F.substring(F.col("frame"), cut + 1, F.length("frame")))
    chunks = placed.select("session_id", "n", F.posexplode(halves).alias("half", "data")).select("session_id", (F.col("n") * 2 + F.col("half")).cast("long").alias("chunk"), "data")
    top = new_folder(spark, "event-parse")
    chunks.withColumn("of", F.pmod(F.xxhash64("session_id", "chunk"), F.lit(3))).write.partitionBy("of").parquet(f"{top}/cut")
    cut = spark.read.schema(chunks.schema.add("of", "integer")).parquet(f"{top}/cut")
    found = replay(spark, top, [cut.where(F.col("of") == n).drop("of") for n in range(3)], stateful.parse_stream, timers_wait=False)
    return found.select("session_id", F.col("data.tool").cast("long").alias("seq"), "event", "data.text")


def idle_timeout_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs between silences on a stream with a watermark."""
    events = session_events(spark, sf_dir).select("session_id", "seq", "ts")
    return replay(spark, new_folder(spark, "idle-timeout"), [events, _last(events)], stateful.idle_stream).where("session_id >= 0")


def run_replacement_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each session's last run on a stream in which a new run replaces the one under way."""
    events = session_events(spark, sf_dir).withColumn("run_id", F.floor(F.col("seq") / 500)).select("session_id", "run_id", "seq", "event", "text", "ts")
    found = replay(spark, new_folder(spark, "run-replacement"), [events, _last(events)], lambda stream: stateful.run_stream(stream, 100 * 86_400))
    return found.where("status <> 'replaced'").select("session_id", "seq")


QUERIES = {f.__name__: f for f in (event_replay, event_parse_stream, idle_timeout_stream, run_replacement_stream)}

ORACLE_SQL = {
    "event_replay": CATALOGUE_SQL["event_fold"],
    "event_parse_stream": CATALOGUE_SQL["event_roundtrip"],
    "idle_timeout_stream": f"SELECT session_id, begins, ends, n_events FROM ({CATALOGUE_SQL['idle_timeout']})",
    "run_replacement_stream": CATALOGUE_SQL["run_replacement"],
}
