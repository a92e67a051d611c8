"""Stream operators: against their SQL over the given events, and on small inputs with all that may go wrong."""

import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import duckdb_rows, spark_rows
from pyspark.sql import functions as F

from gleaner.plans import streams
from gleaner.sources import event_source
from gleaner.streaming import events as E
from gleaner.streaming import stateful


@pytest.mark.parametrize("name", sorted(streams.QUERIES))
def test_queries_equal_their_sql(spark, sf_dir, name):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", stateful._PROVIDER, stateful._WITHOUT_DATA)}
    assert spark_rows(streams.QUERIES[name](spark, sf_dir)) == duckdb_rows(streams.ORACLE_SQL[name], sf_dir)
    assert {k: spark.conf.get(k) for k in before} == before


CHUNKS = "session_id string, chunk long, data binary, event string"


def chunks(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], CHUNKS)


def test_parser_takes_chunks_in_any_order_and_twice(spark, tmp_path):
    rng = random.Random(6)
    want, parts = {}, [[], [], []]
    for session in ("a", "b", "c"):
        frames = [f"event: token\ndata: {{\"text\": \"é中😀 {session}{i}\"}}\n\n".encode() for i in range(30)]
        frames[3:3] = [b"event: info\n\n", b"data: no json\n\n", b"\n\n", b"id: 3\ndata: {\"text\": \"bare\"}\nevent: last\nevent: really last\n\n"]
        data = b"".join(frames) + b"event: token\ndata: {\"text\": \"cut o"
        cuts = sorted(rng.sample(range(1, len(data)), 40))
        for n, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(data)])):
            for _ in range(1 + (n % 5 == 0)):
                rng.choice(parts).append((session, n, data[i:j]))
        want[session] = [("token", f"é中😀 {session}{i}") for i in range(3)] + [("really last", "bare")] + [("token", f"é中😀 {session}{i}") for i in range(3, 30)]
    parts[2] += [(None, 0, b"x\n\n"), ("d", 0, None), ("d", 1, b"")]
    found = streams.replay(spark, str(tmp_path), [chunks(spark, p) for p in parts], stateful.parse_stream, timers_wait=False).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["session_id"], r["number"])):
        got.setdefault(r["session_id"], []).append((r["event"], r["data"]["text"]))
    assert got == want


def test_a_silent_session_is_given_up(spark, tmp_path):
    chunks(spark, [("a", 0, b"event: token\ndata: {\"text\": \"x\"}\n\nevent: tok")]).write.parquet(str(tmp_path / "in"))
    stream = stateful.parse_stream(spark.readStream.schema(CHUNKS).parquet(str(tmp_path / "in")), idle_seconds=2)
    with streams.few_partitions(spark), stateful.state_store(spark):
        q = stream.writeStream.format("memory").queryName("given_up").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("given_up").count() < 2:
            time.sleep(0.5)
    finally:
        q.stop()
    assert [(r["event"], r["data"]["text"]) for r in spark.table("given_up").orderBy("number").collect()] == [("token", "x"), ("error", "no event for too long")]


EVENTS = "session_id string, run_id long, seq long, event string, text string, ts timestamp"


def events(spark, rows):
    return spark.createDataFrame([(*r[:5], float(r[5])) for r in rows], "session_id string, run_id long, seq long, event string, text string, t double").withColumn("ts", F.timestamp_seconds("t")).drop("t")


def test_runs_replace_each_other_over_batches(spark, tmp_path):
    first = [("a", 1, 1, "token", "x", 100), ("a", 1, 2, "token", None, 101), ("b", 5, 3, "token", "y", 101), (None, 5, 4, "token", "y", 101), ("b", None, 5, "token", "y", 101), ("c", 8, 6, "token", "z", 102)]
    second = [("a", 2, 7, "token", "new", 103), ("a", 1, 8, "done", "too late", 104), ("b", 5, 9, "done", "all", 104), ("b", 5, 9, "done", "all", 104)]
    last = [("z", 0, 100, "token", "-", 10_000)]
    found = streams.replay(spark, str(tmp_path), [events(spark, p) for p in (first, second, last)], lambda s: stateful.run_stream(s, 60))
    assert sorted(map(tuple, found.select("session_id", "run_id", "status", "seq", "text").collect())) == [
        ("a", 1, "replaced", 1, "x"), ("a", 2, "idle", 7, "new"), ("b", 5, "done", 3, "y"), ("b", 5, "done", 9, "all"), ("b", 5, "done", 9, "all"), ("c", 8, "idle", 6, "z"),
    ]


def test_silences_by_event_time_and_late_rows(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice("abc"), 0, i, "token", "t", 1000 + rng.choice([0, 1, 59, 60, 61, 300]) * rng.randrange(40)) for i in range(200)] + [("d", 0, 900, "token", "t", 2000), ("d", 0, 901, "token", "t", 2060), ("d", 0, 902, "token", "t", 2120.5)]
    end = [("z", 0, 10_000, "token", "-", 10**6)]
    late = [("a", 0, 20_000, "token", "too late", 1500), (None, 0, 1, "token", "", 1500)]
    found = streams.replay(spark, str(tmp_path), [events(spark, p) for p in (rows, end, late, [("z", 0, 20_001, "token", "-", 10**6 + 1)])], lambda s: stateful.idle_stream(s, 60)).collect()
    want = E.idle_gaps(events(spark, rows), 60).select("session_id", "begins", "ends", "n_events").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, want))


def write_events(path, name, begin, end, group=10):
    (path / name).parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table({"session_id": pa.array(range(begin, end), pa.int64()), "text": [f"t{i}" for i in range(begin, end)]}), path / name, row_group_size=group)


def reader(path, rows=25):
    from pyspark.sql.types import StructType

    return event_source.EventReader(StructType.fromDDL("session_id long, text string, more double"), {"path": str(path), "rows": str(rows)})


def read_ids(r, start, end):
    return [i for p in r.partitions(start, end) for b in r.read(p) for i in b.column("session_id").to_pylist()]


def test_source_reads_every_row_once_whatever_the_offsets(tmp_path):
    write_events(tmp_path, "a/1.parquet", 0, 95)
    write_events(tmp_path, "a/2.parquet", 95, 95)
    write_events(tmp_path, "b/1.parquet", 95, 140, group=7)
    (tmp_path / "_SUCCESS").touch()
    r = reader(tmp_path)
    assert r.latestOffset() == {"file": "b/1.parquet", "row": 45}
    places = [r.initialOffset(), {"file": "a/1.parquet", "row": 33}, {"file": "a/1.parquet", "row": 95}, {"file": "b/1.parquet", "row": 1}, r.latestOffset()]
    assert [i for a, b in zip(places, places[1:]) for i in read_ids(r, a, b)] == list(range(140))
    assert read_ids(r, places[-1], places[-1]) == [] and read_ids(r, places[0], places[-1]) == list(range(140))
    assert all(p.end - p.begin <= 35 for p in r.partitions(places[0], places[-1])) and len(r.partitions(places[0], places[-1])) >= 5


def test_source_of_an_empty_folder(tmp_path):
    r = reader(tmp_path / "none")
    assert r.latestOffset() == r.initialOffset() and r.partitions(r.initialOffset(), r.latestOffset()) == []
    with pytest.raises(ValueError, match="schema"):
        event_source.EventSource({"path": str(tmp_path / "none")}).schema()


def test_source_goes_on_where_it_stopped(spark, tmp_path):
    event_source.register(spark)

    def run():
        stream = spark.readStream.format("session_events").schema("session_id long, text string, more double").option("path", f"file:{tmp_path}/in").option("rows", 20).load()
        streams.run_to_end(stream, str(tmp_path / "top"))
        return sorted(r["session_id"] for r in spark.read.parquet(f"{tmp_path}/top/out").collect())

    write_events(tmp_path / "in", "0001.parquet", 0, 50)
    assert run() == list(range(50))
    assert run() == list(range(50))
    write_events(tmp_path / "in", "0002.parquet", 50, 120)
    assert run() == list(range(120))
    assert spark.read.parquet(f"{tmp_path}/top/out").where("more IS NULL AND text = concat('t', session_id)").count() == 120


def test_parse_of_a_buffer_leaves_out_what_is_no_json(spark):
    buffer = "event: a\ndata: no json\n\nevent: b\n\nevent: c\ndata: {\"text\": \"x\"}\n\nevent: d\ndata: {\"te"
    done, tail = E.parse(F.lit(buffer))
    got = spark.range(1).select(done.alias("done"), tail.alias("tail")).first()
    assert [(e["event"], e["data"]["text"]) for e in got["done"]] == [("c", "x")] and got["tail"] == "event: d\ndata: {\"te"


class OneRecord:
    """A session's state that counts how often it is written."""

    exists, hasTimedOut, get, written = False, False, None, 0

    def update(self, value):
        self.get, self.exists, self.written = value, True, self.written + 1

    def setTimeoutDuration(self, _):
        pass


def test_parser_writes_its_state_once_a_batch(spark):
    import pandas as pd

    state, follow = OneRecord(), stateful._parser(60)
    frames = [f"event: token\ndata: {i}\n\n".encode() for i in range(500)]
    early = pd.DataFrame({"chunk": range(1, 500), "data": frames[1:]}).sample(frac=1, random_state=1)
    assert list(follow(("a",), iter([early[:300], early[300:]]), state)) == [] and state.written == 1
    (found,) = follow(("a",), iter([pd.DataFrame({"chunk": [7, 0, 0], "data": [b"again", frames[0], b"again"]})]), state)
    assert found["data"].tolist() == [str(i) for i in range(500)] and found["number"].tolist() == list(range(500))
    assert state.written == 2 and state.get == (500, 500, b"", [])


def test_runs_write_their_state_once_a_batch(spark):
    import pandas as pd

    class Timed(OneRecord):
        until = None

        def getCurrentWatermarkMs(self):
            return 0

        def setTimeoutTimestamp(self, ms):
            self.until = ms

    state, follow = Timed(), stateful._runs(60)
    rows = pd.DataFrame({"seq": range(200), "run_id": [n // 10 for n in range(200)], "event": "token", "text": "x", "ms": range(1000, 1200)})
    (found,) = follow(("a",), iter([rows[100:], rows[:100]]), state)
    assert found[["run_id", "seq"]].values.tolist() == [[n, 10 * n] for n in range(19)] and set(found["status"]) == {"replaced"}
    assert state.written == 1 and state.get[0] == 19 and len(state.get[4]) == 10 and state.until == 1199 + 60_000
