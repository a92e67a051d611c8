"""The jobs over growing input, on copies: runs take only what is new, and repeat without change."""

import json
import os
import subprocess
import sys

import pytest
from compare import duckdb_rows, rows_of, spark_rows

from jobs import ingest_corpus, queries, settings, stream_sessions

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_equal_their_sql(spark, sf_dir, name):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == duckdb_rows(queries.ORACLE_SQL[name], sf_dir)


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, hash string, bucket string").repartition(2).write.mode("overwrite").parquet(path)


def row(i, text):
    return (i, text, "clash", "clash")


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


CONFIG = {"size": 40, "overlap": 10, "buckets": 8}


def plain_chunks(spark, rows):
    from gleaner.functions import text as T
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = docs.select("doc_id", F.posexplode(T.chunk_fixed(F.col("text"), 40, 10)).alias("chunk_index", "text"))
    return sorted(tuple(r) for r in cut.collect())


def stored(spark, out):
    return sorted(tuple(r) for r in ingest_corpus.chunks(spark, out).select("doc_id", "chunk_index", "text").collect())


def test_ingest_takes_only_what_changed(spark, tmp_path):
    source, out = str(tmp_path / "documents"), str(tmp_path / "store")
    first = {i: f"Document {i} has some words. " * (i % 5) for i in range(60)}
    documents(spark, source, [row(i, t) for i, t in first.items()])
    done = ingest_corpus.ingest_corpus(spark, source, out, CONFIG)
    assert (done["new"], done["modified"], done["deleted"], done["buckets"]) == (60, 0, 0, 8)
    assert stored(spark, out) == plain_chunks(spark, list(first.items()))

    before = files_of(out)
    assert ingest_corpus.ingest_corpus(spark, source, out, CONFIG)["buckets"] == 0
    assert files_of(out) == before

    second = {**first, 3: "Now it says something else entirely, and at more length than before.", 100: "A new one."}
    del second[7]
    documents(spark, source, [row(i, t) for i, t in second.items()])
    done = ingest_corpus.ingest_corpus(spark, source, out, CONFIG)
    assert (done["new"], done["modified"], done["deleted"]) == (1, 1, 1) and done["buckets"] <= 3
    assert stored(spark, out) == plain_chunks(spark, list(second.items()))
    untouched = {p for p in before if p in files_of(out)}
    assert len({p.split("bucket=")[1][0] for p in untouched}) == 8 - done["buckets"]

    documents(spark, source, [row(i, t) for i, t in first.items()])  # one comes back, one goes again
    done = ingest_corpus.ingest_corpus(spark, source, out, CONFIG)
    assert (done["new"], done["modified"], done["deleted"]) == (1, 1, 1)
    assert stored(spark, out) == plain_chunks(spark, list(first.items()))


def test_ingest_of_nothing_deletes_all_and_again_nothing(spark, tmp_path):
    source, out = str(tmp_path / "documents"), str(tmp_path / "store")
    documents(spark, source, [row(i, "text " * i) for i in range(10)])
    ingest_corpus.ingest_corpus(spark, source, out, CONFIG)
    documents(spark, source, [])
    assert ingest_corpus.ingest_corpus(spark, source, out, CONFIG)["deleted"] == 10
    assert stored(spark, out) == []
    assert ingest_corpus.ingest_corpus(spark, source, out, CONFIG)["buckets"] == 0
    assert ingest_corpus.ingest_corpus(spark, source, str(tmp_path / "other"), CONFIG)["buckets"] == 0
    assert stored(spark, str(tmp_path / "other")) == []


def test_ingest_of_odd_rows(spark, tmp_path):
    source, out = str(tmp_path / "documents"), str(tmp_path / "store")
    documents(spark, source, [row(1, None), row(2, ""), row(None, "no id"), row(3, "twice"), row(3, "twice"), row(4, "a"), row(4, "b"), row(5, "long " * 20_000)])
    done = ingest_corpus.ingest_corpus(spark, source, out, CONFIG)
    assert (done["new"], done["without_id"], done["rows"]) == (5, 1, 8)
    got = stored(spark, out)
    assert {i for i, _, _ in got} == {3, 4, 5} and [r for r in got if r[0] == 3] == [(3, 0, "twice")] and len([r for r in got if r[0] == 4]) == 1
    assert ingest_corpus.ingest_corpus(spark, source, out, CONFIG)["buckets"] == 0


def test_a_failed_ingest_run_is_made_good(spark, tmp_path, monkeypatch):
    source, out = str(tmp_path / "documents"), str(tmp_path / "store")
    documents(spark, source, [row(i, f"text {i}") for i in range(20)])
    ingest_corpus.ingest_corpus(spark, source, out, CONFIG)
    documents(spark, source, [row(i, f"text {i} {i % 2}") for i in range(30)])
    before = stored(spark, out)
    with monkeypatch.context() as m:
        m.setattr(ingest_corpus, "fresh_rows", lambda docs, config: docs.select("doc_id", "hash").selectExpr("*", "false AS deleted", "0 AS chunk_index", "'x' AS chunk_id", "raise_error('disk full') AS text"))
        with pytest.raises(Exception, match="disk full"):
            ingest_corpus.ingest_corpus(spark, source, out, CONFIG)
    assert stored(spark, out) == before
    ingest_corpus.ingest_corpus(spark, source, out, CONFIG)
    assert stored(spark, out) == plain_chunks(spark, [(i, f"text {i} {i % 2}") for i in range(30)])


def turns(spark, path, rows, mode="append"):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, bucket string").coalesce(1).write.mode(mode).parquet(path)


def talk(conv, n, start=0):
    return [(conv, i, "user" if i % 2 == 0 else "assistant", f"message {i} of {conv} " * (i % 7 + 1), "clash") for i in range(start, start + n)]


def sessions_of(spark, rows):
    kept = spark.createDataFrame([r[:4] for r in rows], stream_sessions.SOURCE)
    told = kept.where("conv_id IS NOT NULL").selectExpr("conv_id AS session_id", "turn", "role", "coalesce(text, '') AS content")
    return plain(stream_sessions.summed_up(told.withColumn("bucket", settings.bucket_of(told["session_id"].cast("string"), 4)), 20))


def plain(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()]), sorted(df.columns)


def run(spark, tmp_path, **more):
    return stream_sessions.stream_sessions(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), {"buckets": 4, "preview": 20, **more})


def test_stream_takes_only_new_files(spark, tmp_path):
    rows = talk(1, 5) + talk(2, 3) + talk(3, 8)
    turns(spark, str(tmp_path / "in"), rows)
    assert run(spark, tmp_path) == {"batches": 1, "rows": 16}
    assert plain(stream_sessions.read_sessions(spark, str(tmp_path / "out"))) == sessions_of(spark, rows)
    before = files_of(tmp_path / "out")
    assert run(spark, tmp_path) == {"batches": 0, "rows": 0} and files_of(tmp_path / "out") == before

    more = talk(2, 4, 3) + talk(9, 2) + talk(1, 2)  # an older session grows, a new one begins, turns come twice
    turns(spark, str(tmp_path / "in"), more)
    assert run(spark, tmp_path) == {"batches": 1, "rows": 8}
    assert plain(stream_sessions.read_sessions(spark, str(tmp_path / "out"))) == sessions_of(spark, rows + more)
    assert stream_sessions.read_turns(spark, str(tmp_path / "out")).count() == 24


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    turns(spark, str(tmp_path / "in"), talk(1, 5) + talk(2, 3))
    run(spark, tmp_path)
    turns(spark, str(tmp_path / "in"), talk(1, 5, 5))
    run(spark, tmp_path)
    want, n = plain(stream_sessions.read_sessions(spark, str(tmp_path / "out"))), stream_sessions.read_turns(spark, str(tmp_path / "out")).count()
    for name in ("1", ".1.crc"):  # as if the run had died between writing and committing its second batch
        os.remove(tmp_path / "checkpoint" / "commits" / name)
    assert run(spark, tmp_path)["rows"] == 5
    assert plain(stream_sessions.read_sessions(spark, str(tmp_path / "out"))) == want
    assert stream_sessions.read_turns(spark, str(tmp_path / "out")).count() == n


def test_a_batch_that_dies_between_its_tables_is_made_good(spark, tmp_path, monkeypatch):
    turns(spark, str(tmp_path / "in"), talk(1, 5))
    with monkeypatch.context() as m:
        m.setattr(stream_sessions, "summed_up", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            run(spark, tmp_path)
    assert run(spark, tmp_path)["rows"] == 5
    assert plain(stream_sessions.read_sessions(spark, str(tmp_path / "out"))) == sessions_of(spark, talk(1, 5))


def test_stream_in_several_batches_and_odd_rows(spark, tmp_path):
    rows = [(None, 1, "user", "no session", ""), (5, 0, "system", None, ""), (5, 1, "user", "x" * 50_000, ""), (5, 1, "user", "x" * 50_000, ""), (6, 0, None, "who", ""), (6, None, "user", "when", "")]
    for some in (rows[:3], rows[3:], talk(7, 300)):
        turns(spark, str(tmp_path / "in"), some)
    assert run(spark, tmp_path, files_per_batch=1)["batches"] == 3
    assert plain(stream_sessions.read_sessions(spark, str(tmp_path / "out"))) == sessions_of(spark, rows + talk(7, 300))


def test_stream_of_nothing(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    assert run(spark, tmp_path) == {"batches": 0, "rows": 0}
    assert stream_sessions.read_sessions(spark, str(tmp_path / "out")).collect() == []


def test_settings(spark, tmp_path):
    for job, name in ((ingest_corpus, "ingest_corpus"), (stream_sessions, "stream_sessions")):
        assert settings.load_settings(spark, f"{ROOT}/jobs/{name}.json", job.DEFAULTS) == job.DEFAULTS
        assert settings.load_settings(spark, None, job.DEFAULTS) == job.DEFAULTS
    (tmp_path / "odd.json").write_text(json.dumps({"bucketz": 3}))
    with pytest.raises(ValueError, match="bucketz"):
        settings.load_settings(spark, str(tmp_path / "odd.json"), ingest_corpus.DEFAULTS)


def test_queries_leave_settings_and_use_new_folders(spark, sf_dir):
    before = dict(spark.sparkContext.getConf().getAll()), {k: spark.conf.get(k) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    assert queries.new_folder(spark, "job1") != queries.new_folder(spark, "job1")
    queries.job2_stream_sessions(spark, sf_dir)
    assert ({k: spark.conf.get(k) for k in before[1]}) == before[1]


def test_command_line(tmp_path):
    out = str(tmp_path / "store")
    args = [sys.executable, f"{ROOT}/jobs/ingest_corpus.py", "--documents", "/root/testdata/sf0.001/documents.parquet", "--out", out, "--config", f"{ROOT}/jobs/ingest_corpus.json"]
    done = subprocess.run(args, capture_output=True, text=True, timeout=240, check=True, cwd=tmp_path)
    assert "'NEW': 200" in done.stderr and len(os.listdir(out)) > 50
