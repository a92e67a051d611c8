"""The jobs as queries over the given tables: each runs twice into a new folder and returns its whole output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.functions import text as T
from gleaner.plans.catalogue import chunk_sql, uuid5_sql
from gleaner.plans.streams import new_folder
from jobs import ingest_corpus, stream_sessions


def job1_ingest_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{new_folder(spark, 'job1')}/store"
    for _ in range(2):
        ingest_corpus.ingest_corpus(spark, f"{sf_dir}/documents.parquet", out)
    return ingest_corpus.chunks(spark, out)


def job2_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = new_folder(spark, "job2")
    for _ in range(2):
        # A file stream takes folders and patterns; the pattern fits the table whether it is a folder or one file.
        stream_sessions.stream_sessions(spark, f"{sf_dir}/conversations.parque[t]", f"{top}/out", f"{top}/checkpoint")
    return stream_sessions.read_sessions(spark, f"{top}/out")


def _bucket(key: str, buckets: int) -> str:
    return f"(('0x' || md5({key})[1:4])::INT % {buckets})::INT"


QUERIES = {f.__name__: f for f in (job1_ingest_corpus, job2_stream_sessions)}

ORACLE_SQL = {
    "job1_ingest_corpus": f"""
WITH c AS ({chunk_sql("SELECT doc_id, text FROM documents", ingest_corpus.DEFAULTS["size"], ingest_corpus.DEFAULTS["overlap"])})
SELECT doc_id, chunk_index, {uuid5_sql(T.CHUNK_NAMESPACE, "doc_id || '_' || chunk_index")} AS chunk_id, text, {_bucket("doc_id::VARCHAR", ingest_corpus.DEFAULTS["buckets"])} AS bucket FROM c""",
    "job2_stream_sessions": f"""
WITH t AS (SELECT conv_id AS session_id, turn, min((role, coalesce(text, ''))) AS m FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL),
p AS (SELECT session_id, turn, m[1] AS role, m[2] AS content, CASE WHEN length(m[2]) > 60 THEN left(m[2], 60) || '...' ELSE m[2] END AS said FROM t)
SELECT session_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user, sum(length(content))::BIGINT AS n_chars, min_by(said, turn) FILTER (role = 'user') AS title,
       max_by(role, turn) AS last_role, max_by(said, turn) AS last_message, max(turn) AS last_turn, {_bucket("session_id::VARCHAR", stream_sessions.DEFAULTS["buckets"])} AS bucket
FROM p GROUP BY session_id""",
}
