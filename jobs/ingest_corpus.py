"""Job 1, incremental ingestion: keeps a store of chunks in step with a table of documents.

    spark-submit jobs/ingest_corpus.py --documents PATH --out PATH [--config jobs/ingest_corpus.json]

A run compares ids and content hashes with what the store holds, cuts new and changed documents into
chunks, and overwrites only the buckets (partitions of the store) in which something changed; chunks of
unchanged documents there are carried over as they are. The store's own rows are the mark: the first row
of each document tells its hash, so data and mark are one write and a run that dies leaves both as they
were. The same input again changes nothing and writes nothing.

The store: ``doc_id, hash, deleted, chunk_index, chunk_id, text``, partitioned by ``bucket``. A document
without chunks (empty text), or one that is gone, has one row with a null chunk; ``chunks`` leaves these out.

Defined results: rows without an id cannot be told apart from run to run and are left out (and logged); of
rows that share an id the one of greatest hash counts; a null text is an empty one; an empty table marks
everything deleted; other columns are ignored.
"""

from __future__ import annotations

import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import ingest
from jobs.settings import bucket_of, checked_settings, command_line, load_settings, log, read_if_there

CUTTERS = {"fixed": T.chunk_fixed, "markdown": T.chunk_markdown}
DEFAULTS = {"collection": "documents", "strategy": "fixed", "size": 500, "overlap": 50, "buckets": 64}
STORE = "doc_id long, hash string, deleted boolean, chunk_index int, chunk_id string, text string, bucket int"


def read_store(spark: SparkSession, out: str) -> DataFrame:
    return read_if_there(spark, out, STORE)


def chunks(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of all documents that are there."""
    return read_store(spark, out).where("chunk_index IS NOT NULL").select("doc_id", "chunk_index", "chunk_id", "text", "bucket")


def marks(store: DataFrame) -> DataFrame:
    """``doc_id, hash`` of documents in the store: its first row of each, no shuffle."""
    return store.where("coalesce(chunk_index, 0) = 0 AND NOT deleted").select("doc_id", "hash")


def _state(rows: DataFrame, collection: str) -> DataFrame:
    return rows.select(
        F.col("doc_id").cast("string").alias("filepath"), F.lit(collection).alias("collection_name"), F.lit(0.0).alias("last_modified"), "hash", F.array().cast("array<string>").alias("chunk_ids")
    )


def fresh_rows(docs: DataFrame, config: dict) -> DataFrame:
    """Store rows of documents ``doc_id, hash, text``: one a chunk, one where there is none."""
    cut = CUTTERS[config["strategy"]](F.coalesce("text", F.lit("")), config["size"], config["overlap"])
    rows = docs.select("doc_id", "hash", F.lit(False).alias("deleted"), F.posexplode_outer(cut).alias("chunk_index", "text"))
    return rows.withColumn("chunk_id", F.when(F.col("chunk_index").isNotNull(), T.chunk_id(F.col("doc_id").cast("string"), F.col("chunk_index"))))


def ingest_corpus(spark: SparkSession, documents: str, out: str, config: dict | None = None) -> dict[str, int]:
    """One run; what it did, in documents and buckets."""
    config = checked_settings(config or {}, DEFAULTS)
    docs = spark.read.parquet(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text_hash = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    hashed = docs.withColumn("hash", text_hash)
    seen = hashed.groupBy("doc_id").agg(F.max("hash").alias("hash"), F.count(F.lit(1)).alias("n")).cache()
    store = read_store(spark, out)
    deltas = ingest.detect_deltas(_state(seen.where("doc_id IS NOT NULL"), config["collection"]), _state(marks(store), config["collection"]), config["collection"])
    deltas = deltas.select(F.col("filepath").cast("long").alias("doc_id"), "action", bucket_of(F.col("filepath"), config["buckets"]).alias("bucket")).cache()
    try:
        found = deltas.groupBy("bucket", "action").agg(F.count(F.lit(1)).alias("n")).collect()  # three rows a bucket at most
        read = seen.agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("odd")).first()
        counts = {action: sum(r["n"] for r in found if r["action"] == action) for action in (ingest.NEW, ingest.MODIFIED, ingest.DELETED)}
        touched = sorted({r["bucket"] for r in found})
        log.info("read %s rows of %s, %s without an id: %s", read["rows"] or 0, documents, read["odd"] or 0, counts)
        if touched:
            changed = deltas.select("doc_id", "action")
            todo = changed.where(F.col("action") != ingest.DELETED).join(seen.select("doc_id", F.col("hash").alias("wanted")), "doc_id")
            new = hashed.join(todo, "doc_id").where("hash = wanted").dropDuplicates(["doc_id"])
            gone = changed.where(F.col("action") == ingest.DELETED).select("doc_id", F.lit(None).cast("string").alias("hash"), F.lit(True).alias("deleted"))
            rows = fresh_rows(new, config).unionByName(gone, allowMissingColumns=True).withColumn("bucket", bucket_of(F.col("doc_id").cast("string"), config["buckets"]))
            kept = store.where(F.col("bucket").isin(touched)).join(changed, "doc_id", "left_anti")
            # Partitions of even size, whatever a bucket holds: adaptive execution splits and merges them.
            rows.unionByName(kept).hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(out)
        log.info("wrote %s of %s buckets of %s", len(touched), config["buckets"], out)
    finally:
        deltas.unpersist(), seen.unpersist()
    return {**{k.lower(): v for k, v in counts.items()}, "buckets": len(touched), "rows": read["rows"] or 0, "without_id": read["odd"] or 0}


if __name__ == "__main__":
    command_line(
        "ingest-corpus: keep a store of chunks in step with a table of documents",
        {"documents": "Parquet table of documents", "out": "folder of the store"},
        lambda spark, config, documents, out: ingest_corpus(spark, documents, out, load_settings(spark, config, DEFAULTS)),
    )
