"""Incremental ingestion: deltas against the stored state, text, chunks with ids and vectors, the
points to delete and to put in a collection, and the next state.

Job failures do not fail a stage: a file that cannot be read, whose reader fails, whose type is not
supported or whose chunks have no vectors gets an ``error``; its points and its state are left as
they were, so that the next scan queues it again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .registry import read_with, readers

#: Rows that are numbered in one task.
RANGE = 200_000
NEW, MODIFIED, DELETED = "NEW", "MODIFIED", "DELETED"
STATE = "filepath string, collection_name string, last_modified double, hash string, chunk_ids array<string>"


def detect_deltas(scan: DataFrame, state: DataFrame, collection: str) -> DataFrame:
    """``filepath, action`` of files that are new, changed (time or hash) or gone.

    scan: ``filepath, last_modified, hash``. The state is filtered to the collection before the
    join, so other collections' rows neither match nor look deleted.
    """
    old = state.where(F.col("collection_name") == collection).select(
        "filepath", F.col("last_modified").alias("old_modified"), F.col("hash").alias("old_hash"), F.lit(True).alias("known")
    )
    both = scan.select("filepath", "last_modified", "hash", F.lit(True).alias("there")).join(old, "filepath", "full_outer")
    action = (
        F.when(F.col("known").isNull(), NEW).when(F.col("there").isNull(), DELETED)
        .when(~F.col("last_modified").eqNullSafe(F.col("old_modified")) | ~F.col("hash").eqNullSafe(F.col("old_hash")), MODIFIED)
    )
    return both.select("filepath", action.alias("action")).where("action IS NOT NULL")


def numbered(rows: DataFrame, column: str, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``id``, their numbers from 1 in the order of a column of distinct values.

    A sample's quantiles cut the column into ranges; a range's rows are numbered in a task of their
    own, after those of the ranges before it. There are ``ranges``, else one for each ``RANGE`` rows, 1024
    at most.
    """
    ranges = ranges or max(2, min(1024, -(-rows.count() // RANGE)))
    few = sorted(r[0] for r in rows.select(column).orderBy(F.xxhash64(column)).limit(16 * ranges).collect())
    cuts = sorted({few[len(few) * k // ranges] for k in range(1, ranges)}) if few else []
    of = F.lit(0)
    for cut in cuts:
        of = of + (F.col(column) >= cut).cast("int")
    dealt = rows.withColumn("_range", of)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))  # at most ``ranges`` rows
    place = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    return dealt.withColumn("_place", place).join(F.broadcast(before), "_range").withColumn("id", F.col("_before") + F.col("_place")).drop("_range", "_before", "_place")


def job_queue(deltas: DataFrame, collection: str, created_at: float) -> DataFrame:
    """Pending jobs of a scan, numbered by path: they replace whatever was queued for the collection.

    Jobs are a set that run as one plan; the number only says in which order a queue would go.
    """
    return numbered(deltas, "filepath").select(
        F.col("id").cast("long").alias("id"), "filepath", F.lit(collection).alias("collection_name"), "action", F.lit("PENDING").alias("status"), F.lit(created_at).alias("created_at"),
        F.lit(None).cast("double").alias("completed_at"), F.lit(None).cast("string").alias("error"),
    )


def replace_queue(jobs: DataFrame, new: DataFrame, collection: str) -> DataFrame:
    """All jobs of the collection, whatever their status, give way to the new ones."""
    return jobs.where(F.col("collection_name") != collection).unionByName(new)


def finish_jobs(queue: DataFrame, done: DataFrame, completed_at: float) -> DataFrame:
    """The queue with status, error and time of the jobs that ran (``filepath, status, error``)."""
    ran = done.select("filepath", F.col("status").alias("_status"), F.col("error").alias("_error"))
    return queue.join(ran, "filepath", "left").select(
        "id", "filepath", "collection_name", "action", F.coalesce("_status", "status").alias("status"), "created_at",
        F.when(F.col("_status").isNotNull(), F.lit(completed_at)).otherwise(F.col("completed_at")).alias("completed_at"), F.coalesce("_error", "error").alias("error"),
    )


def delta_counts(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def chunk_documents(docs: DataFrame, strategy: str = "fixed", size: int = 500, overlap: int = 50, vectors: Callable[[Column], Column] | None = None, threshold: float = 0.5) -> DataFrame:
    """``filepath, chunk_index, chunk_id, text`` of documents ``filepath, text``.

    Strategies: markdown, semantic (with a function from sentences to their vectors), and
    anything else is fixed size, as is a text of which a sentence has no vector.
    """
    from ..functions import vector as V

    if strategy == "markdown":
        chunks = T.chunk_markdown(F.col("text"), size, overlap)
    elif strategy == "semantic" and vectors is not None:
        docs = docs.withColumn("_parts", T.sentences(F.col("text"))).withColumn("_vectors", vectors(F.col("_parts")))
        lacking = (F.size("_parts") > 1) & F.exists("_vectors", lambda v: v.isNull())
        chunks = F.when(lacking, T.chunk_fixed(F.col("text"), size, overlap)).otherwise(T.chunk_semantic(F.col("_parts"), F.col("_vectors"), V.cosine_distance, threshold, size, overlap))
    else:
        chunks = T.chunk_fixed(F.col("text"), size, overlap)
    return docs.select("filepath", F.posexplode(chunks).alias("chunk_index", "text")).select(
        "filepath", "chunk_index", T.chunk_id(F.col("filepath"), F.col("chunk_index")).alias("chunk_id"), "text"
    )


def extracted(content: Column, mime: Column) -> Column:
    """struct<text, error> of a file's bytes: by the reader registered for its type, or the built-in way."""
    own = F.struct(T.extract(content, mime).alias("text"), F.when(~mime.isin(*T.SUPPORTED_MIME), F.concat(F.lit("unsupported MIME type: "), mime)).alias("error"))
    out = own
    for name in sorted(readers.made):
        told = read_with(readers.create(name), F.when(mime == name, content))
        out = F.when(mime == name, F.struct(T.sanitize(told["text"]).alias("text"), told["error"].alias("error"))).otherwise(out)
    return out


def run_jobs(files: DataFrame, deltas: DataFrame) -> DataFrame:
    """Jobs ``filepath, action, status, error, text``: the text of files that are new or changed.

    files: ``filepath, content`` and optionally ``mime``, which is else told by the ending. Deleted
    files, and files without text, complete with empty text.
    """
    told = files if "mime" in files.columns else files.withColumn("mime", T.mime_of(F.col("filepath")))
    jobs = deltas.join(told.select("filepath", "content", "mime"), "filepath", "left")
    todo = F.col("action") != DELETED
    jobs = jobs.withColumn("_read", extracted(F.when(todo, F.col("content")), F.col("mime")))
    error = F.when(todo, F.when(F.col("content").isNull(), "file cannot be read").otherwise(F.col("_read.error")))
    return jobs.select(
        "filepath", "action", F.when(error.isNotNull(), "FAILED").otherwise("COMPLETED").alias("status"), error.alias("error"), F.coalesce(F.when(todo, F.col("_read.text")), F.lit("")).alias("text"),
    )


@dataclass
class Run:
    """What a run does: jobs ``filepath, action, status, error``; points to delete, points to put, the next state."""

    jobs: DataFrame
    stale: DataFrame
    points: DataFrame
    state: DataFrame


def plan_run(
    scan: DataFrame, state: DataFrame, collection: str, embed: Callable[[Column], Column], strategy: str = "fixed", size: int = 500, overlap: int = 50, threshold: float = 0.5,
    store: Callable[[DataFrame, str], DataFrame] = lambda df, _: df,
) -> Run:
    """From a scan (``filepath, last_modified, hash, content``) to what changes in a collection.

    Chunks of the old version of a changed or deleted file are stale, those of a file whose job
    failed are not. ``store`` writes a table that several results read, and reads it back; without
    it everything is computed where it is used.
    """
    jobs = store(run_jobs(scan, detect_deltas(scan, state, collection)), "jobs")
    todo = jobs.where((F.col("action") != DELETED) & (F.col("status") == "COMPLETED")).select("filepath", "text")
    sentence_vectors = (lambda parts: F.transform(parts, embed)) if strategy == "semantic" else None
    embedded = store(chunk_documents(todo, strategy, size, overlap, sentence_vectors, threshold).withColumn("dense", embed(F.col("text"))), "chunks")
    failed = embedded.where("dense IS NULL").select("filepath").distinct().withColumn("_failed", F.lit("a chunk has no vector"))
    ended = jobs.select("filepath", "action", "status", "error").join(failed, "filepath", "left").select(
        "filepath", "action", F.when(F.col("_failed").isNotNull(), "FAILED").otherwise(F.col("status")).alias("status"), F.coalesce("error", "_failed").alias("error")
    )
    done = ended.where("status = 'COMPLETED'")
    chunks = embedded.join(done.select("filepath"), "filepath", "left_semi")
    old = state.where(F.col("collection_name") == collection).join(done.where(F.col("action") != NEW).select("filepath"), "filepath", "left_semi")
    points = chunks.select(F.col("chunk_id").alias("id"), "dense", "text", "filepath", "chunk_index")
    return Run(ended, old.select(F.explode("chunk_ids").alias("id")).distinct(), points, merge_state(state, scan, ended, chunks, collection))


def changed(points: DataFrame, run: Run) -> DataFrame:
    """A collection's points after a run."""
    return upsert(delete(points, run.stale), run.points)


def merge_state(state: DataFrame, scan: DataFrame, jobs: DataFrame, chunks: DataFrame, collection: str) -> DataFrame:
    """The state after the jobs: done files replaced, deleted ones removed, failed ones as before.

    A file without chunks is still recorded, with no chunk ids.
    """
    done = jobs.where("status = 'COMPLETED'")
    ids = chunks.groupBy("filepath").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id"))).alias("c")).select("filepath", F.col("c.chunk_id").alias("chunk_ids"))
    fresh = (
        scan.join(done.where(F.col("action") != DELETED).select("filepath"), "filepath", "left_semi").join(ids, "filepath", "left")
        .select("filepath", F.lit(collection).alias("collection_name"), "last_modified", "hash", F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"))
    )
    kept = state.join(done.select("filepath", F.lit(collection).alias("collection_name")), ["filepath", "collection_name"], "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


def upsert(points: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace old ones of the same key; of several new ones the last ``_order`` wins."""
    if "_order" in new.columns:
        rest = [c for c in new.columns if c != key]
        new = new.groupBy(key).agg(F.max_by(F.struct(*rest), "_order").alias("r")).select(key, "r.*").drop("_order")
    return points.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(points: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return points.join(ids.select(key), key, "left_anti")


def zip_points(ids: Column, vectors: Column) -> Column:
    """Ids with their vectors by position; unequal counts raise instead of being cut short."""
    return F.when(F.size(ids) == F.size(vectors), F.arrays_zip(ids, vectors)).otherwise(F.raise_error(F.lit("ids and vectors differ in number")))
