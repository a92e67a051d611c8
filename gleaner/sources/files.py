"""Files as tables: scans, listings, and session histories."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

FILE_TYPES = (".pdf", ".txt", ".md", ".html")
_EMPTY = "path string, modificationTime timestamp, length long, content binary"


def _files(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], _EMPTY)


def scan_directory(spark: SparkSession, path: str, file_types: tuple[str, ...] = FILE_TYPES) -> DataFrame:
    """``filepath, last_modified (epoch), content, hash`` of files of the given endings, any case.

    A folder that is not there has no files.
    """
    kept = _files(spark, path).where(T.ending(F.col("path")).isin([t.lower() for t in file_types]))
    return kept.select(
        F.col("path").alias("filepath"), F.col("modificationTime").cast("double").alias("last_modified"), "content", F.sha2("content", 256).alias("hash")
    )


def deltas_of_directory(spark: SparkSession, path: str, state: DataFrame, collection: str, file_types: tuple[str, ...] = FILE_TYPES) -> DataFrame:
    """Deltas of a folder; a folder that is not there queues nothing, not even deletions."""
    from ..operators.ingest import detect_deltas

    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "filepath string, action string")
    return detect_deltas(scan_directory(spark, path, file_types).drop("content"), state, collection)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``name, path, size, uploaded_at`` without reading any content."""
    return _files(spark, path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path", F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("uploaded_at"))


def read_images(contents: DataFrame, sandbox: str, column: str = "content") -> DataFrame:
    """``bytes, mime`` of data URLs and raw base64; ``file`` of paths inside the sandbox folder.

    The three forms are tried in that order; what is none of them has an ``error``.
    """
    c = F.col(column)
    is_url, inside = c.startswith("data:"), c.startswith(sandbox.rstrip("/") + "/") & ~c.contains("..")
    raw = F.try_to_binary(c, F.lit("base64"))
    return contents.select(
        "*",
        F.when(is_url, F.try_to_binary(F.regexp_extract(c, r"(?s)^[^,]*,(.*)$", 1), F.lit("base64"))).when(~inside & (F.length(raw) > 10), raw).alias("bytes"),
        F.when(is_url, F.regexp_extract(c, r"^data:([^;,]*)", 1)).when(~inside & (F.length(raw) > 10), "image/png").alias("mime"),
        F.when(~is_url & inside, c).alias("file"),
    ).withColumn("error", F.when(F.col("bytes").isNull() & F.col("file").isNull(), "not an image or outside the allowed folder"))


def image_bytes(contents: DataFrame, sandbox: str, column: str = "content") -> DataFrame:
    """``read_images`` with the bytes, types and, where it is missing, the error of files as well.

    The folder's files are matched by their paths below it; only those asked for leave the scan's tasks.
    """
    root = f"{sandbox.rstrip('/')}/"
    told = read_images(contents, sandbox, column).withColumn("_below", F.substring(F.col("file"), F.lit(len(root) + 1), F.length("file")))
    plain = re.sub(r"^[a-z0-9+.-]+:/+", "/", root)
    asked = told.where("_below IS NOT NULL").select("_below").distinct()
    files = _files(contents.sparkSession, sandbox).select(F.substring_index("path", plain, -1).alias("_below"), F.col("content").alias("_content")).join(asked, "_below", "left_semi")
    return told.join(files, "_below", "left").select(
        *contents.columns, F.coalesce("bytes", "_content").alias("bytes"),
        F.coalesce("mime", F.when(F.col("_content").isNotNull(), F.when(T.ending(F.col("file")).isin(".jpg", ".jpeg"), "image/jpeg").otherwise(F.concat(F.lit("image/"), F.substring(T.ending(F.col("file")), 2, 9))))).alias("mime"),
        F.coalesce("error", F.when(F.col("file").isNotNull() & F.col("_content").isNull(), "no such file")).alias("error"),
    )


def write_sessions(turns: DataFrame, path: str) -> None:
    """Store the histories (``session_id, turn, role, content``) of many sessions at once, each in a folder of its own.

    The sessions of ``turns`` replace what is stored of them, all others stay as they are; an id that is no
    session id raises before anything is written.
    """
    named = turns.withColumn("session_id", F.col("session_id").cast("string"))
    odd = named.where(~F.coalesce(F.col("session_id").rlike(r"^[a-zA-Z0-9_-]+$"), F.lit(False))).select("session_id").first()
    if odd is not None:
        raise ValueError(f"not a session id: {odd['session_id']!r}")
    dealt = named.select("session_id", "turn", "role", "content").repartition("session_id").sortWithinPartitions("session_id", "turn")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").json(path)


def read_stored_sessions(spark: SparkSession, path: str) -> DataFrame:
    """``session_id, turn, role, content`` of what ``write_sessions`` has stored."""
    return spark.read.schema("turn long, role string, content string, session_id string").json(path).select("session_id", "turn", "role", "content")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """``session_id, turn, role, content, updated_at`` of histories kept as one JSON array a file."""
    entry = "array<struct<role:string,content:string>>"
    rows = _files(spark, path).where(F.col("path").endswith(".json"))
    items = F.coalesce(F.from_json(F.col("content").cast("string"), entry), F.array().cast(entry))
    return rows.select(
        F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("session_id"), F.col("modificationTime").cast("double").alias("updated_at"), F.posexplode(items).alias("turn", "m")
    ).select("session_id", "turn", "m.role", "m.content", "updated_at")


def write_session(spark: SparkSession, path: str, session_id: str, turns: DataFrame) -> None:
    """Store one session's history (``turn, role, content``) as a JSON array; it replaces the old."""
    if not re.fullmatch(r"[a-zA-Z0-9_-]+", session_id):
        raise ValueError(f"not a session id: {session_id!r}")
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "content")))
    row = turns.agg(F.to_json(F.transform(ordered, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("j")).first()
    fs, target = _path(spark, f"{path.rstrip('/')}/{session_id}.json")
    out = fs.create(target, True)
    out.write(bytearray(row["j"] or "[]", "utf-8"))
    out.close()


def delete_session(spark: SparkSession, path: str, session_id: str) -> None:
    """Remove a session's history and uploads; a missing session raises."""
    fs, target = _path(spark, f"{path.rstrip('/')}/{session_id}.json")
    if not fs.delete(target, False):
        raise FileNotFoundError(session_id)
    fs.delete(_path(spark, f"{path.rstrip('/')}/uploads/{session_id}")[1], True)


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target
