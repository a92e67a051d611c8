"""Chat sessions: history, summaries, prompt assembly, and checks on what is uploaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Limits on uploads.
FILE_TYPES = ("text/plain", "text/markdown", "text/html", "application/pdf")
MAX_FILE_BYTES, MAX_FILES = 20_971_520, 5
IMAGE_TYPES = ("image/png",)
MIN_SIDE, MAX_SIDE = 128, 1024
#: The two messages of a failed run.
RATE_LIMITED = "Rate limit quota exceeded (HTTP 429: Too Many Requests)."


def summaries(turns: DataFrame, updated: Column) -> DataFrame:
    """``session_id, last_message, updated_at``, newest first; turns: ``session_id, turn, content``."""
    return turns.groupBy("session_id").agg(
        T.preview(F.coalesce(F.max_by("content", "turn"), F.lit(""))).alias("last_message"), F.max(updated).alias("updated_at")
    ).orderBy(F.desc("updated_at"), "session_id")


def history(turns: DataFrame, session_id: str | int) -> DataFrame:
    return turns.where(F.col("session_id") == session_id).orderBy("turn")


def append_turn(turns: DataFrame, new: DataFrame) -> DataFrame:
    """New messages (``session_id, role, content``) after each session's last turn."""
    last = turns.groupBy("session_id").agg(F.max("turn").alias("last"))
    placed = new.join(last, "session_id", "left").withColumn("turn", F.coalesce(F.col("last") + 1, F.lit(0)))
    return turns.unionByName(placed.select(*turns.columns))


def assemble(turns: DataFrame) -> DataFrame:
    """One prompt per session: its messages in order, a blank line between them."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "content")))
    said = F.transform(ordered, lambda x: F.concat(F.lit("["), x["role"], F.lit("] "), x["content"]))
    return turns.groupBy("session_id").agg(F.array_join(said, "\n\n").alias("prompt"), F.count(F.lit(1)).alias("n_turns"))


def file_block(name: Column, text: Column) -> Column:
    return F.concat(F.lit("[FILE: "), name, F.lit("]\n"), text, F.lit("\n[/FILE]"))


def with_files(files: DataFrame, prompts: DataFrame) -> DataFrame:
    """Prompts (``session_id, prompt``) after the blocks of their files (``session_id, seq, name, text``)."""
    blocks = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", file_block(F.col("name"), F.col("text")).alias("b")))), lambda x: x["b"]), "\n\n")
    joined = prompts.join(files.groupBy("session_id").agg(blocks.alias("blocks")), "session_id", "left")
    return joined.select("session_id", F.concat(F.coalesce(F.concat("blocks", F.lit("\n\n")), F.lit("")), F.col("prompt")).alias("prompt"))


def file_verdict(mime: Column, size: Column) -> Column:
    """Why a file is refused, null if it is not; the type is looked at first."""
    return F.when(~mime.isin(*FILE_TYPES), "unsupported type").when(size > MAX_FILE_BYTES, "too large")


def upload_verdicts(files: DataFrame, message: str = "message_id") -> DataFrame:
    """Files (``mime``, ``size``) of messages with ``problem``; a message of more than ``MAX_FILES`` is refused as a whole."""
    counts = files.groupBy(message).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > MAX_FILES)
    problem = F.when(F.col("_n").isNotNull(), "too many files").otherwise(file_verdict(F.col("mime"), F.col("size")))
    return files.join(counts, message, "left").withColumn("problem", problem).drop("_n")


def image_verdict(mime: Column, width: Column, height: Column, types=IMAGE_TYPES, least: int = MIN_SIDE) -> Column:
    return F.when(~F.coalesce(mime, F.lit("image/png")).isin(*types), "unsupported format").when((width < least) | (height < least), "too small")


def resized(width: Column, height: Column, most: int = MAX_SIDE) -> Column:
    """struct<width, height>: scaled down to fit, proportions kept, truncated to whole pixels."""
    ratio = F.least(F.lit(float(most)) / width, F.lit(float(most)) / height)
    fits = (width <= most) & (height <= most)
    return F.struct(
        F.when(fits, width).otherwise((width * ratio).cast("int")).alias("width"), F.when(fits, height).otherwise((height * ratio).cast("int")).alias("height")
    )


def valid_session_id(value: Column) -> Column:
    return value.rlike(r"^[a-zA-Z0-9_-]+$")


def first_by_name(files: DataFrame, key: str = "name", order: str = "seq") -> DataFrame:
    """Of files with one name the first that came."""
    rest = [c for c in files.columns if c != key]
    return files.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
