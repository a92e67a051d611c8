"""Operator 8, exact dedup by content sort (DataFrame operations only).

Sampled splitters range-partition the normalised texts (``repartitionByRange`` samples them),
each partition is sorted externally so that equal texts are neighbours, and runs of fully equal
neighbours are reduced to the row that stays: that is where copies are found. Splitters look at a
text's first ``SPLITTER`` code points and then at a hash, so that what is sampled to the driver
stays small however long texts are, and texts that share a long beginning still part; the sort and
the comparison of neighbours are over the whole texts.

A text whose copies would fill a good part of a range partition, or many of them, is seen in a
sample of the rows. Only the copies of such hot texts get a salt, are dealt over many ranges, and
their per-salt winners, a few slim rows a text, meet in a second step by digest. The salt is that of a
row's key, or of a number written with the rows of hot texts, so that rows which share their id and
text part as well.

Defined results: null text counts as empty; rows with equal id and text are one group in which
one row stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE_SPACE, partitions, stage

#: Code points of a text that splitters look at.
SPLITTER = 64
#: Parts that a hot text's copies are dealt to at least; rows that are sampled to find such texts.
SALTS, SAMPLE = 256, 100_000
#: A text is hot if this many of the sampled rows, and half a partition's share, are its copies.
HOT = 64


def _hot_marks(rows: DataFrame, n: int) -> list[int]:
    """Hashes of the texts that fill half a partition's share of a sample: fewer than 2 n."""
    total = rows.count()
    least = 1 << 30 if total <= SAMPLE else int(SAMPLE / total * (1 << 30)) + 1
    sample = rows.where(F.rand(8) * (1 << 30) < least)
    seen = sample.groupBy("mark").agg(F.count(F.lit(1)).alias("copies"))
    return [r["mark"] for r in seen.where(F.col("copies") > max(HOT, min(total, SAMPLE) // (2 * n))).select("mark").collect()]


def sorted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """The content sort: per row its place in its run of equal neighbours, and the run's first row and length.

    ``salt`` is 0 but for copies of hot texts, which form a run for each salt.
    """
    key = [row_col] if row_col else []
    n = partitions(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*key, F.col(id_col).alias("doc_id"), F.translate(text, WHITE_SPACE, "").alias("norm"), F.length(text).alias("n_chars")).withColumn("mark", F.xxhash64("norm"))
    hot = _hot_marks(rows, n)
    rows = rows.withColumn("salt", F.lit(0))
    if hot:
        is_hot = F.col("mark").isin(hot)
        copies = rows.where(is_hot).withColumn("number", F.col(row_col) if row_col else F.monotonically_increasing_id())
        copies = copies if row_col else stage(copies, "hot-copies")
        rows = rows.where(~is_hot).unionByName(copies.withColumn("salt", (F.pmod(F.xxhash64("number"), F.lit(max(SALTS, n))) + 1).cast("int")).drop("number"))
    # A constant among the sort keys would cost the windows a second shuffle of the texts.
    by = ["head", "mark", *["salt"] * bool(hot)]
    sorted_rows = rows.withColumn("head", F.substring("norm", 1, SPLITTER)).repartitionByRange(n, *by)
    run = Window.partitionBy(*by, "norm")
    best = run.orderBy(F.desc("n_chars"), "doc_id", *key)
    return sorted_rows.select(
        *key, "doc_id", "salt", "n_chars",
        F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"),
        F.row_number().over(best).alias("place"), F.first("doc_id").over(best).alias("first_id"),
        F.count(F.lit(1)).over(run).alias("copies"),
    )


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after deleting white space. The longest original text, then
    the smallest id, stays. ``row_col``: a key of each row, returned with its answer.
    """
    key = [row_col] if row_col else []
    slim = stage(sorted_runs(docs, id_col, text_col, row_col), "exact")

    def answer(rows: DataFrame, keep_id, size, kept) -> DataFrame:
        return rows.select(*key, "doc_id", keep_id.alias("keep_id"), size.cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))

    done = answer(slim.where("salt = 0"), F.col("first_id"), F.col("copies"), F.col("place") == 1)
    hot = slim.where("salt > 0")
    text_of = Window.partitionBy("sha")
    winners = hot.where("place = 1").select(
        "sha", "salt",
        F.min(F.struct((-F.col("n_chars")).alias("n"), "doc_id", F.col("salt").alias("of"))).over(text_of).alias("best"),
        F.sum("copies").over(text_of).alias("group_size"),
    )
    rest = answer(hot.join(winners, ["sha", "salt"]), F.col("best.doc_id"), F.col("group_size"), (F.col("place") == 1) & (F.col("salt") == F.col("best.of")))
    return done.unionByName(rest)


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id)
"""
