"""From raw documents to packed sequences: language, copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read
back as the next one's docs; all but the last return the columns of ``documents``. What a stage
has staged for itself is deleted when the next stage begins, unless that one's docs still read it.

Defined results. Copies, near copies and mixture are decided for each row, so rows that repeat a
document leave one of them, and rows that share an id (or have none) with different texts are
documents of their own. Null, empty and letterless texts are in no language and go with the first
stage; alone, the second keeps one empty text, the third every one (they have no shingles), and the
fourth none (it takes no words of them). Ties between copies go to the smaller id. Very long texts
are whole everywhere. An empty table gives an empty result, and columns beyond those of
``documents`` come along under any name.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import exact_dedup, language_id, mixing, ngram_join, packing, queries
from gleaner.llm.common import drop, free_name, keyed, release, stage, staged_paths, table

#: A calibrated probability of its best language below which a text is in none of them.
LEAST_SCORE = 0.4
#: Near copies: words of a shingle, and the Jaccard similarity in percent from which documents link.
WORDS, PERCENT = 5, 80


_left: list[str] = []


def _step(function):
    """A stage that first deletes what the stage before it has left behind."""

    @functools.wraps(function)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles() if _left else []
        if not any(path in file for path in _left for file in files):
            release(_left)
        before = set(staged_paths())
        out = function(spark, docs, sf_dir)
        _left[:] = [path for path in staged_paths() if path not in before]
        return out

    return run_step


def _without(rows: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not in ``dropped``: the smaller side of the decision moves."""
    return rows.join(dropped.select(key), key, "left_anti").select(*(c for c in rows.columns if c != key))


@_step
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what is in no language: no letter, or no language probable enough."""
    model = language_id.fit(docs, ~language_id.held_out())
    language, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    judged = language_id.predict(docs, model, docs.columns, answer=(language, score))
    return judged.where((F.col(language) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


@_step
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that is equal but for white space."""
    rows, key = keyed(docs)
    return _without(rows, exact_dedup.dedup_exact(rows, row_col=key).where("NOT kept"), key)


@_step
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group linked by the n-gram Jaccard join."""
    rows, key = keyed(docs)
    found = ngram_join.linked_rows(rows, WORDS, PERCENT, key)
    first = found.join(rows.select(key, "doc_id"), key).groupBy("component").agg(F.min(F.struct("doc_id", key)).alias("first"))
    return _without(rows, found.join(first.select(F.col(f"first.{key}").alias(key)), key, "left_anti"), key)


@_step
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole copy."""
    rows, key = keyed(docs)
    copies = free_name(rows, "copies")
    taken = mixing.mix(rows, row_col=key).where("size > 0").select(key, F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias(copies))
    return (
        rows.join(taken.where(F.col(copies) > 0), key)
        .select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copies)).drop(copies)
    )


@_step
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of at most 2048 tokens."""
    return packing.pack(docs, queries.tokenizer_files())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language ID and packing are not for SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, step) in enumerate(STAGES):
        before, docs = docs, stage(step(spark, docs, sf_dir), name)
        if n:
            drop(before)
    return docs
