"""Named operators, table functions, vector backends, embedders and readers that plug in.

An embedder is a function from a text column to a vector column; the built-in one needs no
network. A reader turns the bytes of the MIME type it is registered for into text, in ingestion.
The chunkers are operators from documents to chunks.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import errors

log = logging.getLogger(__name__)


class Registry:
    """Names to factories. A second registration of a name replaces the first, with a warning."""

    def __init__(self, what: str):
        self.what, self.made = what, {}

    def register(self, name: str, make: Callable | None = None) -> Callable:
        if make is None:
            return lambda f: self.register(name, f)
        if name in self.made:
            log.warning("%s %s is registered again", self.what, name)
        self.made[name] = make
        return make

    def create(self, name: str, *args, **kwargs):
        if name not in self.made:
            raise ValueError(f"unknown {self.what}: {name}; known: {', '.join(sorted(self.made))}")
        return self.made[name](*args, **kwargs)

    def load(self, config: Iterable[dict], strict: bool = True) -> dict:
        """Make all of a list of {"type": ..., options}; without ``strict`` what fails is skipped."""
        out = {}
        for entry in config:
            options = dict(entry)
            try:
                name = options.pop("type")
                out[options.pop("name", name)] = self.create(name, **options)
            except Exception as problem:
                if strict:
                    raise
                log.warning("skipped %s: %s", entry, problem)
        return out


operators, backends, embedders, readers = Registry("operator"), Registry("vector backend"), Registry("embedder"), Registry("reader")


def enabled(descriptors: DataFrame, only: list[str] | DataFrame | None = None, disabled: list[str] | DataFrame | None = None, prefix: str = "", name_col: str = "name") -> DataFrame:
    """Descriptors that are on (all, or those listed) and not off, their names prefixed.

    Names are lists, or tables with a column of that name.
    """
    kept = descriptors
    if isinstance(only, DataFrame):
        kept = kept.join(only.select(name_col), name_col, "left_semi")
    elif only is not None:
        kept = kept.where(F.col(name_col).isin(list(only)))
    if isinstance(disabled, DataFrame):
        kept = kept.join(disabled.select(name_col), name_col, "left_anti")
    elif disabled:
        kept = kept.where(~F.col(name_col).isin(list(disabled)))
    return kept.withColumn("original_name", F.col(name_col)).withColumn(name_col, F.concat(F.lit(f"{prefix}_"), name_col) if prefix else F.col(name_col))


@embedders.register("hashed")
def hashed_embedder(dimensions: int = 64) -> Callable[[Column], Column]:
    """Counts of hashed words, scaled to length one; a text without words is the zero vector."""

    def counts_of(buckets: Column) -> Column:
        # What is gone without a bucket's number is its count: no step a word and a dimension.
        return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: (F.size(buckets) - F.size(F.array_remove(buckets, i))).cast("double"))

    def scaled(counts: Column) -> Column:
        size = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
        return T.once(size, lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))

    def embed(text: Column) -> Column:
        # Each step is bound once, as the only element of an array.
        buckets = F.array(F.transform(T.tokens(text), lambda w: T.hash_bucket(w, dimensions)))
        return F.transform(F.transform(buckets, lambda b: counts_of(b)), lambda c: scaled(c))[0]

    return embed


@embedders.register("batched")
def batched_embedder(
    embed_batch: Callable[[list[str]], list[list[float]]], dimensions: int, attempts: int = errors.ATTEMPTS, delay: float = errors.DELAY, on_error: str = "raise"
) -> Callable[[Column], Column]:
    """A provider's batch call as an Arrow UDF: retried where that may help, its answers checked.

    With ``on_error="null"`` a batch that fails is asked for text by text, and a text that fails
    has no vector, so that one bad text does not fail a stage.
    """
    if on_error not in ("raise", "null"):
        raise ValueError(f"on_error is raise or null, not {on_error}")

    def ask(batch: list[str]) -> list[list[float]]:
        vectors = errors.retried(embed_batch, attempts, delay)(batch)
        if len(vectors) != len(batch) or any(len(v) != dimensions for v in vectors):
            raise ValueError("the provider's answer has the wrong shape")
        return [[float(x) for x in v] for v in vectors]

    def alone(text: str) -> list[float] | None:
        try:
            return ask([text])[0]
        except Exception as problem:
            log.warning("a text has no vector: %s", problem)
            return None

    def call(texts: pd.Series) -> pd.Series:
        batch = [t or "" for t in texts]
        try:
            return pd.Series(ask(batch))
        except Exception:
            if on_error == "raise":
                raise
            return pd.Series([alone(t) for t in batch])

    return F.pandas_udf(call, "array<double>")


def read_with(reader: Callable[[bytes], str], content: Column) -> Column:
    """struct<text, error> of a reader's answer for each file's bytes; a problem is an error, not a failed stage."""

    def read(files: pd.Series) -> pd.DataFrame:
        texts, problems = [], []
        for data in files:
            try:
                texts.append(None if data is None else reader(bytes(data)))
                problems.append(None)
            except Exception as problem:
                texts.append(None)
                problems.append(f"{type(problem).__name__}: {problem}")
        return pd.DataFrame({"text": pd.Series(texts, dtype=object), "error": pd.Series(problems, dtype=object)})

    return F.pandas_udf(read, "text string, error string")(content)


def _chunker(strategy: str) -> Callable:
    def make(**options) -> Callable[[DataFrame], DataFrame]:
        from .ingest import chunk_documents

        return lambda docs: chunk_documents(docs, strategy, **options)

    return make


for _strategy in ("fixed", "markdown", "semantic"):
    operators.register(f"{_strategy}_chunks", _chunker(_strategy))
