"""The library's functions in SQL: chunkers as table functions, vector and text functions as scalar ones.

``register(spark)`` puts them in a session; any query then may say

    SELECT d.doc_id, c.chunk_index, c.text FROM documents d, LATERAL chunk_fixed(d.text, 500, 50) c
    SELECT id FROM points ORDER BY cosine_similarity(dense, array(0.1D, 0.2D)) DESC LIMIT 5

The scalar functions are SQL functions, which the optimizer inlines. Table functions are Python
functions, since no built-in table function takes a column's text; they run in Arrow batches next to
their rows, without a shuffle. Sizes are checked when a query is analysed, so they must be constants.
``T.chunk_fixed`` and its kin, which stay in the JVM, are the ones to use from DataFrames.

Defined results: null and empty texts have no chunks; a size that is no constant, an overlap that is
negative or not below the size, and fewer vectors than sentences are errors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .text import SEPARATORS, _check

#: Heading lines begin a section; sentences end at a mark before white space.
_SECTION, _SENTENCE = re.compile(r"\n(?=[^\S\n]*#{1,6} [^\n]*\S)"), re.compile(r"(?<=[.!?])\s+")


def bounds(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Beginnings and ends of pieces: after the last separator of highest rank in the look-back window, else a hard cut."""
    at = 0
    while len(text) - at > size:
        end = at + size
        ends = (place + len(s) for s in SEPARATORS if (place := text.rfind(s, end - overlap, end)) >= 0)
        cut = next(ends, None)
        yield at, cut or end
        at = cut or end - overlap
    if at < len(text):
        yield at, len(text)


def fitted(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Pieces that fit as they are, others in fixed pieces, stripped; no empty ones."""
    for piece in pieces:
        parts = [piece] if len(piece) <= size else (piece[a:b].strip() for a, b in bounds(piece, size, overlap))
        yield from filter(None, parts)


class _Chunker:
    """What chunkers share: ``chunk_index, text`` of a text, with sizes checked at analysis."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument = None, overlap: AnalyzeArgument = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError(f"chunks are cut from a text, not from a column of {text.dataType.simpleString()}")
        given = [default if a is None else a.value for a, default in ((size, 500), (overlap, 50))]
        if None in given:
            raise ValueError("size and overlap must be constants")
        _check(*given)
        return AnalyzeResult(StructType().add("chunk_index", IntegerType()).add("text", StringType()))


class ChunkFixed(_Chunker):
    def eval(self, text, size=500, overlap=50):
        yield from enumerate(fitted([text or ""], size, overlap))


class ChunkMarkdown(_Chunker):
    def eval(self, text, size=500, overlap=50):
        yield from enumerate(fitted([section.strip() for section in _SECTION.split(text or "")], size, overlap))


class ChunkSemantic(_Chunker):
    """Runs of sentences whose neighbours' cosine distance stays within the threshold; ``vectors``: one a sentence."""

    @staticmethod
    def analyze(text: AnalyzeArgument, vectors: AnalyzeArgument, threshold: AnalyzeArgument = None, size: AnalyzeArgument = None, overlap: AnalyzeArgument = None) -> AnalyzeResult:
        return _Chunker.analyze(text, size, overlap)

    def eval(self, text, vectors, threshold=0.5, size=500, overlap=50):
        import numpy as np

        parts = list(filter(None, map(str.strip, _SENTENCE.split(text or ""))))
        runs = parts[:1]
        if len(parts) > 1:
            if vectors is None or len(vectors) != len(parts):
                raise ValueError(f"{len(parts)} sentences but {0 if vectors is None else len(vectors)} vectors")
            v = np.array(vectors, float)
            size_of = np.sqrt((v * v).sum(axis=1))
            with np.errstate(divide="ignore", invalid="ignore"):
                near = np.nan_to_num((v[1:] * v[:-1]).sum(axis=1) / (size_of[1:] * size_of[:-1]))
            for part, far in zip(parts[1:], (1 - near > threshold).tolist(), strict=True):
                if far or len(runs[-1]) + len(part) + 1 > size:
                    runs.append(part)
                else:
                    runs[-1] += f" {part}"
        yield from enumerate(fitted(runs, size, overlap))


class TextSentences:
    """``sentence_index, sentence`` of a text."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(StructType().add("sentence_index", IntegerType()).add("sentence", StringType()))

    def eval(self, text):
        yield from enumerate(filter(None, map(str.strip, _SENTENCE.split(text or ""))))


TABLE_FUNCTIONS = {"chunk_fixed": ChunkFixed, "chunk_markdown": ChunkMarkdown, "chunk_semantic": ChunkSemantic, "text_sentences": TextSentences}

_DOT = "aggregate(zip_with({u}, {v}, (a, b) -> a * b), 0D, (s, x) -> s + coalesce(x, 0D))"
#: Name and parameters, type and body of SQL functions.
SCALAR_FUNCTIONS = {
    "vector_dot(u ARRAY<DOUBLE>, v ARRAY<DOUBLE>)": ("DOUBLE", _DOT.format(u="u", v="v")),
    "cosine_similarity(u ARRAY<DOUBLE>, v ARRAY<DOUBLE>)": ("DOUBLE", f"try_divide({_DOT.format(u='u', v='v')}, sqrt({_DOT.format(u='u', v='u')}) * sqrt({_DOT.format(u='v', v='v')}))"),
    "euclid_distance(u ARRAY<DOUBLE>, v ARRAY<DOUBLE>)": ("DOUBLE", "sqrt(aggregate(zip_with(u, v, (a, b) -> (a - b) * (a - b)), 0D, (s, x) -> s + coalesce(x, 0D)))"),
    "text_preview(t STRING, n INT DEFAULT 60)": ("STRING", "CASE WHEN length(t) > n THEN concat(left(t, n), '...') ELSE t END"),
    "file_ending(path STRING)": ("STRING", r"lower(regexp_extract(path, '([^/.])(\\.[^./]*)$', 2))"),
}


def register(spark: SparkSession, names: tuple[str, ...] | None = None) -> list[str]:
    """Put the functions (or those of the given names) in the session; an unknown name raises. Returns the names."""
    scalar = {signature.split("(")[0]: (signature, *rest) for signature, rest in SCALAR_FUNCTIONS.items()}
    every = [*TABLE_FUNCTIONS, *scalar]
    for name in names or every:
        if name in TABLE_FUNCTIONS:
            spark.udtf.register(name, udtf(TABLE_FUNCTIONS[name], useArrow=True))
        elif name in scalar:
            signature, kind, body = scalar[name]
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
        else:
            raise ValueError(f"unknown function {name!r}; there are {', '.join(every)}")
    return list(names or every)
