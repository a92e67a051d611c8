"""Vector expressions over arrays of numbers, in double precision, all built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metrics by name; any other name is cosine. Euclid ranks ascending, the others descending.
METRICS = {"cosine": "cosine", "dot": "dot", "euclid": "euclid", "l2": "euclid"}


def _sum(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def dot(u: Column, v: Column) -> Column:
    """Over the shorter length, as a positional zip."""
    n = F.least(F.size(u), F.size(v))
    return _sum(F.zip_with(F.slice(u, F.lit(1), n), F.slice(v, F.lit(1), n), lambda a, b: a.cast("double") * b.cast("double")))


def norm(u: Column) -> Column:
    return F.sqrt(_sum(F.transform(u, lambda a: a.cast("double") * a.cast("double"))))


def cosine(u: Column, v: Column) -> Column:
    return F.try_divide(dot(u, v), norm(u) * norm(v))


def cosine_distance(u: Column, v: Column) -> Column:
    """One minus cosine; 1 where either vector is zero."""
    return F.coalesce(F.lit(1.0) - cosine(u, v), F.when(u.isNotNull() & v.isNotNull(), F.lit(1.0)))


def euclid(u: Column, v: Column) -> Column:
    n = F.least(F.size(u), F.size(v))
    return F.sqrt(_sum(F.zip_with(F.slice(u, F.lit(1), n), F.slice(v, F.lit(1), n), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))))


def score(metric: str, u: Column, v: Column) -> Column:
    return {"dot": dot, "euclid": euclid}.get(METRICS.get(metric.lower(), "cosine"), cosine)(u, v)


def valid(vector: Column, dimensions: int) -> Column:
    """Whether an embedding is not empty, all numbers and of the stated length."""
    return vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) == dimensions) & F.forall(vector, lambda x: x.isNotNull())
