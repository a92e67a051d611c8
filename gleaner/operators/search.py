"""Vector search over collections: dense, image, sparse and hybrid (reciprocal rank fusion).

A collection is a table ``id, dense, image, <payload columns>``. Ties go to the smaller id. A
filter is a conjunction of equalities on payload columns, so it reaches the scan; it applies
before any ranking, in both branches of a hybrid search.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V

log = logging.getLogger(__name__)
SEARCH_TYPES = ("dense", "sparse", "hybrid", "image")
#: Payload fields that may be filtered on, and those that answers may show.
FILTER_FIELDS = ("filepath", "chunk_index", "source", "category")
ANSWER_FIELDS = ("text", *FILTER_FIELDS)
#: Reciprocal rank fusion adds 1 / (RRF_K + rank) with ranks from 0.
RRF_K = 2
#: Queries whose scores are held together.
SCORED = 256


def allowed_filters(filters: dict | None, allowed: Iterable[str] | None = FILTER_FIELDS) -> dict:
    """Filters on fields in the allow-list; others are dropped with a warning. Empty allows all."""
    filters, allowed = filters or {}, list(allowed or [])
    dropped = [k for k in filters if allowed and k not in allowed]
    if dropped:
        log.warning("filters on %s are not allowed and are ignored", ", ".join(dropped))
    return {k: v for k, v in filters.items() if k not in dropped}


def filtered(points: DataFrame, filters: dict | None) -> DataFrame:
    """All conditions hold; a condition on an array field holds if any element is equal."""
    for key, value in (filters or {}).items():
        column = F.col(key)
        is_array = dict(points.dtypes)[key].startswith("array<")
        points = points.where(F.array_contains(column, value) if is_array else column == F.lit(value))
    return points


def projected(hits: DataFrame, fields: Iterable[str] | None) -> DataFrame:
    """Only the id, score and allowed fields; an empty list keeps all."""
    fields = list(fields or [])
    return hits.select("id", "score", *(c for c in hits.columns if c not in ("id", "score") and (not fields or c in fields)))


def _literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def _by_score(metric: str) -> list[Column]:
    return [F.col("score").asc() if V.METRICS.get(metric.lower()) == "euclid" else F.col("score").desc(), F.col("id").asc()]


def dense(
    points: DataFrame, query: list[float] | Column, limit: int = 5, metric: str = "cosine", column: str = "dense", filters: dict | None = None, threshold: float | None = None
) -> DataFrame:
    """The ``limit`` best points by a vector column; rows without a vector take no part.

    With a ``threshold``, only points that are at least as good (at most as far, by distance).
    """
    q = query if isinstance(query, Column) else _literal(query)
    found = filtered(points, filters).where(F.col(column).isNotNull()).withColumn("score", F.round(V.score(metric, F.col(column), q), 6))
    found = found.where(F.col("score").isNotNull())
    if threshold is not None:
        found = found.where(F.col("score") <= threshold if V.METRICS.get(metric.lower()) == "euclid" else F.col("score") >= threshold)
    return found.orderBy(*_by_score(metric)).limit(limit)


def term_counts(points: DataFrame, text_col: str = "text") -> DataFrame:
    """Long form ``id, bucket, tf`` of the hashed bag of words.

    Rows are dealt by id once, as counts of their buckets; no word moves.
    """
    counted = points.select("id", T.bucket_counts(T.tokens(F.col(text_col))).alias("c")).repartition("id")
    return counted.select("id", F.inline("c")).groupBy("id", "bucket").agg(F.sum("n").cast("double").alias("tf"))


def sparse_vectors(points: DataFrame, text_col: str = "text") -> DataFrame:
    """``id, indices, values``: sorted buckets and their counts; empty for a text without words."""
    pairs = F.sort_array(F.collect_list(F.struct("bucket", "tf")))
    found = term_counts(points, text_col).groupBy("id").agg(pairs.alias("p")).select("id", F.col("p.bucket").alias("indices"), F.col("p.tf").alias("values"))
    return points.select("id").join(found, "id", "left").select(
        "id", F.coalesce("indices", F.array().cast("array<int>")).alias("indices"), F.coalesce("values", F.array().cast("array<double>")).alias("values")
    )


def sparse(points: DataFrame, query_text: str, limit: int = 5, filters: dict | None = None, text_col: str = "text") -> DataFrame:
    """The ``limit`` best by dot product of hashed word counts; no overlap, no hit.

    Points that hold their sparse vector (``sparse``: indices and values) are scored by it, in one
    pass without texts. Else hashing is the costly part, so each distinct word is hashed once; the
    few whose bucket the query has are joined back to the texts, and only their counts are added up.
    """
    spark = points.sparkSession
    query = (
        spark.range(1).select(F.explode(T.tokens(F.lit(query_text))).alias("word")).select(T.hash_bucket(F.col("word")).alias("bucket"))
        .groupBy("bucket").agg(F.count(F.lit(1)).cast("double").alias("qtf"))
    )
    weights = {r["bucket"]: r["qtf"] for r in query.collect()}  # one entry per word of the query
    if not weights:
        return points.withColumn("score", F.lit(0.0)).limit(0)
    table = F.create_map(*(F.lit(x) for kv in sorted(weights.items()) for x in kv))
    found = filtered(points, filters)
    if "sparse" in points.columns:
        both = F.arrays_zip(F.col("sparse.indices").alias("i"), F.col("sparse.values").alias("v"))
        hits = F.filter(both, lambda x: x["i"].isin(sorted(weights)))
        score = F.round(F.aggregate(hits, F.lit(0.0), lambda acc, x: acc + x["v"] * F.element_at(table, x["i"])), 6)
        scored = found.where(F.arrays_overlap(F.col("sparse.indices"), F.array(*map(F.lit, sorted(weights))))).withColumn("score", score)
        return scored.orderBy(F.desc("score"), "id").limit(limit)
    words = found.select("id", F.explode(T.tokens(F.col(text_col))).alias("word"))
    matching = words.select("word").distinct().withColumn("weight", F.try_element_at(table, T.hash_bucket(F.col("word")))).where("weight IS NOT NULL")
    scores = words.join(matching, "word").groupBy("id").agg(F.round(F.sum("weight"), 6).alias("score"))
    best = scores.orderBy(F.desc("score"), "id").limit(limit)
    return found.join(F.broadcast(best), "id").orderBy(F.desc("score"), "id")  # at most ``limit`` rows


def hybrid(points: DataFrame, query: list[float], query_text: str | None, limit: int = 5, metric: str = "cosine", filters: dict | None = None, rrf_k: int = RRF_K) -> DataFrame:
    """Dense and sparse top ``limit`` each, fused by reciprocal ranks, top ``limit`` of that.

    Both branches are limited before they are ranked, so ranking sees ``limit`` rows.
    """
    def ranked(hits: DataFrame, order: list[Column]) -> DataFrame:
        return hits.select("id", (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank"))

    one = ranked(dense(points, query, limit, metric, filters=filters), _by_score(metric))
    two = ranked(sparse(points, query_text or "", limit, filters), [F.desc("score"), F.col("id")])
    fused = one.unionByName(two).groupBy("id").agg(F.round(F.sum(F.lit(1.0) / (rrf_k + F.col("rank"))), 9).alias("score"))
    best = fused.orderBy(F.desc("score"), "id").limit(limit)
    return points.join(F.broadcast(best), "id").orderBy(F.desc("score"), "id")  # at most ``limit`` rows


def search(
    points: DataFrame, query: list[float], limit: int = 5, filters: dict | None = None, query_text: str | None = None, search_type: str = "dense",
    answer_fields: Iterable[str] | None = None, metric: str = "cosine", named: bool = True, threshold: float | None = None,
) -> DataFrame:
    """One entry for all searches. "sparse" runs dense, as it always has; ``sparse`` is the real one.

    A collection with a single unnamed vector (``named=False``) answers every type by it.
    """
    if search_type not in SEARCH_TYPES:
        raise ValueError(f"search_type must be one of {', '.join(SEARCH_TYPES)}")
    if named and search_type == "hybrid":
        hits = hybrid(points, query, query_text, limit, metric, filters)
    else:
        hits = dense(points, query, limit, metric, "image" if named and search_type == "image" else "dense", filters, threshold)
    return projected(hits.drop("dense", "image", "sparse"), answer_fields)


def _best(limit: int, metric: str):
    """Scores of a tile's points and queries as a matrix product, the ``limit`` best of each query."""
    kind = V.METRICS.get(metric.lower(), "cosine")

    def tile(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        is_query = t["is_query"].to_numpy()

        def rows(of: np.ndarray) -> tuple[list, np.ndarray]:
            part = t.filter(pa.array(of))
            vectors = part["vector"].to_pylist()
            width = max(map(len, vectors), default=0)
            m = np.zeros((len(vectors), width))
            for i, v in enumerate(vectors):
                m[i, : len(v)] = v
            return part["id"].to_pylist(), m

        (ids, x), (query_ids, q) = rows(~is_query), rows(is_query)
        width = min(x.shape[1], q.shape[1])
        found: list[list] = [[], [], []]
        for begin in range(0, len(q) if len(x) else 0, SCORED):
            some = q[begin : begin + SCORED]
            s = some[:, :width] @ x[:, :width].T
            if kind == "cosine":
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = s / (np.linalg.norm(some, axis=1)[:, None] * np.linalg.norm(x, axis=1))
            elif kind == "euclid":
                s = np.stack([np.sqrt(((x[:, :width] - v[:width]) ** 2).sum(axis=1)) for v in some])
            order = np.where(np.isnan(s), np.inf, np.round(s if kind == "euclid" else -s, 6))
            last = np.partition(order, min(limit, len(ids)) - 1, axis=1)[:, min(limit, len(ids)) - 1]
            for r in range(len(some)):
                at = np.flatnonzero((order[r] <= last[r]) & np.isfinite(order[r])).tolist()
                for i in sorted(at, key=lambda i: (order[r, i], ids[i]))[:limit]:
                    for column, value in zip(found, (query_ids[begin + r], ids[i], float(s[r, i])), strict=True):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(found[0], t.schema.field("id").type), pa.array(found[1], t.schema.field("id").type), pa.array(found[2], pa.float64())], ["query_id", "id", "score"])

    return tile


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def knn_batch(points: DataFrame, queries: DataFrame, limit: int = 5, metric: str = "cosine", most_queries: int = 16_384, most_points: int = 32_768) -> DataFrame:
    """The ``limit`` nearest points of each of many queries (``query_id, query``), ids being of one type.

    Points and queries are dealt by hash into tiles of bounded size, and every tile of points meets
    every block of queries in a task of its own, which multiplies two matrices and keeps the best
    ``limit`` a query. Nothing is broadcast or collected; points move once per block of queries.
    """
    able = points.where(F.col("dense").isNotNull() & F.forall("dense", lambda x: x.isNotNull())).select("id", F.col("dense").cast("array<double>").alias("vector"))
    asked = queries.select(F.col("query_id").alias("id"), F.col("query").cast("array<double>").alias("vector"))
    tiles = max(1, -(-able.count() // most_points))
    blocks = max(1, -(-asked.count() // most_queries))
    both = able.select(F.pmod(F.xxhash64("id"), F.lit(tiles)).alias("tile"), F.explode(_upto(blocks)).alias("block"), "id", "vector", F.lit(False).alias("is_query")).unionByName(
        asked.select(F.explode(_upto(tiles)).alias("tile"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", "vector", F.lit(True).alias("is_query"))
    )
    id_type = dict(points.dtypes)["id"]
    best = both.groupBy("tile", "block").applyInArrow(_best(limit, metric), f"query_id {id_type}, id {id_type}, score double").withColumn("score", F.round("score", 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*_by_score(metric)))
    return best.withColumn("rank", rank).where(F.col("rank") <= limit)
