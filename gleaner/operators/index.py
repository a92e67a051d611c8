"""Indexes of a collection's points, for searches that read part of them and answer as a full scan does.

**Dense**: points are dealt to cells by the nearest of a few centroids and stored by cell, each with its
distance to the centroid. By the triangle inequality no point of a cell is nearer to a query than the
query's distance to the centroid and the point's own differ. So a search reads the nearest cells, which
gives the distance that the answer cannot exceed, then only cells, and in them only points, that may lie
within it. Cosine is searched as the distance of normalised vectors. Centroids come from a sample
(``SAMPLE`` points); they decide how much is read, never the answer.

**Sparse**: an inverted index by bucket of the hashed words. Documents are dealt to blocks of about
``BLOCK``, those of like length together; a posting row holds what one block has of one bucket, and the
highest count in it. The sum of a block's highest counts by the query's weights bounds what its documents
can score: a search scores the most promising blocks, which gives the score that the answer must reach,
then the blocks whose bound reaches it. Texts and vectors are not read.

Both are plain Parquet folders. A search sends the driver the index's cells (``CELLS`` at most) or nothing
but the answer, whatever the number of points.

Defined results: points without a vector, of no length (cosine), or with null or non-finite components are in
no dense index, as they are no hits of a scan; vectors must have one length; documents without words have no
postings; ties go to the smaller id; an empty collection gives no hits; an index is of the points at the time
it was built.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from .search import _by_score, filtered, term_counts

#: Points that centroids are fitted on, cells at most, rounds of fitting.
SAMPLE, CELLS, ROUNDS = 20_000, 2048, 8
#: Documents of a block; folders that postings are partitioned into; blocks that are scored first, for each hit asked for.
BLOCK, PARTS, FIRST = 64, 32, 4
#: Scores are rounded to six digits, so what differs less than this may tie.
SLACK = 2e-6


def _metric(metric: str) -> str:
    kind = V.METRICS.get(metric.lower(), "cosine")
    if kind == "dot":
        raise ValueError("inner products obey no triangle inequality: search by a scan")
    return kind


def _fitted(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` centroids of the rows, by plain k-means from rows spread over the sample."""
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        nearest = (x @ centroids.T * 2 - (centroids**2).sum(axis=1)).argmax(axis=1)
        sums, counts = np.zeros_like(centroids), np.bincount(nearest, minlength=k)
        np.add.at(sums, nearest, x)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def build_dense(points: DataFrame, path: str, metric: str = "cosine", column: str = "dense", cells: int | None = None) -> None:
    """Write the index of a vector column to ``path``; other columns come along, for filters and answers."""
    kind, spark = _metric(metric), points.sparkSession
    v = F.col(column).cast("array<double>")
    whole = points.where(F.col(column).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    placed = whole.withColumn("_place", F.transform(v, lambda x: x / V.norm(v)) if kind == "cosine" else v)
    if kind == "cosine":
        placed = placed.where(V.norm(v) > 0)
    n = placed.count()
    k = max(1, min(CELLS, cells or int(n**0.5)))
    drawn = placed.select("_place").sample(min(1.0, 1.2 * SAMPLE / n), seed=5).limit(SAMPLE).collect() if n else []
    centroids = _fitted(np.array([r[0] for r in drawn]), min(k, len(drawn))) if drawn else np.zeros((1, 1))
    schema = f"{points.drop('_place').schema.simpleString()[7:-1]},cell:int,dist:double"

    def assign(batches):
        half = (centroids**2).sum(axis=1)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index("_place"))
            x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            if x.shape[1] != centroids.shape[1]:
                raise ValueError(f"vectors of {x.shape[1]} dimensions among those of {centroids.shape[1]}")
            cell = (x @ centroids.T * 2 - half).argmax(axis=1)
            dist = np.sqrt(((x - centroids[cell]) ** 2).sum(axis=1))
            rest = batch.drop_columns(["_place"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(cell, pa.int32()), pa.array(dist)], names=[*rest.schema.names, "cell", "dist"])

    placed.mapInArrow(assign, schema).write.partitionBy("cell").parquet(f"{path}/points")
    there = spark.read.parquet(f"{path}/points") if n else spark.createDataFrame([], "cell int, dist double")
    sizes = there.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high"))
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    sizes.join(table, "cell").withColumn("metric", F.lit(kind)).coalesce(1).write.parquet(f"{path}/cells")


@dataclass
class Found:
    """Hits, and how many of the index's points were in what was read."""

    hits: DataFrame
    read: int
    points: int


def search_dense(spark: SparkSession, path: str, query: list[float], limit: int = 5, column: str = "dense", filters: dict | None = None) -> Found:
    """The ``limit`` nearest, as ``search.dense`` gives them, from an index of the same column."""
    cells = spark.read.parquet(f"{path}/cells").collect()  # CELLS rows at most
    if not cells:
        return Found(spark.createDataFrame([], "id string, score double"), 0, 0)
    kind, q = cells[0]["metric"], np.array(query, float)
    q = q / np.linalg.norm(q) if kind == "cosine" else q
    away = {c["cell"]: float(np.linalg.norm(q - np.array(c["centroid"]))) for c in cells}
    size = {c["cell"]: c["n"] for c in cells}
    least = {c["cell"]: max(0.0, away[c["cell"]] - c["high"], c["low"] - away[c["cell"]]) for c in cells}
    stored = filtered(spark.read.parquet(f"{path}/points"), filters)
    wanted = F.array(*(F.lit(float(x)) for x in query))

    def scored(of: list[int]) -> DataFrame:
        found = stored.where(F.col("cell").isin(of)).withColumn("score", F.round(V.score(kind, F.col(column), wanted), 6))
        return found.orderBy(*_by_score(kind)).limit(limit)

    order = sorted(away, key=lambda c: (least[c], away[c]))
    first, held = [], 0
    for cell in order:
        first.append(cell)
        held += size[cell]
        if held >= 4 * limit and len(first) >= 2:
            break
    best = [r["score"] for r in scored(first).select("score").collect()]  # ``limit`` rows
    if len(best) < limit:
        chosen = order
        hits = scored(chosen)
    else:
        # By cosine, the distance of normalised vectors is the root of 2 - 2 cos.
        reach = max(0.0, 2 - 2 * (best[-1] - SLACK)) ** 0.5 if kind == "cosine" else best[-1] + SLACK
        reach += SLACK
        chosen = [c for c in order if least[c] <= reach]
        centre = F.element_at(F.create_map(*(F.lit(x) for c in chosen for x in (c, away[c]))), F.col("cell"))
        near = stored.where(F.col("cell").isin(chosen) & (F.abs(F.col("dist") - centre) <= reach))
        hits = near.withColumn("score", F.round(V.score(kind, F.col(column), wanted), 6)).orderBy(*_by_score(kind)).limit(limit)
    return Found(hits.drop("cell", "dist"), sum(size[c] for c in set(first) | set(chosen)), sum(size.values()))


def build_postings(points: DataFrame, path: str, text_col: str = "text") -> None:
    """Write the inverted index of a text column to ``path``."""
    terms = term_counts(points.select("id", text_col), text_col)
    lengths = terms.groupBy("id").agg(F.sum("tf").alias("length")).withColumn("class", F.floor(F.log2("length")).cast("int"))
    classes = lengths.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    dealt = lengths.join(F.broadcast(classes), "class").select(  # a class for each power of two
        "id", F.concat_ws("-", F.col("class").cast("string"), F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)).cast("string")).alias("block")
    )
    rows = terms.join(dealt, "id").groupBy("bucket", "block").agg(F.max("tf").alias("most"), F.collect_list(F.struct("id", "tf")).alias("docs"))  # BLOCK documents or so
    rows.withColumn("part", F.col("bucket") % PARTS).repartition("part").sortWithinPartitions("bucket").write.partitionBy("part").parquet(f"{path}/postings")


def search_sparse(spark: SparkSession, path: str, query_text: str, limit: int = 5) -> DataFrame:
    """``id, score`` of the ``limit`` best by dot product of hashed word counts, as ``search.sparse`` gives them."""
    counted = spark.range(1).select(F.explode(T.tokens(F.lit(query_text))).alias("word")).select(T.hash_bucket(F.col("word")).alias("bucket"))
    weights = {r["bucket"]: float(r["count"]) for r in counted.groupBy("bucket").count().collect()}  # one entry per word of the query
    try:
        postings = spark.read.parquet(f"{path}/postings")
    except AnalysisException as problem:
        if problem.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return spark.createDataFrame([], "id string, score double")  # nothing was indexed
    if not weights:
        return postings.select(F.col("docs")[0]["id"].alias("id"), F.lit(0.0).alias("score")).limit(0)
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in sorted(weights.items()) for x in kv)), F.col("bucket"))
    asked = postings.where(F.col("part").isin(sorted({b % PARTS for b in weights})) & F.col("bucket").isin(sorted(weights))).withColumn("weight", weight)
    bounds = asked.groupBy("block").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"))

    def scored(blocks: DataFrame) -> DataFrame:
        docs = asked.join(blocks.select("block"), "block", "left_semi").select("weight", F.explode("docs").alias("d"))
        total = docs.groupBy(F.col("d.id").alias("id")).agg(F.round(F.sum(F.col("weight") * F.col("d.tf")), 6).alias("score"))
        return total.orderBy(F.desc("score"), "id").limit(limit)

    promising = bounds.orderBy(F.desc("bound"), "block").limit(FIRST * limit)
    best = [r["score"] for r in scored(promising).select("score").collect()]  # ``limit`` rows
    return scored(bounds.where(F.col("bound") >= best[-1] - SLACK) if len(best) == limit else bounds)
