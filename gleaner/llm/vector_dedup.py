"""Operator 2, embedding near-dedup: spherical k-means cells, blocked cosines within them.

Equal vectors of a label are one class before anything is compared. Unit vectors are assigned to
the cell of their nearest centroid (spherical k-means, fitted on a bounded sample). Cells are
exact, not approximate: two unit vectors at cosine >= t are at most 2 sin(acos(t) / 2) apart, so
the partner of a vector can only live in a cell whose bisecting plane with the vector's own cell
is that close; the vector visits those cells of higher number as a guest. So every pair at or
above t meets exactly once, in the home cell of one of the two. Where one table of centroids
would be long, each of its cells is cut once more by centroids of its own, and vectors visit these
finer cells by the same rule.

Cells are cut into blocks of ``BLOCK`` vectors and compared block against block, so no task holds
more than two blocks whatever the size of a cell. A block pair returns link counts and a spanning
forest of its links, never the pairs themselves.

Defined results: rows whose label is null, or whose vector is null, empty, zero or holds null or
non-finite components, link with nothing and stay; vectors of unlike length do not link; rows that
share an id, or have none, are vectors of their own, whose component is named by its smallest id;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop, keyed, stage, trim

THRESHOLD = 0.98
#: Vectors that centroids are fitted on (more where there are many cells), and bytes of them at most;
#: vectors of a cell aimed at; cells beyond which they are cut in two steps.
SAMPLE, SAMPLE_BYTES, CELL, ONE_LEVEL = 20_000, 64 << 20, 4096, 256
BLOCK, ROUNDS = 1024, 8


def _floats(column: pa.Array) -> list[np.ndarray | None]:
    """Each row as float64, or None where it is null, zero, or holds null or non-finite values."""
    out: list[np.ndarray | None] = []
    offsets, values = column.offsets.to_numpy(), column.values
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i, ok in enumerate(valid):
        v = flat[offsets[i] : offsets[i + 1]]
        out.append(v if ok and len(v) and np.isfinite(v).all() and v.any() else None)
    return out


def unit_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, label, dim, digest, unit``; digest and unit are null where a row cannot link.

    The digest is that of the vector as given: rows of equal digest are equal vectors.
    """

    def norm(batches):
        for batch in batches:
            dim, digest, unit = [], [], []
            labels = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for has_label, v in zip(labels, _floats(batch.column(2)), strict=True):
                if v is None or not has_label:
                    dim.append(None), digest.append(None), unit.append(None)
                    continue
                u = v / np.abs(v).max()
                dim.append(len(v)), digest.append(hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest())
                unit.append((u / math.sqrt(float(u @ u))).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(dim, pa.int32()), pa.array(digest, pa.binary()), pa.array(unit, pa.binary())],
                ["vec_id", "label", "dim", "digest", "unit"],
            )

    return rows.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(
        norm, "vec_id long, label string, dim int, digest binary, unit binary"
    )


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """k unit centroids of unit vectors; empty cells keep their centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


class Cells:
    """Centroids of one vector length, each with finer ones of its cell (itself alone, if there are none)."""

    def __init__(self, coarse: np.ndarray, fine: list[np.ndarray]):
        self.coarse, self.fine = coarse, fine
        self.first = np.cumsum([0, *map(len, fine)])
        self.gaps, self.fine_gaps = _gaps(coarse), [_gaps(f) for f in fine]

    def visits(self, x: np.ndarray, apart: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of ``x``, the cells they come to, and whether as guests."""
        near, all_ = _within(x, self.coarse, self.gaps, apart)
        all_ &= np.arange(len(self.coarse)) >= near[:, None]
        for c in np.flatnonzero(all_.any(axis=0)):
            rows = np.flatnonzero(all_[:, c])
            if len(self.fine[c]) == 1:
                yield rows, np.full(len(rows), self.first[c]), near[rows] != c
                continue
            finest, these = _within(x[rows], self.fine[c], self.fine_gaps[c], apart)
            home = near[rows] == c
            these &= ~home[:, None] | (np.arange(len(self.fine[c])) >= finest[:, None])
            i, j = np.nonzero(these)
            yield rows[i], self.first[c] + j, ~home[i] | (j != finest[i])


def _gaps(c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * c @ c.T))


def _within(x: np.ndarray, c: np.ndarray, gaps: np.ndarray, apart: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid, and the cells whose bisecting plane with it is within ``apart``."""
    dots = x @ c.T
    near = np.argmax(dots, axis=1)
    return near, dots[np.arange(len(x)), near][:, None] - dots <= apart * gaps[near] + 1e-9


def fit_cells(classes: DataFrame) -> dict[int, Cells]:
    """Cells by vector length, on a sample chosen by a hash of the id; lengths of few vectors are one cell."""
    out = {}
    for row in classes.groupBy("dim").count().collect():  # one row per vector length
        n, dim = row["count"], row["dim"]
        k = math.ceil(n / CELL)
        if k == 1:
            out[dim] = Cells(np.eye(1, dim), [np.eye(1, dim)])
            continue
        sample = min(max(SAMPLE, 8 * k), max(1, SAMPLE_BYTES // (8 * dim)))
        picked = classes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30)) + 1))
        rows = picked.select("vec_id", "unit").limit(2 * sample).collect()
        x = np.array([np.frombuffer(r["unit"], np.float64) for r in sorted(rows, key=lambda r: r["vec_id"])]).reshape(-1, dim)
        if not len(x):
            out[dim] = Cells(np.eye(1, dim), [np.eye(1, dim)])
        elif k <= ONE_LEVEL:
            c = spherical_kmeans(x, k)
            out[dim] = Cells(c, [c[i : i + 1] for i in range(len(c))])
        else:
            c = spherical_kmeans(x, math.isqrt(k))
            near = np.argmax(x @ c.T, axis=1)
            members = [x[near == i] for i in range(len(c))]
            out[dim] = Cells(c, [spherical_kmeans(m, max(1, round(k * len(m) / len(x)))) if len(m) > 1 else c[i : i + 1] for i, m in enumerate(members)])
    return out


def _deal(classes: DataFrame, cells: dict[int, Cells], threshold: float) -> DataFrame:
    """Each class in its home cell and, as a guest, in every cell where a partner may live."""
    apart = 2 * math.sin(math.acos(threshold) / 2) + 1e-9
    shared = classes.sparkSession.sparkContext.broadcast(cells)  # a few times SAMPLE_BYTES at most

    def assign(batches):
        for batch in batches:
            rows: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]]
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                of = np.flatnonzero(dims == dim)
                for begin in range(0, len(of), BLOCK):
                    at = of[begin : begin + BLOCK]
                    x = np.frombuffer(b"".join(batch.column(3).take(pa.array(at)).to_pylist()), np.float64).reshape(len(at), dim)
                    for i, cell, guest in shared.value[dim].visits(x, apart):
                        for column, value in zip(rows, (at[i], cell, guest), strict=True):
                            column.append(value)
            take = pa.array(np.concatenate(rows[0]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(take) for k in range(5)] + [pa.array(np.concatenate(rows[1]), pa.int32()), pa.array(np.concatenate(rows[2]), pa.bool_())],
                ["vec_id", "label", "dim", "unit", "copies", "cell", "guest"],
            )
        trim()

    return classes.select("vec_id", "label", "dim", "unit", "copies").mapInArrow(
        assign, "vec_id long, label string, dim int, unit binary, copies long, cell int, guest boolean"
    )


def _compare(threshold: float):
    def forest(linked: np.ndarray) -> np.ndarray:
        """Smallest index reachable in a symmetric link matrix."""
        label = np.arange(len(linked))
        while True:
            new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
            new = new[new]
            if (new == label).all():
                return label
            label = new

    def tile(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        ids, copies = t["vec_id"].to_numpy(), t["copies"].to_numpy()
        guest, block = t["guest"].to_numpy(), t["block"].to_numpy()
        x = np.frombuffer(b"".join(t["unit"].to_pylist()), np.float64).reshape(len(ids), -1)
        one, two = key[3].as_py(), key[4].as_py()
        left = np.flatnonzero(~guest & (block == one))
        guests = two < 0
        right = np.flatnonzero(guest & (block == -1 - two)) if guests else np.flatnonzero(~guest & (block == two))
        linked = x[left] @ x[right].T >= threshold
        if not guests and one == two:
            np.fill_diagonal(linked, False)
        by_left, by_right = linked @ copies[right], copies[left] @ linked
        same = not guests and one == two
        counts = {}
        for i, c in zip(left[by_left > 0], by_left[by_left > 0], strict=True):
            counts[i] = int(c)
        if not same:
            for i, c in zip(right[by_right > 0], by_right[by_right > 0], strict=True):
                counts[i] = counts.get(i, 0) + int(c)
        used = np.array(sorted(counts), np.int64)
        root = np.zeros(0, np.int64)
        if len(used):
            place = {int(i): n for n, i in enumerate(used)}
            m = np.zeros((len(used), len(used)), bool)
            a, b = np.nonzero(linked)
            pa_, pb = np.array([place[int(left[i])] for i in a]), np.array([place[int(right[i])] for i in b])
            m[pa_, pb] = m[pb, pa_] = True
            root = used[forest(m)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[used], pa.int64()), pa.array([counts[int(i)] for i in used], pa.int64()), pa.array(ids[root], pa.int64())], ["vec_id", "links", "root"]
        )

    return tile


def link_vectors(rows: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    rows, key = keyed(rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding")), "vec_id")
    found = _linked(rows.select(F.col(key).alias("vec_id"), "label", "embedding"), threshold)
    if hasattr(rows, "_staged_path"):  # ids that rows share, or have none of
        named = found.join(rows.select(F.col(key).alias("vec_id"), F.col("vec_id").alias("id")), "vec_id")
        first = named.groupBy("component_id").agg(F.min("id").alias("first"))
        found = named.join(first, "component_id").select(F.col("id").alias("vec_id"), "n_links", F.col("first").alias("component_id"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _linked(rows: DataFrame, threshold: float) -> DataFrame:
    """``vec_id, n_links, component_id`` of rows whose ids are their own."""
    every = stage(unit_vectors(rows), "units")
    able = every.where("digest IS NOT NULL")
    classes = stage(
        able.groupBy("label", "dim", "digest").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.min("unit").alias("unit")), "classes"
    )
    dealt = stage(_deal(classes, fit_cells(classes), threshold), "cells")
    group = ["label", "dim", "cell"]
    blocks = dealt.groupBy(*group).agg(
        F.greatest(F.lit(1), F.ceil(F.count(F.when(~F.col("guest"), 1)) / BLOCK)).cast("int").alias("homes"),
        F.ceil(F.count(F.when(F.col("guest"), 1)) / BLOCK).cast("int").alias("guests"),
    )
    # Which block pairs a vector takes part in: home blocks b <= c, and home block by guest block.
    b, homes, guests = F.col("block"), F.col("homes"), F.col("guests")
    none = F.array().cast("array<struct<one:int,two:int>>")
    as_home = F.concat(
        F.transform(F.sequence(F.lit(0), homes - 1), lambda o: F.struct(F.least(b, o).alias("one"), F.greatest(b, o).alias("two"))),
        F.when(guests > 0, F.transform(F.sequence(F.lit(0), guests - 1), lambda g: F.struct(b.alias("one"), (-1 - g).cast("int").alias("two")))).otherwise(none),
    )
    as_guest = F.transform(F.sequence(F.lit(0), homes - 1), lambda o: F.struct(o.alias("one"), (-1 - b).cast("int").alias("two")))
    tiles = (
        dealt.join(blocks, group)
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.when(F.col("guest"), guests).otherwise(homes).cast("long")).cast("int"))
        .select("*", F.explode(F.when(F.col("guest"), as_guest).otherwise(as_home)).alias("t"))
        .select(*group, "t.one", "t.two", "vec_id", "unit", "copies", "guest", "block")
    )
    met = stage(tiles.groupBy(*group, "one", "two").applyInArrow(_compare(threshold), "vec_id long, links long, root long"), "met")
    drop(dealt)
    labels = components(met.select(F.col("vec_id").alias("a"), F.col("root").alias("b")), "vectors")
    links = met.groupBy("vec_id").agg(F.sum("links").alias("links"))
    per_class = (
        classes.select("label", "dim", "digest", "vec_id", "copies").join(links, "vec_id", "left").join(labels.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select("label", "dim", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    )
    found = able.select("vec_id", "label", "dim", "digest").join(per_class, ["label", "dim", "digest"]).select("vec_id", "n_links", "component_id")
    alone = every.where("digest IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone)


SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
c AS (SELECT vec_id AS a, vec_id AS r FROM embeddings UNION SELECT c.a, p.b FROM c JOIN p ON c.r = p.a),
k AS (SELECT a, min(r) AS component_id FROM c GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN k ON k.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
