"""Searches by an index against scans of all points."""

import random

import pytest


from gleaner.operators import index, search


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(1500):
        centre = random.Random(i % 12)
        vector = [centre.gauss(0, 1) + rng.gauss(0, 0.1) for _ in range(8)]
        rows.append((f"p{i:04}", vector, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40) if i % 50 else 400)), "ab"[i % 2]))
    rows += [("zero", [0.0] * 8, "w1", "a"), ("none", None, None, "a"), ("nan", [float("nan")] * 8, "", "a"), ("tie1", rows[7][1], rows[7][2], "a"), ("tie0", rows[7][1], rows[7][2], "b")]
    return spark.createDataFrame(rows, "id string, dense array<double>, text string, source string").repartition(4).cache()


def listed(df):
    return [(r["id"], r["score"]) for r in df.collect()]


@pytest.mark.parametrize("metric", ["cosine", "euclid"])
def test_dense_equals_a_scan(spark, points, tmp_path, metric):
    index.build_dense(points, str(tmp_path), metric)
    whole = points.where("id <> 'nan'")
    shares = []
    for n, limit in ((7, 5), (3, 1), (100, 40), (None, 5), (7, 3000)):
        query = [0.3, -1.0, 0.2, 0.0, 1.0, 0.4, -0.7, 0.1] if n is None else points.where(f"id = 'p{n:04}'").first()["dense"]
        found = index.search_dense(spark, str(tmp_path), query, limit)
        want = search.dense(whole.where("id <> 'zero'") if metric == "cosine" else whole, query, limit, metric)
        assert listed(found.hits) == listed(want)
        shares.append(found.read / found.points)
    assert min(shares) < 0.25 and shares[-1] == 1.0
    assert "cell" not in found.hits.columns and "source" in found.hits.columns


def test_dense_with_a_filter(spark, points, tmp_path):
    index.build_dense(points, str(tmp_path))
    query = points.where("id = 'p0007'").first()["dense"]
    got = index.search_dense(spark, str(tmp_path), query, 6, filters={"source": "b"})
    assert listed(got.hits) == listed(search.dense(points.where("id <> 'nan'"), query, 6, filters={"source": "b"}))


def test_dense_reads_only_the_cells_it_needs(spark, points, tmp_path):
    index.build_dense(points, str(tmp_path))
    query = points.where("id = 'p0007'").first()["dense"]
    plan = index.search_dense(spark, str(tmp_path), query, 3).hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan or "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_inner_products_are_refused(points, tmp_path):
    with pytest.raises(ValueError, match="triangle"):
        index.build_dense(points, str(tmp_path), "dot")


def test_vectors_of_several_lengths_are_refused(spark, tmp_path):
    mixed = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0, 3.0])], "id string, dense array<double>").repartition(2)
    with pytest.raises(Exception, match="dimensions|inhomogeneous"):
        index.build_dense(mixed, str(tmp_path), "euclid")


@pytest.mark.parametrize("text", ["w1 w2 w3", "w5", "w1 w1 w1 w59", "nothing of this", "", "W1 w2, w3; w4 w5 w6 w7"])
def test_sparse_equals_a_scan(spark, points, tmp_path, text):
    index.build_postings(points, str(tmp_path))
    for limit in (1, 5, 2000):
        assert listed(index.search_sparse(spark, str(tmp_path), text, limit)) == listed(search.sparse(points, text, limit))


def test_empty_collection(spark, tmp_path):
    none = spark.createDataFrame([], "id string, dense array<double>, text string")
    index.build_dense(none, f"{tmp_path}/d")
    assert index.search_dense(spark, f"{tmp_path}/d", [1.0], 5).hits.collect() == []
    index.build_postings(none, f"{tmp_path}/p")
    assert index.search_sparse(spark, f"{tmp_path}/p", "w1", 5).collect() == []


def test_postings_are_pruned_by_bucket(spark, points, tmp_path):
    index.build_postings(points, str(tmp_path))
    plan = index.search_sparse(spark, str(tmp_path), "w1 w2", 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in plan.split("PushedFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("name", ["search_dense_cosine_indexed", "search_dense_euclid_indexed", "search_sparse_indexed"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    from compare import duckdb_rows, spark_rows

    from gleaner.plans import indexed

    assert spark_rows(indexed.QUERIES[name](spark, sf_dir)) == duckdb_rows(indexed.ORACLE_SQL[name], sf_dir)
