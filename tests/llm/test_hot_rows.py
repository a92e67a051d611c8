"""Many equal rows of one id, or of none: no group or task may hold them all."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import common, exact_dedup, mixing, packing, queries, url_filter


def equal_rows(spark, n, doc_id):
    one = F.lit(doc_id).cast("long")
    return spark.range(0, n, 1, 8).select(one.alias("doc_id"), F.lit("one and the same text").alias("text"), F.lit("s").alias("source"))


@pytest.mark.parametrize("doc_id", [7, 8, None])
def test_exact_dedup_deals_equal_rows_out(spark, doc_id):
    docs = equal_rows(spark, 200_000, doc_id)
    runs = exact_dedup.sorted_runs(docs)
    largest = runs.groupBy("salt").agg(F.max("copies").alias("n")).agg(F.max("n")).first()[0]
    assert largest < 4_000
    got = exact_dedup.dedup_exact(docs).agg(F.count("*").alias("n"), F.min("group_size").alias("g"), F.sum(F.col("kept").cast("int")).alias("kept"), F.count("keep_id").alias("ids")).first()
    assert tuple(got) == (200_000, 200_000, 1, 0 if doc_id is None else 200_000)


def test_packing_deals_equal_rows_out(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 2_000)
    packed = packing.pack(equal_rows(spark, 20_000, None), queries.tokenizer_files())
    groups = packed.groupBy(F.col("sequence_id") % 20).count().collect()
    assert len(groups) == 10 and max(r["count"] for r in groups) < 2_400
    assert packed.count() == 20_000 and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()


@pytest.mark.parametrize("doc_id", [5, None])
def test_mixing_deals_equal_rows_out(spark, monkeypatch, doc_id):
    staged = []
    original = mixing.stage
    monkeypatch.setattr(mixing, "stage", lambda df, label: staged.append(original(df, label)) or staged[-1])
    mixed = mixing.mix(equal_rows(spark, 200_000, doc_id))
    got = mixed.agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("taken").alias("most"), F.min("source_size")).first()
    assert got["n"] == 200_000 and got["most"] <= 10 and abs(got["taken"] - 1_500_000) < 2_000 and got[3] == 1_000_000
    own = staged[0].select(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("number").cast("string")).cast("binary")).alias("h"))
    assert own.groupBy(F.substring("h", 1, 3)).count().agg(F.max("count")).first()[0] < 200


def test_components_of_a_star(spark):
    """A hot vertex: minima are tables of their own, so that the join with them may be split."""
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "16k",
    }
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    plans, original = [], common.stage

    def staged(df, label):
        out = original(df, label)
        if label == "star":
            # What is written is planned anew: run it once more to see how its joins were dealt.
            if "Join" in df._jdf.queryExecution().optimizedPlan().toString():
                df.collect()
                plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    common.stage, held = staged, common.stage
    try:
        edges = spark.range(1, 200_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
        got = common.components(edges, "star").agg(F.count("*").alias("n"), F.max("component").alias("c")).first()
    finally:
        common.stage = held
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tuple(got) == (200_001, 0)
    assert any("skew=true" in p for p in plans)


def test_components_of_a_long_path(spark):
    """Far beyond the shallow groups that copies form; no number of rounds ends it early."""
    edges = spark.range(0, 3_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert common.components(edges, "path").select("component").distinct().collect() == [(0,)]


def tail(a: int, b: int) -> float:
    """P(beta(a, b) > 1/2) of whole numbers: a sum of binomial terms of a + b - 1 tosses."""
    n = a + b - 1
    k = np.arange(max(0, min(a, n // 2) - int(60 * math.sqrt(n))), a)
    logs = math.lgamma(n + 1) - np.array([math.lgamma(i + 1) + math.lgamma(n - i + 1) for i in k.tolist()]) - n * math.log(2)
    return float(np.exp(logs).sum())


@pytest.mark.parametrize("n", [1_000, 100_000, 10_000_000])
def test_probability_of_many_outcomes(spark, n):
    pairs = [(n // 2, n // 2), (n // 2 + int(0.8 * math.sqrt(n)), n // 2 - int(0.8 * math.sqrt(n))), (n // 2 - int(0.5 * math.sqrt(n)), n // 2), (int(0.52 * n), int(0.48 * n)), (n // 10, n)]
    got = {(r["a"], r["b"]): r["above"] for r in url_filter.beta_above(spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "a double, b double"), 0.5).collect()}
    for a, b in pairs:
        assert abs(got[float(a), float(b)] - tail(a, b)) < 1e-6, (a, b)


def test_many_outcomes_of_a_host_are_not_scaled_down(spark):
    counts = spark.createDataFrame([("a.com", 100_000, 52_000), ("b.com", 100_000, 48_000)], "host string, n long, x long")
    got = {r["host"]: r["above"] for r in url_filter.host_reputation(counts).collect()}
    assert got["a.com"] > 0.999999 and got["b.com"] < 1e-6
