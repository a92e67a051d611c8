"""Plans in which costly steps stand once, and counts that need no shuffle of words."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import registry, search, sections
from gleaner.plans import catalogue


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def bucket(word, n=T.SPARSE_BUCKETS):
    return int(hashlib.sha256(word.encode()).hexdigest(), 16) % n


TEXTS = [(1, "A b a_1 ß b"), (2, None), (3, ""), (1, "b C"), (None, "x y x"), (4, "é中 4 𝔘 ... ½")]


def test_buckets_are_counted_in_rows(spark):
    df = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(TEXTS)], "id long, text string")
    want = [sorted(Counter(bucket(w) for w in re.findall(r"\w+", (t or "").lower())).items()) for _, t in TEXTS]
    assert [[tuple(x) for x in r["c"]] for r in df.select("id", T.bucket_counts(T.tokens(F.col("text"))).alias("c")).sort("id").collect()] == want
    for n in (7, 64, 10_000, 65_536):
        for r in df.select(F.explode(T.tokens(F.col("text"))).alias("w")).select("w", T.hash_bucket(F.col("w"), n).alias("b")).collect():
            assert r["b"] == bucket(r["w"], n)


def test_term_counts_move_rows_once(spark):
    df = search.term_counts(spark.createDataFrame(TEXTS, "id long, text string"))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = Counter((i, bucket(w)) for i, t in TEXTS for w in re.findall(r"\w+", (t or "").lower()))
    assert {(r["id"], r["bucket"]): r["tf"] for r in df.collect()} == want


def test_a_word_is_hashed_once_by_the_embedder(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "x string").select(registry.embedders.create("hashed", 16)(F.col("x")).alias("v"))
    assert plan_of(df).count("sha2(") == 1
    first, empty, none = [r["v"] for r in df.collect()]
    counts = Counter(bucket(w, 16) for w in "aba")
    size = sum(n * n for n in counts.values()) ** 0.5
    assert first == [counts[i] / size for i in range(16)] and empty == [0.0] * 16 == none


def test_a_window_is_read_once_a_chunk(spark):
    assert plan_of(spark.createDataFrame([("a b",)], "x string").select(T.chunk_fixed(F.col("x")))).count("reverse(") <= 2


def test_a_body_is_parsed_once(spark):
    df = spark.createDataFrame([("# Summary\n[answer here]\n# Summary\nlong enough here",), (" \n",), (None,), ("# Verification\n- \n",)], "x string").select(sections.errors(F.col("x")).alias("e"))
    assert plan_of(df).count("split(") == 1
    missing = "missing: Discussion & Pitfalls"
    assert [r["e"] for r in df.collect()] == [
        ["missing: Key Changes", missing, "missing: Verification"], ["empty"], ["empty"], ["missing: Summary", "missing: Key Changes", missing, "too short: Verification 0"],
    ]


def test_a_run_reads_what_it_stored(spark, sf_dir):
    _, run = catalogue._run(spark, sf_dir)
    for table in (run.points, run.jobs):
        assert all("/ingest-run-" in f for f in table.inputFiles())
