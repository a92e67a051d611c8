import re
import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from gleaner.llm import language_id as L


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 300")
    odd = [(10_000, None), (10_001, ""), (10_002, "123 ... \n"), (10_003, "日本"), (10_004, "the and of " * 20_000), (10_005, "a\0b"), (10_006, "x")]
    more = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in odd], docs.schema)
    both = docs.unionByName(more).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(both).collect()}
    assert [got[i] for i in (10_000, 10_001, 10_002)] == [("und", 0.0)] * 3
    assert got[10_004][0] == "en" and got[10_003][0] != "und"


def test_nothing_to_learn_from(spark):
    schema = "doc_id long, text string, lang string"
    assert L.identify(spark.createDataFrame([], schema)).collect() == []
    rows = L.identify(spark.createDataFrame([(1, "hello", None), (2, None, "en")], schema)).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0.0)}


def test_weights_are_sparse_and_labels_unseen_in_prediction():
    rows = [("the cat and the dog " * 3, "en"), ("der hund und die katze " * 3, "de")] * 60
    model = L.train(rows)
    assert model.languages == ["de", "en"] and (model.table == 0).mean() > 0.9
    p, has = model.scores(["the dog", "die katze", "42"], L._letters())
    assert p[0].argmax() == 1 and p[1].argmax() == 0 and has.tolist() == [True, True, False]


def test_a_rare_language_is_learned(spark):
    common = spark.range(40_000).selectExpr("id AS doc_id", "concat('the cat and the dog ', id) AS text", "'en' AS lang")
    rare = spark.range(40_000, 40_020).selectExpr("id AS doc_id", "concat('der hund und die katze ', id) AS text", "'de' AS lang")
    model = L.fit(common.unionByName(rare), F.lit(True), sample=100)
    assert model.languages == ["de", "en"]
    assert model.scores(["der hund und die katze", "the cat and the dog"], L._letters())[0].argmax(axis=1).tolist() == [0, 1]


def test_slices_hold_the_ngrams_of_the_whole_text():
    letters = L._letters()
    for text in ("the cat  and 12 the dog", "a\0b  c", "", "x", "日本 語", "  -- a", "\0", "no" * 40):
        whole, _, has = L.ngram_features([text], letters)
        for size in (1, 2, 3, 7, 1000):
            parts = list(L.sliced_features(text, letters, size))
            ids = np.concatenate([i.ravel() for i, _ in parts]) if parts else np.zeros(0, int)
            assert (np.bincount(ids, minlength=L.DIM + 1)[: L.DIM] == np.bincount(whole.ravel(), minlength=L.DIM + 1)[: L.DIM]).all()
            assert any(h for _, h in parts) == bool(has[0])


def test_memory_does_not_grow_with_one_text():
    model = L.train([("the cat and the dog " * 3, "en"), ("der hund und die katze " * 3, "de")] * 30)
    text = "der hund und die katze \n" * 700_000
    tracemalloc.start()
    p, _ = model.scores([text], L._letters())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert p[0].argmax() == 0 and peak < 100e6
    assert np.allclose(p, model.scores([text[: 24 * 100]], L._letters())[0], atol=1e-2)


def test_scores_against_a_plain_recomputation():
    model = L.train([("the cat and the dog " * 3, "en"), ("der hund und die katze " * 3, "de"), ("le chat et le chien " * 3, "fr")] * 30)
    for text in ("Der Hund, der (42) the!", "le  chat", "É"):
        x = " " + re.sub(r"[\W\d_]+", " ", text.lower()) + " "
        x = re.sub(" +", " ", x)
        grams = [x[i : i + n] for n in (1, 2, 3) for i in range(len(x) - n + 1) if x[i : i + n] != " "]
        total = np.zeros(3)
        for g in grams:
            h = 0
            for place, c in enumerate(g):
                v = ord(c) * 0x9E3779B97F4A7C15
                h = v if place == 0 else ((h ^ (0x51 if place == 1 else 0x7F)) * (0xC2B2AE3D27D4EB4F if place == 1 else 0x165667B19E3779F9) + v)
                h &= 2**64 - 1
            feature = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & (2**64 - 1)) >> 49
            total += model.table[feature]
        z = (total / len(grams) + model.bias) / model.temperature
        e = np.exp(z - z.max())
        assert np.allclose(model.scores([text], L._letters())[0][0], e / e.sum(), atol=1e-6)


def test_long_rows_are_learned_from_only_where_there_are_no_others(spark, monkeypatch):
    monkeypatch.setattr(L, "LONGEST", 100)
    rows = [(i, f"the cat and the dog {i}", "en") for i in range(60)] + [(100, "xyz " * 100, "en"), (101, "der hund und die katze " * 20, "de")]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.languages == ["de", "en"]
    learned = sorted((r for r in rows if r[0] != 100), key=lambda r: str(r[0]))
    assert np.array_equal(model.table, L.train([(t, lang) for _, t, lang in learned]).table)
