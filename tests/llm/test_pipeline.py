"""The pipeline's stages, each against a plain version of its decision."""

import corpus_pipeline as C
from gleaner.llm import language_id, mixing
from gleaner.llm.common import components, stage


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, step in C.STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
        assert docs.columns == columns
        seen[name] = docs.toPandas()
    texts = seen["language_id"]
    assert len(texts) >= 0.98 * 1000
    bare = texts.assign(bare=texts.text.str.replace("[ \t-\r]", "", regex=True), order=-texts.text.str.len())
    kept = bare.sort_values(["order", "doc_id"]).drop_duplicates("bare").doc_id
    assert sorted(seen["exact_dedup"].doc_id) == sorted(kept)
    from test_tables import components as plain

    links = plain(list(zip(seen["exact_dedup"].doc_id, seen["exact_dedup"].text, strict=True)), k=5, percent=80)
    assert sorted(seen["ngram_join"].doc_id) == sorted({c for _, c in links.values()})
    taken = mixing.mix(spark.createDataFrame(seen["ngram_join"])).toPandas()
    copies = {d: int(t / s + 0.5) for d, t, s in zip(taken.doc_id, taken.taken, taken["size"], strict=True) if s}
    assert seen["mixing"].doc_id.value_counts().to_dict() == {d: c for d, c in copies.items() if c}
    packed = C.STAGES[-1][1](spark, docs, sf_dir).toPandas()
    assert set(packed.doc_id) == set(seen["mixing"].doc_id)
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


def test_rejects_what_has_no_letters(spark):
    docs = spark.createDataFrame([(1, "12 34", "en", "s", 5), (2, None, "en", "s", 0), (3, "the and of the", "en", "s", 14), (4, "the of and", "en", "s", 10), (5, "and the of it", "en", "s", 13)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in C.identify_language(spark, docs, "").collect()}
    assert not got & {1, 2} and language_id.held_out() is not None


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1001), (1001, 1000), (7, 7)] + [(5000, 5000 + i) for i in range(1, 50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and got[1001] == 1000 and {got[5000 + i] for i in range(50)} == {5000}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_rows_that_share_an_id(spark):
    """Repeated rows leave exactly one, and two texts of one id are judged, kept and mixed apart."""
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    near = a.replace("a30 ", "other ")
    rows = [(1, a), (1, a), (1, a), (2, b), (2, c), (3, c), (9, near), (9, b + " "), (4, None), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    exact = stage(C.drop_exact_copies(spark, docs, ""), "exact_dedup")
    assert exact.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in exact.collect()) == sorted([(1, a), (2, c), (9, near), (9, b + " "), (4, "")])
    twice = docs.where("doc_id = 1").unionByName(exact.where("doc_id = 9")).unionByName(exact.where("doc_id = 2"))
    closer = a.replace("a59", "other")
    twice = twice.unionByName(spark.createDataFrame([(0, closer, "en", "s", 0), (0, b, "en", "s", 0)], docs.schema))
    kept = stage(C.drop_near_copies(spark, twice, ""), "ngram_join")
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(0, closer), (0, b), (2, c)])
    two = stage(spark.createDataFrame([(5, " ".join(["w"] * n), "en", "s", 0) for n in (640, 1280)] + [(6, " ".join(["v"] * 1280), "en", "s", 0)], docs.schema), "two")
    mixed = [len(r.text.split()) for r in C.mix_sources(spark, two, "").collect()]
    assert {640, 1280} == set(mixed) and len(mixed) <= 2 * 3 and abs(sum(mixed) - 1.5 * 3200) <= 1280


def test_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, copy int, copies int, row_key int, score int, lang_pred string, component int, size int"
    for name, step in C.STAGES:
        assert stage(step(spark, spark.createDataFrame([], schema), ""), name).count() == 0
    text = " ".join(f"the and of w{i}" for i in range(100))
    rows = [(1, text, "en"), (2, text, "en"), (3, text.replace("w7 ", "x "), "en"), (4, " ".join(f"der und die {i}x" for i in range(90)), "de")]
    docs = spark.createDataFrame([(i, t, g, "s", len(t), 1, 2, 3, 4, "clash", 5, 6) for i, t, g in rows], schema)
    for (name, step), left in zip(C.STAGES[:-1], ({1, 2, 3, 4}, {1, 3, 4}, {1, 4}, {1, 4}), strict=True):
        docs = stage(step(spark, docs, ""), name)
        got = docs.collect()
        assert docs.columns == [c.split()[0] for c in schema.split(", ")] and {r["doc_id"] for r in got} == left
        assert all(tuple(r)[5:] == (1, 2, 3, 4, "clash", 5, 6) for r in got)
    assert C.STAGES[-1][1](spark, docs, "").count() >= 2


def test_very_long_texts(spark):
    words = [f"w{i}" for i in range(150_000)]
    long, near = " ".join(words), " ".join([*words[:-9], "other"])
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, near, "en", "s", 0), (2, long, "en", "s", 0), (3, f"{long} ", "en", "s", 0), (4, "the and of a short text", "en", "s", 0)], schema)
    exact = stage(C.drop_exact_copies(spark, docs, ""), "exact_dedup")
    assert {r["doc_id"] for r in exact.collect()} == {1, 3, 4}
    assert {r["doc_id"] for r in C.drop_near_copies(spark, exact, "").collect()} == {1, 4}
