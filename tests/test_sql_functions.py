"""The functions in SQL against the expressions of the library."""

import random

import pytest
from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import functions as F

from gleaner.functions import sql
from gleaner.functions import text as T
from gleaner.functions import vector as V


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    sql.register(spark)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    bits = ["word", "a", ". ", "\n", "\n\n", " ", "  ", "# head", "\n## Sub ", "\x85", "é中😀", "!", "? ", "x" * 30, "\t"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    return spark.createDataFrame([*rows, (900, None), (901, ""), (902, " \n "), (903, "y" * 5000), (904, "long text. " * 3000)], "doc_id long, text string").cache()


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("name", "native"), [("chunk_fixed", T.chunk_fixed), ("chunk_markdown", T.chunk_markdown)])
@pytest.mark.parametrize(("size", "overlap"), [(40, 10), (25, 0), (500, 50), (7, 6)])
def test_chunkers(spark, docs, name, native, size, overlap):
    got = spark.sql(f"SELECT d.doc_id, c.* FROM {{docs}} d, LATERAL {name}(d.text, {size}, {overlap}) c", docs=docs)
    assert rows(got) == rows(docs.select("doc_id", F.posexplode(native(F.col("text"), size, overlap))))


def test_semantic_chunks(spark, docs):
    parts = docs.withColumn("parts", T.sentences(F.col("text")))
    made = parts.withColumn("vectors", F.transform("parts", lambda s: F.array((F.length(s) % 3 - 1).cast("double"), (F.length(s) % 2).cast("double"))))
    got = spark.sql("SELECT d.doc_id, c.* FROM {d} d, LATERAL chunk_semantic(d.text, d.vectors, 0.4, 60, 10) c", d=made)
    assert rows(got) == rows(made.select("doc_id", F.posexplode(T.chunk_semantic(F.col("parts"), F.col("vectors"), V.cosine_distance, 0.4, 60, 10))))
    with pytest.raises(PythonException, match="sentences but"):
        spark.sql("SELECT * FROM chunk_semantic('One. Two.', array(array(1D)))").collect()


def test_sentences(spark, docs):
    got = spark.sql("SELECT d.doc_id, s.* FROM {docs} d, LATERAL text_sentences(d.text) s", docs=docs)
    assert rows(got) == rows(docs.select("doc_id", F.posexplode(T.sentences(F.col("text")))))


def test_defaults_and_other_columns(spark):
    wide = spark.sql("SELECT 'clash' AS chunk_index, 1 AS size, repeat('some words ', 100) AS text")
    got = spark.sql("SELECT c.chunk_index, length(c.text) AS n FROM {wide} w, LATERAL chunk_fixed(w.text) c", wide=wide)
    assert [r["chunk_index"] for r in got.collect()] == [0, 1, 2]


@pytest.mark.parametrize("call", ["chunk_fixed(d.text, 5, 5)", "chunk_fixed(d.text, 5, -1)", "chunk_fixed(d.doc_id)", "chunk_markdown(d.text, CAST(d.doc_id AS INT))", "chunk_fixed()"])
def test_what_is_refused_at_analysis(spark, docs, call):
    with pytest.raises(AnalysisException):
        spark.sql(f"SELECT * FROM {{docs}} d, LATERAL {call} c", docs=docs)


def test_scalar_functions(spark):
    rng = random.Random(4)
    pairs = [([rng.uniform(-1, 1) for _ in range(5)], [rng.uniform(-1, 1) for _ in range(5)]) for _ in range(20)] + [([0.0, 0.0], [1.0, 2.0]), ([], []), (None, [1.0])]
    df = spark.createDataFrame(pairs, "u array<double>, v array<double>")
    got = spark.sql("SELECT cosine_similarity(u, v) AS c, vector_dot(u, v) AS d, euclid_distance(u, v) AS e FROM {df}", df=df).collect()
    want = df.select(V.cosine(F.col("u"), F.col("v")).alias("c"), V.dot(F.col("u"), F.col("v")).alias("d"), V.euclid(F.col("u"), F.col("v")).alias("e")).collect()
    for a, b in zip(got, want, strict=True):
        assert [x is None for x in a] == [x is None for x in b] and all(x is None or abs(x - y) < 1e-12 for x, y in zip(a, b, strict=True))
    assert tuple(spark.sql("SELECT text_preview('abcdef', 3), text_preview('abc'), file_ending('/a.b/C.TXT'), file_ending('/a/.hidden')").first()) == ("abc...", "abc", ".txt", "")


def test_scalar_functions_stay_in_the_jvm(spark):
    plan = spark.sql("SELECT cosine_similarity(array(id * 1D), array(2D)) FROM range(9)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_unknown_names_raise(spark):
    with pytest.raises(ValueError, match="chunk_fixed"):
        sql.register(spark, ("chunk_nothing",))
