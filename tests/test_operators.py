import pytest
from pyspark.sql import functions as F

from gleaner.functions import vector as V
from gleaner.operators import errors, ingest, registry, search, sections, sessions, sheets
from gleaner.sources import files
from gleaner.sources.collection import Collections
from gleaner.streaming import events as E


def points(spark):
    rows = [("1", [1.0, 0.0, 0.0], [0.0, 1.0], "quantum physics", "science"), ("2", [0.0, 1.0, 0.0], None, "cooking pasta", "food"), ("3", [0.9, 0.1, 0.0], [1.0, 0.0], "quantum pasta", "science")]
    return spark.createDataFrame(rows, "id string, dense array<double>, image array<double>, text string, category string")


def test_search_kinds(spark):
    p = points(spark)
    assert [r["id"] for r in search.dense(p, [1.0, 0.0, 0.0], 2).collect()] == ["1", "3"]
    assert [r["id"] for r in search.dense(p, [0.0, 1.0, 0.0], 1, filters={"category": "science"}).collect()] == ["3"]
    assert [r["id"] for r in search.dense(p, [0.0, 1.0], 5, column="image").collect()] == ["1", "3"]
    assert [r["id"] for r in search.sparse(p, "pasta pasta").collect()] == ["2", "3"]
    assert search.sparse(p, "").count() == 0
    hits = search.search(p, [1.0, 0.0, 0.0], 3, query_text="quantum", search_type="hybrid", answer_fields=["category"])
    assert hits.columns == ["id", "score", "category"]
    assert [r["id"] for r in hits.collect()][:2] == ["1", "3"]
    assert [r["id"] for r in search.search(p, [1.0, 0.0, 0.0], 1, metric="EUCLID").collect()] == ["1"]
    with pytest.raises(ValueError):
        search.search(p, [1.0], search_type="other")
    assert search.allowed_filters({"source": 1, "x": 2}) == {"source": 1}
    assert search.allowed_filters({"x": 2}, []) == {"x": 2}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], [1.0, 0.0, 9.0])], "u array<double>, v array<double>")
    got = df.select(V.cosine_distance(F.col("u"), F.col("v")).alias("d"), V.dot(F.col("u"), F.col("v")).alias("p")).collect()
    assert got[0]["d"] == 1.0 and got[1]["p"] == 1.0


def test_filter_reaches_the_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "lang", "n_chars")
    plan = search.filtered(docs, {"lang": "en"})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "text" not in plan.split("ReadSchema")[1]


def test_deltas_over_files(spark, tmp_path):
    (tmp_path / "doc1.txt").write_text("one")
    (tmp_path / "DOC2.MD").write_text("# two")
    (tmp_path / "other.bin").write_text("no")
    state = spark.createDataFrame([], ingest.STATE)
    assert sorted(r["action"] for r in files.deltas_of_directory(spark, str(tmp_path), state, "c").collect()) == ["NEW", "NEW"]
    scan = files.scan_directory(spark, str(tmp_path))
    deltas = ingest.detect_deltas(scan, state, "c")
    jobs = ingest.run_jobs(scan, deltas)
    chunks = ingest.chunk_documents(jobs.where("action <> 'DELETED'"))
    state = spark.createDataFrame(ingest.merge_state(state, scan, jobs, chunks, "c").collect(), ingest.STATE)
    assert state.count() == 2 and all(len(r["chunk_ids"]) == 1 for r in state.collect())
    assert ingest.detect_deltas(files.scan_directory(spark, str(tmp_path)), state, "c").count() == 0
    (tmp_path / "doc1.txt").write_text("changed")
    (tmp_path / "DOC2.MD").unlink()
    again = files.deltas_of_directory(spark, str(tmp_path), state, "c").collect()
    assert sorted(r["action"] for r in again) == ["DELETED", "MODIFIED"]
    assert files.deltas_of_directory(spark, str(tmp_path / "none"), state, "c").count() == 0
    assert {r["name"] for r in files.list_files(spark, str(tmp_path)).collect()} == {"doc1.txt", "other.bin"}


def test_failed_jobs_leave_state(spark):
    state = spark.createDataFrame([("a", "c", 1.0, "h", ["x"])], ingest.STATE)
    scan = spark.createDataFrame([("a", 2.0, "g", None)], "filepath string, last_modified double, hash string, content binary")
    jobs = ingest.run_jobs(scan, ingest.detect_deltas(scan, state, "c"))
    assert jobs.first()["status"] == "FAILED"
    none = spark.createDataFrame([], "filepath string, chunk_index int, chunk_id string")
    assert [tuple(r) for r in ingest.merge_state(state, scan, jobs, none, "c").collect()] == [("a", "c", 1.0, "h", ["x"])]


def test_collections(spark, tmp_path):
    db = Collections(spark, str(tmp_path / "db"))
    assert db.health()["collections"] == []
    db.create("c", 3, "unknown metric")
    db.upsert("c", points(spark).withColumn("tag", F.lit("t")))
    db.create("c", 99)
    assert db.read("c").count() == 3
    assert db.read("c").where("id = '1'").first()["metadata"] == {"tag": "t"}
    db.upsert("c", points(spark).where("id = '1'").withColumn("text", F.lit("new")))
    assert {r["id"]: r["text"] for r in db.read("c").collect()}["1"] == "new" and db.read("c").count() == 3
    db.delete("c", ["2"])
    assert db.names() == ["c"] and db.read("c").count() == 2
    assert db.search("missing", [1.0]).count() == 0
    assert db.search("missing", [1.0, 0.0, 0.0], default="c", limit=1).first()["id"] == "1"
    embed = registry.embedders.create("hashed", 8)
    texts = spark.createDataFrame([("hello world",), ("other",)], "text string")
    db.store(texts, embed, "s")
    db.store(texts, embed, "s")
    assert db.read("s").count() == 2
    with pytest.raises(ValueError):
        db.store(spark.createDataFrame([("  ",)], "text string"), embed, "s")


def test_zip_points_raises(spark):
    df = spark.createDataFrame([([1, 2], [[1.0]])], "i array<int>, v array<array<double>>")
    with pytest.raises(Exception, match="differ in number"):
        df.select(ingest.zip_points(F.col("i"), F.col("v"))).collect()


def test_registry(spark):
    r = registry.Registry("thing")
    r.register("a", lambda x=1: x)
    assert r.create("a", x=2) == 2
    assert r.load([{"type": "a", "x": 5}, {"type": "b"}], strict=False) == {"a": 5}
    with pytest.raises(ValueError):
        r.load([{"type": "b"}])
    with pytest.raises(ValueError):
        registry.backends.create("none")
    calls = registry.embedders.create("batched", lambda texts: [[float(len(t))] for t in texts], 1)
    df = spark.createDataFrame([("abc",), ("d",)], "x string")
    assert [r["v"] for r in df.select(calls(F.col("x")).alias("v")).collect()] == [[3.0], [1.0]]
    docs = spark.createDataFrame([("f", "Paragraph 1 is here. And then some more words")], "filepath string, text string")
    got = registry.operators.create("fixed_chunks", size=30, overlap=10)(docs).orderBy("chunk_index").collect()
    assert got[0]["text"] == "Paragraph 1 is here. And then"
    assert registry.operators.create("markdown_chunks")(docs).count() == 1


def test_sheets(spark):
    sheet = spark.createDataFrame([(1, ["w", "x"]), (2, ["a"]), (3, ["b", "c", "d"])], "row_no long, cells array<string>")
    assert [r["cells"] for r in sheets.read_range(sheet, "A2:B3").collect()] == [["a"], ["b", "c"]]
    assert sheets.read_cell(sheet, "C3") == "d" and sheets.read_cell(sheet, "C2") is None
    assert sheets.parse_range("AA1:AB2") == (1, 2, 27, 28)
    new = sheets.write_verified(sheet, "B2", [["p", "q"]])
    assert {r["row_no"]: r["cells"] for r in new.collect()}[2] == ["a", "p", "q"]
    with pytest.raises(ValueError):
        sheets.write_verified(sheet, "A1", [["x"], ["y"]], store=lambda s: s.where("row_no > 1"))
    with pytest.raises(ValueError):  # as many cells, but not those that were written
        sheets.write_verified(sheet, "A1", [["x"], ["y"]], store=lambda s: s.withColumn("cells", F.transform("cells", lambda c: F.upper(c))))
    assert sheets.write_verified(sheet, "A1", [["x"], ["y"]], store=lambda s: s).count() == 3
    batch = {r["row_no"]: r["cells"] for r in sheets.write_batch(sheet, {"A1": [["true"]], "B3:C3": [["'1", "q"]], "A5": [["n"]]}).collect()}
    assert batch == {1: ["TRUE", "x"], 2: ["a"], 3: ["b", "1", "q"], 5: ["n"]}
    assert sheets.write_batch(sheet, {"A2": [["'x"]]}, raw=True).where("row_no = 2").first()["cells"] == ["'x"]
    gap = spark.createDataFrame([(1, ["a"]), (2, ["", "b"])], "row_no long, cells array<string>")
    assert {r["row_no"]: r["cells"] for r in sheets.append_rows(gap, [["z"]]).collect()}[2] == ["z", "b"]
    assert sheets.vocab_rows(sheet).where("row_no = 2").first()["Tags"] == ""
    assert sheets.append_rows(sheet, [["z"]]).where("row_no = 4").count() == 1


def test_sections(spark):
    good = "## Summary\nThis is a summary text\n## Key Changes\nchanged many things\n## Discussion & Pitfalls\nnothing to discuss\n## Verification\nran all the tests"

    def wrong(body):
        return spark.createDataFrame([(body,)], "b string").select(sections.errors(F.col("b")).alias("e")).first()["e"]

    assert wrong(good) == []
    assert wrong(" \n ") == ["empty"] and wrong(None) == ["empty"]
    assert wrong(good.replace("This is a summary text", "- [Answer here]")) == ["placeholder: Summary", "too short: Summary 0"]
    assert wrong(good.replace("## Verification", "## Other")) == ["missing: Verification"]
    assert sections.required_of("# Pull Request\n## One\n##\n## Two ") == {"one": "One", "two": "Two"}
    assert sections.required_of(None) == sections.REQUIRED


def test_errors_order(spark):
    df = spark.createDataFrame([("ValueError", None, "quota: forbidden"), ("ReadTimeout", 404, ""), ("X", 404, "timeout"), ("X", None, "code 500.")], "c string, s int, m string")
    assert [r["r"] for r in df.select(errors.retryable(F.col("c"), F.col("s"), F.col("m")).alias("r")).collect()] == [False, True, False, True]


def test_sessions(spark):
    turns = spark.createDataFrame([("a", 0, "user", "hi"), ("a", 1, "assistant", "x" * 70), ("b", 0, "user", "yo")], "session_id string, turn int, role string, content string")
    rows = sessions.summaries(turns, F.col("turn")).collect()
    assert [r["session_id"] for r in rows] == ["a", "b"] and rows[0]["last_message"] == "x" * 60 + "..."
    df = spark.createDataFrame([(2000, 1000), (100, 100)], "w int, h int")
    assert [tuple(r["s"]) for r in df.select(sessions.resized(F.col("w"), F.col("h"), 1000).alias("s")).collect()] == [(1000, 500), (100, 100)]


def test_stream_fold_matches_batch(spark, tmp_path):
    rows = [("a", 1, "token", "He"), ("a", 2, "token", "llo"), ("b", 3, "token", "x"), ("a", 4, "done", "Hello!"), ("b", 5, "cancelled", None), ("c", 6, "error", "bad")]
    events = spark.createDataFrame([(s, n, e, None, t) for s, n, e, t in rows], "session_id string, seq long, event string, tool string, text string")
    events.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).json(str(tmp_path / "in"))
    q = E.fold_stream(stream).writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = {r["session_id"]: (r["content"], r["ended_by"]) for r in spark.table("folded").collect()}
    batch = {r["session_id"]: r["content"] for r in E.fold_messages(events).collect()}
    assert got == {"a": ("Hello!", "done"), "b": ("x\n\n*[Execution Cancelled]*", "cancelled"), "c": ("", "error")}
    assert {k: v[0] for k, v in got.items()} == batch


def test_parse_keeps_the_tail(spark):
    df = spark.createDataFrame([('event: token\ndata: {"text": "a"}\n\nevent: x\n\ndata: {"te',)], "b string")
    done, tail = E.parse(F.col("b"))
    row = df.select(done.alias("d"), tail.alias("t")).first()
    assert [(e["event"], e["data"]["text"]) for e in row["d"]] == [("token", "a")] and row["t"] == 'data: {"te'


def test_images_and_sessions_files(spark, tmp_path):
    (tmp_path / "s1.json").write_text('[{"role": "user", "content": "hi"}]')
    (tmp_path / "bad.json").write_text("{")
    assert [r["session_id"] for r in files.read_sessions(spark, str(tmp_path)).collect()] == ["s1"]
    df = spark.createDataFrame([("data:image/gif;base64,QUJD",), ("/box/a.png",), ("/box/../x",), ("QUJDREVGR0hJSktMTU5P",)], "content string")
    got = files.read_images(df, "/box").collect()
    assert (bytes(got[0]["bytes"]), got[0]["mime"], got[1]["file"]) == (b"ABC", "image/gif", "/box/a.png")
    assert got[2]["error"] and bytes(got[3]["bytes"]) == b"ABCDEFGHIJKLMNO"


def test_session_files_round_trip(spark, tmp_path):
    turns = spark.createDataFrame([(1, "assistant", "yo"), (0, "user", "hi")], "turn int, role string, content string")
    files.write_session(spark, str(tmp_path), "s-1", turns)
    assert [(r["turn"], r["content"]) for r in files.read_sessions(spark, str(tmp_path)).orderBy("turn").collect()] == [(0, "hi"), (1, "yo")]
    files.delete_session(spark, str(tmp_path), "s-1")
    assert files.read_sessions(spark, str(tmp_path)).count() == 0
    with pytest.raises(FileNotFoundError):
        files.delete_session(spark, str(tmp_path), "s-1")
    with pytest.raises(ValueError):
        files.write_session(spark, str(tmp_path), "../x", turns)


def test_config(spark, tmp_path):
    from gleaner.sources import config

    got = config.of_mapping({"directory": "d", "image_dimensions": 8, "file_types": [".TXT"]})
    assert (got.chunk_size, got.file_types, got.dimensions) == (500, (".txt",), None)
    for bad in ({"directory": "d"}, {"directory": "d", "image_dimensions": 1, "x": 2}, {"directory": "d", "image_dimensions": 1, "chunk_overlap": 500}):
        with pytest.raises(ValueError):
            config.of_mapping(bad)
    (tmp_path / "b.yml").write_text("directory: d")
    (tmp_path / "a.yaml").write_text("{}")
    (tmp_path / "c.txt").write_text("hello {x}")
    assert config.listed(str(tmp_path)) == ["a.yaml", "b.yml"]
    assert config.contained("a.yaml", str(tmp_path)).name == "a.yaml"
    for bad in ("../x.yaml", "none.yaml", "c.txt"):
        with pytest.raises(ValueError):
            config.contained(bad, str(tmp_path))
    assert config.template("c.txt", str(tmp_path)) == "hello {x}" and config.template("inline {x}") == "inline {x}"
    assert config.dimensions_of(registry.embedders.create("hashed", 8), spark) == 8


def test_queue_is_replaced(spark):
    deltas = spark.createDataFrame([("b", "NEW"), ("a", "DELETED")], "filepath string, action string")
    new = ingest.job_queue(deltas, "c", 1.0)
    old = ingest.job_queue(deltas, "c", 0.5).unionByName(ingest.job_queue(deltas, "other", 0.5))
    got = ingest.replace_queue(old, new, "c").collect()
    assert sorted((r["collection_name"], r["id"], r["filepath"], r["created_at"]) for r in got) == [("c", 1, "a", 1.0), ("c", 2, "b", 1.0), ("other", 1, "a", 0.5), ("other", 2, "b", 0.5)]


def test_knn_batch_answers_every_query(spark):
    """More queries than a block holds are answered in several blocks, none refused."""
    points = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(40)] + [(99, None)], "id long, dense array<double>")
    queries = points.where("id < 25").select(F.col("id").alias("query_id"), F.col("dense").alias("query"))
    for most in (4, 4096):
        got = search.knn_batch(points, queries, 3, "euclid", most_queries=most).collect()
        best = {(q, n + 1): i for q in range(25) for n, i in enumerate(sorted(range(40), key=lambda i: (abs(i - q), i))[:3])}
        assert len(got) == 75 and {(r["query_id"], r["rank"]): r["id"] for r in got} == best
    assert search.knn_batch(points, queries.limit(0)).collect() == []


def test_retries_follow_the_classifier(spark):
    from gleaner.operators import errors as E2

    class HttpError(Exception):
        def __init__(self, status_code, said=""):
            super().__init__(said)
            self.status_code = status_code

    class ReadTimeout(Exception):
        pass

    cases = [(TimeoutError(), True), (ConnectionResetError(), True), (ReadTimeout(), True), (HttpError(503), True), (HttpError(404, "timeout"), False), (ValueError("quota: forbidden"), False), (ValueError("error 429"), True), (ValueError("bad"), False)]
    assert [E2.is_retryable(e) for e, _ in cases] == [want for _, want in cases]
    waits, calls = [], []

    def flaky(problem, fails):
        def call():
            calls.append(1)
            if len(calls) <= fails:
                raise problem
            return "done"

        calls.clear()
        return E2.retried(call, 3, 7.0, waits.append)

    assert flaky(HttpError(503), 2)() == "done" and waits == [7.0, 7.0]
    with pytest.raises(HttpError):
        flaky(HttpError(503), 3)()
    with pytest.raises(ValueError):
        flaky(ValueError("bad"), 1)()
    assert len(calls) == 1
    made = []

    def stream(begin):
        made.append(1)
        if begin and len(made) == 1:
            raise TimeoutError
        yield 1
        if not begin:
            raise TimeoutError
        yield 2

    assert list(E2.retried_stream(lambda: stream(True), 3, 0.0, waits.append)) == [1, 2] and len(made) == 2
    made.clear()
    got = []
    with pytest.raises(TimeoutError):  # something came out already
        for item in E2.retried_stream(lambda: stream(False), 3, 0.0, waits.append):
            got.append(item)
    assert got == [1] and len(made) == 1
    assert list(E2.retried_stream(lambda: [], 3, 0.0, waits.append)) == []


def test_embedders_that_fail(spark):
    def embed_batch(texts):
        if any("bad" in t for t in texts):
            raise ValueError("cannot")
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("abc",), ("a bad one",), ("d",)], "x string").coalesce(1)
    null = registry.embedders.create("batched", embed_batch, 2, on_error="null")
    assert [r["v"] for r in df.select(null(F.col("x")).alias("v")).collect()] == [[3.0, 1.0], None, [1.0, 1.0]]
    with pytest.raises(Exception, match="cannot"):
        df.select(registry.embedders.create("batched", embed_batch, 2)(F.col("x"))).collect()
    chunks = ingest.chunk_documents(spark.createDataFrame([("f", "One bad. Two. Three. Four.")], "filepath string, text string"), "semantic", 12, 2, lambda parts: F.transform(parts, lambda p: F.when(~p.contains("bad"), F.array(F.lit(1.0)))))
    assert [r["text"] for r in chunks.orderBy("chunk_index").collect()] == [r["text"] for r in ingest.chunk_documents(spark.createDataFrame([("f", "One bad. Two. Three. Four.")], "filepath string, text string"), "fixed", 12, 2).orderBy("chunk_index").collect()]


def test_readers_and_failed_jobs(spark):
    def read_pdf(data):
        if data == b"broken":
            raise OSError("no trailer")
        return f"pdf\0 of {len(data)}\r\n"

    files_ = spark.createDataFrame([("a.pdf", b"1234"), ("b.pdf", b"broken"), ("c.txt", b"text"), ("d.html", b"<p>x &hellip;"), ("e.bin", None)], "filepath string, content binary")
    deltas = files_.select("filepath", F.lit("NEW").alias("action"))
    registry.readers.register("application/pdf", lambda: read_pdf)
    try:
        got = {r["filepath"]: (r["status"], r["error"], r["text"]) for r in ingest.run_jobs(files_, deltas).collect()}
    finally:
        registry.readers.made.clear()
    assert got == {
        "a.pdf": ("COMPLETED", None, "pdf of 4"), "b.pdf": ("FAILED", "OSError: no trailer", ""), "c.txt": ("COMPLETED", None, "text"), "d.html": ("COMPLETED", None, "x …"), "e.bin": ("FAILED", "file cannot be read", ""),
    }
    other = files_.where("filepath = 'c.txt'").withColumn("mime", F.lit("image/png"))
    row = ingest.run_jobs(other, deltas.where("filepath = 'c.txt'")).first()
    assert (row["status"], row["error"]) == ("FAILED", "unsupported MIME type: image/png")
    assert ingest.run_jobs(files_, deltas).where("filepath = 'a.pdf'").first()["text"] == ""


def test_ingestion_end_to_end(spark, tmp_path):
    """Files into a collection: new, changed, gone and failing ones, over three runs."""
    home = tmp_path / "files"
    home.mkdir()
    (home / "a.txt").write_text("alpha words. " * 60)
    (home / "b.md").write_text("# One\nbeta\n# Two\ngamma")
    db = Collections(spark, str(tmp_path / "db"))

    def embed_batch(texts):
        if any("poison" in t for t in texts):
            raise ValueError("cannot")
        return [[float(len(t)), 1.0, 0.0] for t in texts]

    embed = registry.embedders.create("batched", embed_batch, 3, on_error="null")

    def run(state):
        return db.ingest("notes", files.scan_directory(spark, str(home)), state, embed, 3, size=100, overlap=10)

    def texts():
        return {(r["filepath"].rsplit("/", 1)[-1], r["chunk_index"]): r["text"] for r in db.read("notes").collect()}

    counts, state = run(spark.createDataFrame([], ingest.STATE))
    assert counts == [("NEW", "COMPLETED", None, 2)] and {f for f, _ in texts()} == {"a.txt", "b.md"}
    first = texts()
    assert len(first) > 7 and db.search("notes", [1.0, 0.0, 0.0], search_type="hybrid", query_text="gamma", limit=3, answer_fields=["text"]).count() == 3
    assert search.sparse(db.read("notes"), "gamma").first()["text"] == "# One\nbeta\n# Two\ngamma"
    (home / "a.txt").write_text("short")
    (home / "b.md").unlink()
    (home / "c.txt").write_text("delta")
    counts, state = run(state)
    assert sorted(counts, key=str) == [("DELETED", "COMPLETED", None, 1), ("MODIFIED", "COMPLETED", None, 1), ("NEW", "COMPLETED", None, 1)]
    assert texts() == {("a.txt", 0): "short", ("c.txt", 0): "delta"}
    (home / "c.txt").write_text("poison")
    counts, state = run(state)
    assert counts == [("MODIFIED", "FAILED", "a chunk has no vector", 1)] and texts()["c.txt", 0] == "delta"
    (home / "c.txt").write_text("better")
    counts, state = run(state)
    assert counts == [("MODIFIED", "COMPLETED", None, 1)] and texts() == {("a.txt", 0): "short", ("c.txt", 0): "better"}
    assert run(state)[0] == [] and state.count() == 2


def test_collections_write_changes(spark, tmp_path, monkeypatch):
    from gleaner.sources import collection as C

    monkeypatch.setattr(C, "CHANGES", 3)
    monkeypatch.setattr(C, "UNNAMED", -10)
    db = Collections(spark, str(tmp_path / "db"))
    db.create("c", 3)
    db.upsert("c", points(spark))
    meta = db._meta("c")
    assert len(meta["changes"]) == 1
    early = db.read("c")
    # Of two writers that saw the same entry one has to begin again.
    assert db._add("c", meta) and not db._add("c", meta)
    db.delete("c", ["1", "none"])
    assert {r["id"] for r in db.read("c").collect()} == {"2", "3"} and early.count() == 3
    db.upsert("c", points(spark).where("id = '1'").withColumn("text", F.lit("again")))  # the third change makes a base
    assert db._meta("c")["changes"] == [] and {r["id"]: r["text"] for r in db.read("c").collect()}["1"] == "again"
    for n in range(9):
        db.upsert("c", points(spark).where("id = '2'").withColumn("text", F.lit(f"t{n} t{n}")))
    assert db.read("c").count() == 3 and search.sparse(db.read("c"), "t8").collect()[0]["score"] == 2.0
    folders = [p.name for p in (tmp_path / "db" / "c").iterdir() if p.name != "log"]
    assert len(folders) <= 3 + C.KEPT
    twice = spark.createDataFrame([("x y", "7", 0), ("z", "7", 1)], "text string, id string, n int").coalesce(1)
    db.store(twice, registry.embedders.create("hashed", 3), "c")
    assert {r["id"]: r["text"] for r in db.read("c").collect()}["7"] == "z"


def test_sparse_search_of_stored_vectors(spark):
    p = points(spark)
    vectors = search.sparse_vectors(p).select("id", F.struct("indices", "values").alias("sparse"))
    for text in ("pasta pasta", "quantum pasta physics", "nothing here", ""):
        stored, fresh = (search.sparse(x, text).select("id", "score").collect() for x in (p.join(vectors, "id"), p))
        assert stored == fresh


def test_threshold(spark):
    p = points(spark)
    assert [r["id"] for r in search.search(p, [1.0, 0.0, 0.0], threshold=0.5).collect()] == ["1", "3"]
    assert [r["id"] for r in search.search(p, [1.0, 0.0, 0.0], metric="l2", threshold=0.2).collect()] == ["1", "3"]


def test_knn_over_tiles(spark):
    import random

    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(90)] + [(200, [0.0] * 4), (201, None)]
    df = spark.createDataFrame(rows, "id long, dense array<double>")
    queries = df.where("id % 7 = 0").select(F.col("id").alias("query_id"), F.col("dense").alias("query"))
    for metric in ("cosine", "dot", "euclid"):
        want = {}
        for q in queries.where("query IS NOT NULL").collect():
            for rank, r in enumerate(search.dense(df, q["query"], 4, metric).collect(), 1):
                want[q["query_id"], rank] = (r["id"], r["score"])
        got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in search.knn_batch(df, queries, 4, metric, most_queries=5, most_points=20).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_numbers_follow_the_order(spark):
    for n in (0, 1, 5, 3000):
        rows = spark.createDataFrame([(f"f{(i * 7919) % max(n, 1):05d}",) for i in range(n)], "filepath string")
        got = sorted((r["filepath"], r["id"]) for r in ingest.numbered(rows, "filepath", 8).collect())
        assert got == [(f"f{i:05d}", i + 1) for i in range(n)]


def test_tool_calls_over_a_stream(spark, tmp_path):
    rows = [("a", 1, "tool_start", "x"), ("a", 2, "tool_start", "x"), ("a", 3, "tool_start", "y"), ("a", 4, "tool_complete", "x"), ("b", 1, "tool_start", "x"), ("b", 2, "tool_error", "x"), ("a", 5, "tool_start", "x"), ("a", 6, "done", None)]
    events = spark.createDataFrame([(s, n, e, t, None) for s, n, e, t in rows], "session_id string, seq long, event string, tool string, text string")
    events.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).json(str(tmp_path / "in"))
    q = E.tool_stream(stream).writeStream.format("memory").queryName("tools").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("tools").collect()), key=str) == sorted(map(tuple, E.tool_calls(events).collect()), key=str)


def test_a_new_request_replaces_the_run_under_way(spark):
    rows = [("a", 1, "r1", "token"), ("a", 2, "r1", "token"), ("a", 3, "r2", "token"), ("a", 4, "r1", "done"), ("b", 1, "r9", "done")]
    df = spark.createDataFrame(rows, "session_id string, seq long, run_id string, event string")
    assert sorted((r["session_id"], r["seq"]) for r in E.latest_run(df).collect()) == [("a", 3), ("b", 1)]


def test_too_many_files(spark):
    rows = [("a", i, "text/plain", 10) for i in range(6)] + [("b", 0, "text/plain", 10), ("b", 1, "image/bmp", 10)]
    df = spark.createDataFrame(rows, "message_id string, seq int, mime string, size long")
    got = {(r["message_id"], r["seq"]): r["problem"] for r in sessions.upload_verdicts(df).collect()}
    assert all(got["a", i] == "too many files" for i in range(6)) and got["b", 0] is None and got["b", 1] == "unsupported type"
