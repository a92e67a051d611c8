"""Mixing, exact dedup, URL filters and the n-gram join on small tables made to be awkward."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from gleaner.llm import exact_dedup, mixing, ngram_join, url_filter


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], "doc_id long, text string, source string, norm string, key string, size int").repartition(3)


def test_exact_dedup(spark):
    rows = [(1, "a b"), (2, "ab"), (3, None), (4, ""), (5, " \t\x0b"), (6, "a\u00a0b"), (7, "a  b"), (8, "x" * 100_000), (9, "x" * 100_000 + " ")]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup_exact(docs(spark, [(*r, "s") for r in rows])).collect()}
    assert got == {1: (7, 3, False), 2: (7, 3, False), 7: (7, 3, True), 3: (5, 3, False), 4: (5, 3, False), 5: (5, 3, True), 6: (6, 1, True), 8: (9, 2, False), 9: (9, 2, True)}
    same = exact_dedup.dedup_exact(docs(spark, [(1, "a", "s")] * 5)).collect()
    assert sum(r["kept"] for r in same) == 1 and {r["group_size"] for r in same} == {5}
    assert exact_dedup.dedup_exact(docs(spark, [])).collect() == []


def test_hot_text_is_dealt_over_tasks(spark):
    rows = [(i, "same text", "s") for i in range(3000)] + [(5000 + i, f"other {i}", "s") for i in range(300)]
    got = exact_dedup.dedup_exact(docs(spark, rows)).collect()
    assert {r["group_size"] for r in got if r["doc_id"] < 5000} == {3000} and sum(r["kept"] for r in got) == 301
    runs = exact_dedup.sorted_runs(docs(spark, rows)).collect()
    assert max(r["copies"] for r in runs) < 100 and {r["salt"] for r in runs if r["doc_id"] >= 5000} == {0}
    assert sum(r["kept"] and r["doc_id"] == 0 for r in got) == 1


def test_copies_meet_as_neighbours(spark):
    """The sort finds every pair; texts that differ only after their first words stay apart."""
    rows = [(i, f"{'a long common beginning ' * 9}{i // 2}{' ' * (i % 2)}", "s") for i in range(2000)]
    runs = exact_dedup.sorted_runs(docs(spark, rows)).collect()
    assert {r["copies"] for r in runs} == {2} and {r["salt"] for r in runs} == {0}
    assert all((r["place"] == 1) == (r["doc_id"] % 2 == 1) and r["first_id"] == r["doc_id"] | 1 for r in runs)


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 400))), f"s{i % 5}" if i % 3 else "s0") for i in range(400)]
    rows += [(1000, None, "s1"), (1001, "", None), (1002, "one two\x0bthree\u00a0four", None), (1003, "w " * 200_000, "s3")]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs(spark, rows)).collect()))
    text = {i: t for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    taken, target = {}, {}
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]] or "")) and 0 <= r["taken"] <= 2 * r["size"]
        s = source[r["doc_id"]]
        taken[s], target[s] = taken.get(s, 0) + r["taken"], (r["target"], r["source_size"])
    total = sum(r["size"] for r in got)
    assert abs(sum(t for t, _ in target.values()) - 1.5 * total) < 1e-6 * total
    for s, (t, size) in target.items():
        assert t <= 2 * size + 1e-6 and abs(taken[s] - t) <= max(0.01 * t, 3 * mixing.BLOCK)
    assert mixing.mix(docs(spark, [])).collect() == []
    assert [r["taken"] for r in mixing.mix(docs(spark, [(1, None, None)])).collect()] == [0]


def test_schedule_is_low_discrepancy(spark):
    sizes = spark.createDataFrame([("a", "a", 40_000), ("b", "b", 100_000), ("c", "c", 1_000_000)], "key string, source string, source_size long")
    slots = mixing.schedule(mixing.source_targets(sizes)).orderBy("slot").collect()
    share = {r["key"]: 0 for r in slots}
    want = {r["key"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    total = sum(want.values())
    for n, r in enumerate(slots, 1):
        share[r["key"]] += 1
        if n % 500 == 0:
            assert all(abs(share[k] - n * want[k] / total) < 12 for k in share)


def test_urls(spark):
    rows = [
        (1, None), (2, "no scheme"), (3, "http://"), (4, "http://WWW.Example.ORG/en/123?x#y"), (5, "x://y://z/p"), (6, "https://a.com/fr/1"), (7, "https://com/de/"), (8, "https://notcom/de/"),
        (9, "https://example.org"), (10, "https://a.example.org/es/x"), (11, "http://b.com/de/1"), (11, "http://b.com/de/1"), (12, "http://b.com/zz"), (13, "ftp://É.com/\n/x"),
    ]
    rows += [(100 + i, "http://bad.com/de/q") for i in range(60)] + [(200, "http://bad.com/other"), (201, "http://bad.com#z")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, host string")
    got = {r["page_id"]: tuple(r)[1:5] for r in url_filter.filter_urls(df).collect()}
    assert got[1] == got[2] == ("", "", None, "allow") and got[3][:2] == ("", "")
    assert got[4] == ("www.example.org", "/en/123", "example.org/en/1", "block")
    assert got[5][:2] == ("y:", "//z/p") and got[6][2:] == ("com/fr/", "allow") and got[7][2:] == ("com/de/", "block")
    assert got[8][2] is None and got[9][2] is None and got[10][2:] == ("example.org/es/", "block")
    assert got[200] == ("bad.com", "/other", None, "block") and got[201][:2] == ("bad.com", "") and got[13][1] == "/\n/x"
    assert url_filter.filter_urls(df.limit(0)).collect() == []


def components(texts, k=3, percent=90):
    lower = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for i, t in texts}
    sets = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set() for i, w in lower.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_ngram_join(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(150)]
    texts, n = [], 0
    for size in (5, 12, 40, 41, 120, 300, 2500):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append((n, " ".join(w)))
            n += 1
    texts += [(n + i, t) for i, t in enumerate([None, "", " \t", "One", "one", "one two", "ONE  two", "one two three", "É x y", "é x y", texts[0][1].upper(), "a a a a a a"])]
    df = docs(spark, [(*t, "s") for t in texts])
    for k, percent in ((3, 90), (5, 80), (1, 60)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df, k, percent).collect()}
        assert got == components(texts, k, percent)


def test_ngram_join_merges_what_leaders_leave_open(spark, monkeypatch):
    """Without leaders every pair goes through the heap."""
    rng = random.Random(4)
    words, texts = [f"w{i}" for i in range(90)], []
    for n in range(60):
        base = [rng.choice(words) for _ in range(120)] if n % 4 == 0 else base
        texts.append((n, " ".join(rng.choice(words) if rng.random() < 0.015 else w for w in base)))
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs(spark, [(*t, "s") for t in texts]), 2, 80).collect()}
    assert got == components(texts, 2, 80) and len({c for _, c in got.values()}) < 60


def test_ngram_join_of_rows_that_share_an_id(spark):
    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    rows = [(7, a, "s"), (7, b, "s"), (3, f"{b} c", "s"), (None, a, "s"), (9, "", "s"), (9, None, "s")]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs(spark, rows)).collect())
    assert got == [(0, 58, 7), (3, 59, 3), (7, 58, 3), (7, 58, 7), (9, 0, 9), (9, 0, 9)]


def test_ngram_join_of_nothing(spark):
    assert ngram_join.jaccard_components(docs(spark, [])).collect() == []
    same = ngram_join.jaccard_components(docs(spark, [(4, "a b c d", "s")] * 3)).collect()
    assert [tuple(r) for r in same] == [(4, 2, 4)] * 3


def test_mixing_keeps_rows_without_id(spark):
    got = mixing.mix(docs(spark, [(None, "w " * 640, "s"), (None, None, "s"), (1, "w " * 640, "s")])).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == [(0, 0), (0, 640), (1, 640)]
    assert sum(r["taken"] for r in got) == 1920 and {r["source_size"] for r in got} == {1280}


def test_points_of_far_slots(spark):
    """Beyond 2**63 / GOLDEN slots, and beyond 2**32 of them, points are what whole numbers give."""
    slots = [0, 1, 65_535, 65_536, 3_474_701_533, 3_474_701_534, 4_200_000_000, 2**32 - 1, 2**32 + 5, 5_000_000_000, 2**45 + 12_345]
    got = spark.createDataFrame([(s,) for s in slots], "slot long").select("slot", mixing.point_of(F.col("slot")).alias("p")).collect()
    assert [(r["slot"], r["p"]) for r in got] == [(s, s * mixing.GOLDEN % 2**32) for s in slots]


def test_offsets_over_groups_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 4)
    rows = [(k, i, (i * 7 + k) % 5) for k in range(2) for i in range(100) if i % 3]
    got = {(r["key"], r["place"]): r["before"] for r in mixing._before(spark.createDataFrame(rows, "key long, place long, c long"), "place", "c").collect()}
    assert got == {(k, i): sum(c for q, j, c in rows if q == k and j < i) for k, i, _ in rows}


def test_probability_above_a_bound(spark):
    """The continued fraction against sums of the density."""
    pairs = [(0.3, 4.0), (1.0, 1.0), (2.5, 0.7), (30.0, 20.0), (600.0, 400.0), (5.0, 995.0), (400.0, 380.0), (0.98, 0.02)]
    for bound in (0.5, 0.3):
        got = {(r["a"], r["b"]): r["above"] for r in url_filter.beta_above(spark.createDataFrame(pairs, "a double, b double"), bound).collect()}
        for a, b in pairs:
            # Substituting x = t**8 / (t**8 + (1 - t)**8) tames the ends of the density.
            t = (np.arange(400_000) + 0.5) / 400_000
            low, high = t**8, (1 - t) ** 8
            x = low / (low + high)
            log = a * np.log(x) + b * np.log(high / (low + high)) + np.log(8) - np.log(t) - np.log(1 - t)
            w = np.exp(log - log.max())
            assert abs(got[a, b] - w[x > bound].sum() / w.sum()) < 2e-3, (a, b)


def test_registered_domains(spark):
    hosts = {
        "a.b.example.co.uk": ("example.co.uk", "co.uk"), "www.example.org": ("example.org", "org"), "user@shop.example.com:8080": ("example.com", "com"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"),
        "[::1]:80": ("[::1]", "[::1]"), "localhost": ("localhost", "localhost"), "x.github.io.": ("x.github.io", "github.io"), "co.uk": ("co.uk", "co.uk"),
    }
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r[0]: (r[1], r[2]) for r in df.select("host", *url_filter.domain_of(F.col("host"))).collect()} == hosts


def test_reputation_decides_as_in_sql(spark):
    """A host that rules mostly block is blocked, and so is an unseen one of a bad domain; others are not."""
    rng = random.Random(5)
    urls = [f"http://h{i % 4}.bad.com/de/{i}" for i in range(400)] + [f"http://h{i % 9}.good{i % 7}.com/fr/{i}" for i in range(700)] + [f"http://h{i % 3}.mixed.com/{rng.choice(['de', 'fr'])}/{i}" for i in range(60)]
    urls += ["http://h1.bad.com/x", "http://new.bad.com/x", "http://good1.com/x", "http://h0.mixed.com/x", "http://u:p@h2.bad.com:8080/q", "http://10.1.2.3/x", "http://a.b.co.uk/x", "http://[::1]/x", "none", None]
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("pages", pd.DataFrame({"page_id": range(len(urls)), "url": pd.Series(urls, dtype=object)}))
    want = con.execute(f"SELECT page_id, host, path, rule, verdict, score FROM ({url_filter.SQL}) ORDER BY page_id").fetchall()
    got = [tuple(r) for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all((g[5] is None) == (w[5] is None) and abs((g[5] or 0) - (w[5] or 0)) < 2e-6 for g, w in zip(got, want, strict=True))
    verdict = dict(zip(urls, (g[4] for g in got), strict=True))
    assert [verdict[u] for u in urls[-10:]] == ["block", "block", "allow", "allow", "block", "allow", "allow", "allow", "allow", "allow"]
