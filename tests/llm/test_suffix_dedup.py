import collections
import hashlib
import random

import numpy as np
import pytest

from gleaner.llm import suffix_dedup as S


def brute(texts):
    """Kept bytes by looking at every window of every text."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + S.LENGTH] for b in data for i in range(len(b) - S.LENGTH + 1))
    out = []
    for b in data:
        spans = S.merged_spans([(i, i + S.LENGTH) for i in range(len(b) - S.LENGTH + 1) if seen[b[i : i + S.LENGTH]] > 1])
        kept = b"".join(b[s:e] for s, e in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(b)], strict=True))
        out.append((len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts, parts=3):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, start string").repartition(parts)
    rows = S.remove_repeats(df).orderBy("doc_id").collect()
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows]


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdéß") for _ in range(rng.randint(1, 8))) for _ in range(400)]

    def prose(k):
        return " ".join(rng.choice(words) for _ in range(k))

    shared = [prose(rng.randint(30, 120)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [prose(rng.randint(5, 80))]
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(shared)
            cut = rng.randint(0, len(passage) // 2)
            parts += [passage[cut : cut + rng.randint(100, len(passage))], prose(rng.randint(0, 12))]
        texts.append(" ".join(parts))
    return [*texts, texts[0], None, "", "short", "a" * 700, "ab" * 500, prose(90), shared[0], shared[0] + "!"]


@pytest.mark.parametrize("hot", [50_000, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    for seed in (1, 2):
        texts = corpus(seed)
        assert run(spark, texts) == brute(texts)


def pasted(seed, n):
    """A passage between surroundings that share some bytes beside it, in ``n`` texts."""
    rng = random.Random(seed)

    def letters(k):
        return "".join(rng.choice("abcdefgh ") for _ in range(k))

    passage, before, after = letters(450), letters(40), letters(40)
    return [letters(160) + before[rng.randint(0, 40) :] + passage + after[: rng.randint(0, 40)] + letters(160) for _ in range(n)]


@pytest.mark.parametrize("run_bytes", [48 << 20, 5000])
def test_passages_pasted_everywhere(spark, monkeypatch, run_bytes):
    monkeypatch.setattr(S, "HOT", 5)
    monkeypatch.setattr(S, "RUN_BYTES", run_bytes)
    texts = pasted(8, 80)
    assert run(spark, texts) == brute(texts)


def test_groups_of_hot_cores_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 10)
    core = 200
    rows = [(i, core, t[160:][:core][::-1][: S.REACH].encode(), t[160:][core : core + S.LENGTH].encode()) for i, t in enumerate(pasted(9, 120))]
    hot = spark.createDataFrame(rows, "row long, at long, left binary, right binary")
    groups = collections.defaultdict(set)
    for level in S._deal(hot):
        for r in level.where("NOT halve").collect():
            a, b = S.OFFSETS[r["node"]]
            assert len(r["left"]) <= b and len(r["right"]) <= S.LENGTH - a
            groups[r["node"], bytes(r["left"][:a]), bytes(r["right"][: S.LENGTH - b])].add((bytes(r["left"]), bytes(r["right"])))
    assert groups and all(len(found) <= 10 or S.OFFSETS[key[0]][1] - S.OFFSETS[key[0]][0] <= 1 for key, found in groups.items())


def test_nodes_hold_every_window_offset_once():
    halves = [v for n, v in S.OFFSETS.items() if 2 * n not in S.OFFSETS]
    assert sorted(o for a, b in halves for o in range(a, b + 1)) == list(range(S.REACH + 1))
    assert max(S.OFFSETS) < 256 and all(b - a <= 1 for a, b in halves)


def test_small_pairwise_limit(spark, monkeypatch):
    monkeypatch.setattr(S, "PAIRWISE", 1)
    texts = corpus(3)
    assert run(spark, texts) == brute(texts)


def test_flushing_many_runs(spark, monkeypatch):
    monkeypatch.setattr(S, "RUN_BYTES", 4000)
    texts = corpus(4)
    assert run(spark, texts, 1) == brute(texts)


def test_empty_and_repeated_rows(spark):
    assert run(spark, []) == []
    text = corpus(5)[0] * 3
    df = spark.createDataFrame([(7, text), (7, text), (7, "other")], "doc_id long, text string")
    rows = sorted((r["n_bytes"], r["n_removed"]) for r in S.remove_repeats(df).collect())
    assert rows == [(5, 0), (len(text.encode()), len(text.encode())), (len(text.encode()), len(text.encode()))]


def test_loser_tree_merges_with_prefixes():
    rng = random.Random(1)
    runs = [sorted((bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9))), b"l", r, 2**33 + i) for i in range(rng.randint(0, 40))) for r in range(7)]
    merged = list(S.merge_runs([S.read_run(S.code_run(r)) for r in runs]))
    keys = [m[1] for m in merged]
    assert keys == sorted(e[0] for r in runs for e in r)
    assert sorted(m[-1] for m in merged) == sorted(e[3] for r in runs for e in r)
    assert [m[0] for m in merged] == [S.common(a, b) for a, b in zip([b"", *keys], keys, strict=False)]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(0)
    window = rng.integers(0, 255, S.LENGTH, dtype=np.uint8)
    places = []
    for before in (3, 777):
        data = np.concatenate([rng.integers(0, 255, before, dtype=np.uint8), window, rng.integers(0, 255, 400, dtype=np.uint8)])
        at = S.anchors_of(data, np.array([0, len(data)]))
        places.append({int(a) - before for a in at if 0 <= a - before <= S.REACH})
    assert places[0] & places[1]


def test_anchors_of_a_long_text_are_read_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.integers(97, 100, 9000, dtype=np.uint8), np.full(3000, 97, np.uint8), rng.integers(0, 255, 5000, dtype=np.uint8)])
    whole = S.anchors_of(data, np.array([0, len(data)]))
    for size in (50, 1000, 4096):
        monkeypatch.setattr(S, "SLICE", size)
        assert S.anchors_of(data, np.array([0, len(data)])).tolist() == whole.tolist()
    monkeypatch.setattr(S, "SLICE", 700)
    texts = [*corpus(6, 20), " ".join(t or "" for t in corpus(6, 20))]
    assert run(spark, texts) == brute(texts)


def test_rows_without_id_or_of_one_id(spark):
    text = corpus(5)[1] * 2
    rows = [(None, text), (3, f"other {text}"), (None, "z" * 150), (8, "zz"), (8, text[:400])]
    got = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.remove_repeats(got).collect())
    assert got == sorted(brute([t for _, t in rows])) and sum(r[1] > 0 for r in got) == 3


def test_parts_follow_the_bytes_of_repeats(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_BYTES", 1 << 12)
    texts = corpus(7)
    assert run(spark, texts) == brute(texts)
