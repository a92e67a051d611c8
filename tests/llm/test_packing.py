import zlib

import numpy as np
import pytest

from gleaner.llm import packing as P
from gleaner.llm.queries import tokenizer_files


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_files()[0])
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_bins_are_valid_and_tight():
    rng = np.random.default_rng(2)
    for sizes in (rng.integers(1, 2048, 3000), np.clip(rng.lognormal(6, 1, 3000), 1, 2047).astype(int), np.array([2000]), np.full(100, 700), np.zeros(0, int)):
        bins, offsets = P.pack_lengths(sizes, 2048)
        for b in np.unique(bins):
            inside = np.flatnonzero(bins == b)
            order = inside[np.argsort(offsets[inside])]
            assert (np.cumsum(sizes[order]) - sizes[order] == offsets[order]).all() and sizes[order].sum() <= 2048
        if len(sizes) > 1000:
            assert len(np.unique(bins)) <= 1.02 * np.ceil(sizes.sum() / 2048) + (sizes > 1024).sum() * (sizes.mean() > 1000)


def test_two_replace_one():
    # Greedy gives 6 + 3 (gap 1); 2 + 2 in place of 3 fills the bin.
    sizes = np.array([6, 3, 2, 2])
    bins, _ = P.pack_lengths(sizes, 10)
    assert sizes[bins == bins[0]].sum() == 10


def plain_pack(sizes, capacity):
    """Best two fit over a plain sorted list: the lengths of each bin."""
    left, bins = sorted(map(int, sizes)), []
    while left:
        held = []
        while fit := [s for s in left if s <= capacity - sum(held)]:
            held.append(fit[-1])
            left.remove(fit[-1])
        room = capacity - sum(held) + held[-1]
        if room > held[-1] and len(held) > 1 and left:
            pairs = [(a + b, -a) for i, a in enumerate(left) for b in left[i + 1 :] if a + b <= room]
            if pairs and max(pairs)[0] > held[-1]:
                total, one = max(pairs)[0], -max(pairs)[1]
                for s in (one, total - one):
                    left.remove(s)
                left = sorted([*left, held.pop()])
                held += [one, total - one]
        bins.append(sorted(held))
    return bins


def test_bins_against_a_plain_version():
    rng = np.random.default_rng(6)
    for capacity, n in ((10, 12), (50, 60), (100, 90)):
        for _ in range(25):
            sizes = rng.integers(1, capacity + 1, n)
            bins, _ = P.pack_lengths(sizes, capacity)
            got = [sorted(sizes[bins == b].tolist()) for b in range(bins.max() + 1)]
            want = plain_pack(sizes, capacity)
            assert [sum(b) for b in got] == [sum(b) for b in want] and sorted(got) == sorted(want)


def test_fast_ids_of_random_strings(encode):
    rng = np.random.default_rng(7)
    fast = P._Tokenizer(*tokenizer_files())
    letters = [*map(chr, range(32, 127)), *"\t\n\r", *map(chr, range(0xA1, 0x250)), *"‐–—‘’“”…‧€"]
    pieces = [*letters, " ", "  ", "\n\n", "'s", "'LL", "n't", "12345", "...", "the", " and", "ß", "É", "<", "|", ">", "<|endoftext|>", "日", "\u2003", "\x0b", "\x85", "\u0301", "\xad"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces, rng.integers(1, 40)))
        assert fast(text) == encode(text), repr(text)


def test_pieces_against_the_tokenizer(spark, encode):
    long = "word and more words " * 3000
    texts = [None, "", "hello", long, "héllo <|endoftext|> wörld", "日本語 текст \u2003x", "hello", "a" * 5000, "\U0001f600 tail"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, piece string").repartition(2)
    rows = P.pack(df, tokenizer_files()).collect()
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*encode(t), 0], "<u4")
        pieces = by_doc[i]
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        assert sum(p["length"] for p in pieces) == len(ids) and all(p["length"] == 2048 for p in pieces[1:])
        for p in pieces:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert P.pack(df.limit(0), tokenizer_files()).collect() == []


def test_fast_ids_equal_the_definition(encode, sf_dir):
    import pyarrow.parquet as pq

    fast = P._Tokenizer(*tokenizer_files())
    for text in pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()[:200]:
        assert fast(text) == encode(text)
    for text in ("it's  \n\n x\t\ty ", "don’t – “quoted” …", "Ǆ ɏ €5 ½ ²", "\x0b\x85 \xa0 "):
        assert fast(text) == encode(text)


def test_near_the_lower_bound(spark, sf_dir):
    rows = P.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_files()).select("sequence_id", "length").collect()
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= 1.01 * total / 2048 + 1
