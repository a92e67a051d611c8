"""Operator 11 against the library that defines the ids, and round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from gleaner.llm import bpe_codec

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
FILES = (RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_codec.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe_codec.Codec(*FILES, bpe_codec.newer_letters())


def numbers(ids: bytes) -> list[int]:
    return np.frombuffer(ids, np.int32).tolist()


def test_rank_queue_pops_lowest_rank_then_position():
    rng = random.Random(3)
    queue = bpe_codec.RankQueue(70_000)
    loaded = np.array([rng.randrange(-1, 70_000) for _ in range(300)], np.int32)
    queue.load(loaded)
    want = [(int(r), i) for i, r in enumerate(loaded) if r >= 0]
    for i in range(300, 600):
        rank = rng.choice([rng.randrange(70_000), int(abs(loaded[i - 300]))])
        queue.push(rank, i)
        want.append((rank, i))
    got = []
    while found := queue.first():
        rank, bucket = found
        got.append((rank, bpe_codec.heappop(bucket)))
        if not bucket:
            queue.emptied(rank)
    assert got == sorted(want)


def test_ids_equal_the_library_on_random_texts(codec, library):
    rng = random.Random(1)
    bits = ["a", "b", " ", "\n", "the", "0x", "aaaaaa", "12", "'s", "<|endoftext|>", "՘", "࢏", "中文", "\U0001f600"]
    texts = [
        "".join(rng.choice([*bits, chr(rng.choice([rng.randrange(32, 0x2000), rng.randrange(0xE000, 0x110000)]))]) for _ in range(rng.randrange(40)))
        for _ in range(3000)
    ]
    assert [numbers(ids) for ids in codec.encode(texts)] == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("text", ["a" * 60_000, "ab" * 30_000, "=" * 7 + "-" * 50_000, " " * 20_000 + "x", "acgt" * 9_000 + "tgca" * 9_000])
def test_very_long_matches(codec, library, text):
    assert numbers(codec.encode([text])[0]) == library.encode_ordinary(text)


def test_texts_beyond_one_split_are_whole(codec, library, monkeypatch):
    monkeypatch.setattr(bpe_codec, "AT_ONCE", 10)
    monkeypatch.setattr(bpe_codec, "MATCHES", 3)
    text = "It's a test of\n\nlong texts, 123 of them՘. " * 7
    assert numbers(codec.encode([text, "", text])[2]) == library.encode_ordinary(text)


def test_memory_of_matches_is_bounded_and_changes_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(bpe_codec, "REMEMBERED", 5)
    texts = [f"word{i} wor{i % 7}ds again" for i in range(200)]
    assert [numbers(codec.encode([t])[0]) for t in texts] == [library.encode_ordinary(t) for t in texts]
    assert len(codec.known) < 20


def test_query_form(spark, library):
    rows = [(1, "one two", "x", 1), (2, None, "y", 2), (3, "", "z", 3), (None, "one two", "x", 4), (3, "zürich ՘ " * 50, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    encoded = bpe_codec.encode_texts(docs, FILES)
    got = bpe_codec.digests(bpe_codec.decode_ids(encoded, RANKS)).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe_codec.encode_texts(docs.limit(0), FILES).count() == 0


def test_null_ids_decode_to_nothing_and_unknown_ids_raise(spark):
    ids = spark.createDataFrame([(1, None), (2, [464, 3290])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: bytes(r["decoded"]) for r in bpe_codec.decode_ids(ids, RANKS).collect()} == {1: b"", 2: b"The dog"}
    for odd in (99_999, -1, 50_256):
        with pytest.raises(Exception, match="KeyError"):
            bpe_codec.decode_ids(spark.createDataFrame([(1, [odd])], "doc_id long, ids array<int>"), RANKS).collect()


def test_whole_documents(spark, library, sf_dir):
    from gleaner.llm import queries

    got = {r["doc_id"]: r for r in queries.op11_bpe_codec(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for doc in docs:
        ids = library.encode_ordinary(doc["text"] or "")
        assert got[doc["doc_id"]]["n_tokens"] == len(ids)
        assert got[doc["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[doc["doc_id"]]["decoded_sha256"] == hashlib.sha256((doc["text"] or "").encode()).hexdigest()
