"""Operator 12, cross-tokenizer alignment by id-striped dense count matrices.

Both tokenizers cut the same bytes. Where tokens of both end, a group ends; between two neighbouring ends
of either kind lies one link, since just one token of each side covers these bytes and no other stretch
has the same two. So a chunk of texts is aligned by flags on its bytes and running sums over them.

Links are dealt by the id of side B into ``STRIPES`` stripes, frequent ids far apart. Within a stripe ids
are the rows of dense blocks of ``BLOCK`` rows by all ids of side A: pairs, summed per chunk and again
per task before they move, are added to a block with ``np.add.at``, whose row maxima are the best counts
(``pair_counts``). The scoring is co-partitioned with the links: a part of a stripe receives the stripe's
counts, then its links, which stream by and are scored; a stripe that holds many links has parts in
proportion to their bytes, so that a frequent id is no hot task. Links travel as arrays (a row per chunk
and stripe), and each document gets one row a stripe back.

No count or link passes the driver; it learns how many bytes of links each stripe holds.

Defined results: texts that are null or empty, or whose tokens on either side do not spell a space and the
text, have no tokens (zeros, and '' for the groups); strings of special tokens are plain text; very long
texts are aligned whole; repeated rows, and rows without an id, are documents of their own, and count as
often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, stage, trim
from .packing import _Tokenizer
from .shingles import row_chunks, text_buffers

#: Stripes; rows of a dense block; bits of an id of side A in a pair, and of a document's place in a chunk.
STRIPES, BLOCK, SHIFT, PLACES = 32, 125, 18, 16
#: Bytes of text of a chunk; pairs that a task holds before it hands them on; parts of stripes for each partition.
BYTES, PAIRS, PARTS = 1 << 22, 1 << 22, 4
#: Sorts links after the counts of their stripe.
AFTER = 1 << 30


def byte_letters() -> dict[str, int]:
    """What byte-level vocabularies write for each byte: itself if it shows, else the next letter from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class SideA:
    """A byte-level tokenizer: ids and the bytes of each."""

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        self.encode = _Tokenizer(path, ranks_path, pattern)
        self.encode.exact.encode_special_tokens = True
        letters = byte_letters()
        named = {i: token for token, i in self.encode.exact.get_vocab(with_added_tokens=True).items()}
        self.bytes = [bytes(letters[c] for c in named.get(i, "")) for i in range(max(named) + 1)]


class SideB:
    """A piece tokenizer that adds the space before a text by itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.encode = lambda text: model.encode(text, num_threads=1)
        self.bytes = [
            bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))
        ]


class Aligner:
    """Links and groups of chunks of texts."""

    def __init__(self, a: SideA, b: SideB):
        self.a, self.b = a, b
        self.sizes = [np.array([len(t) for t in side.bytes], np.int64) for side in (a, b)]
        #: Ids as they are written before each separator: of side A "," and "|", of side B "," and ";".
        self.width = max(len(a.bytes), len(b.bytes))
        self.written = [f"{i}{mark}" for mark in ",|;" for i in range(self.width)]

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        if text:
            spelt = b" " + text.encode()
            a, b = self.a.encode(" " + text), self.b.encode(text)
            if b"".join(map(self.b.bytes.__getitem__, b)) == spelt and b"".join(map(self.a.bytes.__getitem__, a)) == spelt:
                return a, b
        return [], []

    def align(self, texts: list[str | None]):
        """``(n_a, n_b, n_groups, n_links)`` and the written groups of each text, and of all links document, A id and B id."""
        ids, counts = (array("i"), array("i")), np.zeros((2, len(texts)), np.int64)
        for row, text in enumerate(texts):
            for side, found in enumerate(self.tokens(text)):
                ids[side].extend(found)
                counts[side, row] = len(found)
        a, b = (np.frombuffer(side, np.int32) if side else np.zeros(0, np.int32) for side in ids)
        ends_a, ends_b = (np.cumsum(size[side]) for size, side in zip(self.sizes, (a, b), strict=True))
        flags = np.zeros(int(ends_a[-1]) + 1 if len(a) else 1, np.uint8)
        flags[ends_a] = 1
        flags[ends_b] += 2
        flags = flags[np.flatnonzero(flags)]
        is_a, is_b, both = (flags & 1).astype(np.int64), (flags >> 1).astype(np.int64), flags == 3
        upto_a, upto_b = np.cumsum(is_a), np.cumsum(is_b)
        at_a, at_b = upto_a - is_a, upto_b - is_b
        doc = np.repeat(np.arange(len(texts)), counts[0])[at_a]
        # Groups: first all A ids of a group, then its B ids.
        group = np.cumsum(both) - both
        ended_a, ended_b = np.flatnonzero(is_a), np.flatnonzero(is_b)
        before_b = np.append(0, upto_b[both])
        order = np.zeros(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + before_b[group[ended_a]]] = a + self.width * both[ended_a]
        order[np.arange(len(b)) + upto_a[both][group[ended_b]]] = b + self.width * 2 * both[ended_b]
        written, stops = [], np.cumsum(counts.sum(axis=0)).tolist()
        for start, stop in zip([0, *stops], stops, strict=False):
            written.append("".join(map(self.written.__getitem__, order[start:stop].tolist()))[:-1])
        numbers = (counts[0], counts[1], np.bincount(doc[both], minlength=len(texts)), np.bincount(doc, minlength=len(texts)))
        return numbers, written, doc, a[at_a].astype(np.int64), b[at_b].astype(np.int64)


def link_arrays(doc: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Per stripe ``stripe, pairs, sums, runs, docs, times``: its distinct pairs in order, how many links each has
    and in how many documents, and for each of those the document's place and its links of the pair."""
    keys = np.sort((b % STRIPES << SHIFT + 14 | b // STRIPES << SHIFT | a) << PLACES | doc)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    times = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    pairs = keys >> PLACES
    begins = np.flatnonzero(np.diff(pairs, prepend=-1))
    sums, runs = np.add.reduceat(times, begins) if len(begins) else times, np.diff(np.append(begins, len(pairs)))
    stripes = pairs[begins] >> SHIFT + 14
    edges = np.searchsorted(stripes, np.arange(STRIPES + 1))
    begins = np.append(begins, len(pairs))
    for stripe in range(STRIPES):
        i, j = edges[stripe], edges[stripe + 1]
        if i < j:
            u, v = begins[i], begins[j]
            own = pairs[begins[i:j]] & (1 << SHIFT + 14) - 1
            yield stripe, own.astype("<u4"), sums[i:j].astype("<u4"), runs[i:j].astype("<u4"), (keys[u:v] & (1 << PLACES) - 1).astype("<u2"), times[u:v].astype("<u4")


ALIGNED = (
    "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "stripe int, pairs binary, sums binary, runs binary, docs binary, times binary"
)
_ALIGNED = pa.schema(
    [("key", pa.int64()), ("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()), ("stripe", pa.int32())]
    + [(n, pa.binary()) for n in ("pairs", "sums", "runs", "docs", "times")]
)


def align_texts(docs: DataFrame, a_files: tuple[str, str | None, str | None], b_file: str, digest: bool = False) -> DataFrame:
    """Rows of documents (``key, doc_id``, counts, ``groups``) and of links (``stripe`` not null, arrays; ``key``: of their chunk's first).

    docs: ``doc_id, text``. Where ``digest``, groups are given by their SHA-256. The keys are those of one
    run of the tasks: stage the rows before they are read more than once.
    """

    def align(batches):
        aligner = Aligner(SideA(*a_files), SideB(b_file))
        key = TaskContext.get().partitionId() << 33
        sha = (lambda text: hashlib.sha256(text.encode()).hexdigest() if text else "") if digest else (lambda text: text)
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for begin, end in row_chunks(offsets, BYTES):
                for i in range(begin, end, 1 << PLACES):
                    j = min(end, i + (1 << PLACES))
                    numbers, written, doc, a, b = aligner.align(batch.column(1).slice(i, j - i).to_pylist())
                    columns = [pa.array(np.arange(key, key + j - i)), batch.column(0).slice(i, j - i), *map(pa.array, numbers), pa.array(list(map(sha, written)), pa.string())]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(j - i, f.type) for f in list(_ALIGNED)[7:])], schema=_ALIGNED)
                    rows = [{"key": key, "stripe": s} | {n: x.tobytes() for n, x in zip(_ALIGNED.names[8:], arrays, strict=True)} for s, *arrays in link_arrays(doc, a, b)]
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ALIGNED)
                    key += j - i
        trim()

    return docs.mapInArrow(align, ALIGNED)


def _summed(pairs: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pairs, sums = np.concatenate(pairs), np.concatenate(sums)
    order = np.argsort(pairs, kind="stable")
    pairs = pairs[order]
    first = np.flatnonzero(np.diff(pairs.astype(np.int64), prepend=-1))
    return pairs[first], np.add.reduceat(sums[order], first)


def pair_counts(links: DataFrame, a_size: int) -> DataFrame:
    """``stripe, block, pairs, counts, best`` of all pairs that occur: counts, and whether they are their B id's highest."""
    schema = "stripe int, block int, pairs binary, sums binary"

    def combine(batches):
        held, n = defaultdict(lambda: ([], [])), 0

        def rows():
            for stripe, (pairs, sums) in held.items():
                pairs, sums = _summed(pairs, sums)
                block = (pairs >> SHIFT) // BLOCK
                cuts = np.flatnonzero(np.diff(block.astype(np.int64), prepend=-1)).tolist()
                for i, j in zip(cuts, [*cuts[1:], len(pairs)], strict=True):
                    yield {"stripe": stripe, "block": int(block[i]), "pairs": pairs[i:j].tobytes(), "sums": sums[i:j].tobytes()}

        kinds = pa.schema([("stripe", pa.int32()), ("block", pa.int32()), ("pairs", pa.binary()), ("sums", pa.binary())])
        for batch in batches:
            for stripe, pairs, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                some = held[stripe]
                some[0].append(np.frombuffer(pairs, "<u4"))
                some[1].append(np.frombuffer(sums, "<u4").astype("<i8"))
                n += len(some[0][-1])
                if n > PAIRS:
                    for key, (p, s) in list(held.items()):
                        p, s = _summed(p, s)
                        held[key] = ([p], [s])
                    n = sum(len(p[0]) for p, _ in held.values())
                    if n > PAIRS // 2:
                        yield pa.RecordBatch.from_pylist(list(rows()), schema=kinds)
                        held.clear()
                        n = 0
        if held:
            yield pa.RecordBatch.from_pylist(list(rows()), schema=kinds)
        trim()

    def count(batches):
        dense, now = np.zeros(BLOCK * a_size, np.int64), None
        kinds = pa.schema([("stripe", pa.int32()), ("block", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary()), ("best", pa.binary())])

        def told():
            at = np.flatnonzero(dense)
            row, found = at // a_size, dense[at]
            highest = dense.reshape(BLOCK, a_size).max(axis=1)
            pairs = (row + now[1] * BLOCK << SHIFT | at % a_size).astype("<u4")
            row = {"stripe": now[0], "block": now[1], "pairs": pairs.tobytes(), "counts": found.astype("<i8").tobytes(), "best": (found == highest[row]).tobytes()}
            dense[at] = 0
            return pa.RecordBatch.from_pylist([row], schema=kinds)

        for batch in batches:
            for stripe, block, pairs, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and now != (stripe, block):
                    yield told()
                now = (stripe, block)
                pairs = np.frombuffer(pairs, "<u4").astype(np.int64)
                np.add.at(dense, ((pairs >> SHIFT) - block * BLOCK) * a_size + (pairs & (1 << SHIFT) - 1), np.frombuffer(sums, "<i8"))
        if now is not None:
            yield told()
        trim()

    dealt = links.select("stripe", "pairs", "sums").mapInArrow(combine, schema).repartition(partitions(links.sparkSession), "stripe", "block")
    return dealt.sortWithinPartitions("stripe", "block").mapInArrow(count, "stripe int, block int, pairs binary, counts binary, best binary")


def score_links(links: DataFrame, counts: DataFrame) -> DataFrame:
    """``key, n_best, count_sum``: several rows a document, one for each stripe of a chunk in which it has links."""
    n = partitions(links.sparkSession)
    held = {r["stripe"]: r["bytes"] for r in links.groupBy("stripe").agg(F.sum(F.octet_length("docs")).alias("bytes")).collect()}  # STRIPES rows at most
    total = sum(held.values()) or 1
    parts = F.element_at(F.array(*(F.lit(-(-held.get(s, 0) * PARTS * n // total) or 1) for s in range(STRIPES))), F.col("stripe") + 1)
    none = F.lit(None).cast("binary")
    tables = counts.select(
        "stripe", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("block").alias("place"), F.lit(None).cast("long").alias("key"),
        "pairs", F.col("counts").alias("x"), F.col("best").alias("y"), none.alias("z"),
    )
    asking = links.select(
        "stripe", F.pmod(F.xxhash64("key"), parts).cast("int").alias("part"), F.lit(AFTER).alias("place"), "key", "pairs", F.col("runs").alias("x"), F.col("docs").alias("y"), F.col("times").alias("z")
    )

    def score(batches):
        now, tables = None, []
        for batch in batches:
            for stripe, part, place, key, pairs, x, y, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (stripe, part):
                    now, tables, known = (stripe, part), [], None
                pairs = np.frombuffer(pairs, "<u4")
                if place != AFTER:
                    tables.append((pairs, np.frombuffer(x, "<i8"), np.frombuffer(y, np.bool_)))
                    continue
                if known is None:
                    known, tables = [np.concatenate(c) for c in zip(*tables, strict=True)], []
                at = np.repeat(np.searchsorted(known[0], pairs), np.frombuffer(x, "<u4"))
                docs, times = np.frombuffer(y, "<u2"), np.frombuffer(z, "<u4").astype(np.int64)
                best, sums = np.zeros((2, int(docs.max()) + 1), np.int64)
                np.add.at(best, docs, times * known[2][at])
                np.add.at(sums, docs, times * known[1][at])
                there = np.unique(docs)
                yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int64) + key), pa.array(best[there]), pa.array(sums[there])], ["key", "n_best", "count_sum"])
        trim()

    together = tables.unionByName(asking).repartition(n, "stripe", "part").sortWithinPartitions("stripe", "part", "place")
    return together.mapInArrow(score, "key long, n_best long, count_sum long")


def align(docs: DataFrame, a_files: tuple[str, str | None, str | None], b_file: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``.

    a_files: a byte-level tokenizers file, and optionally its ranks and split pattern; b_file: a piece model.
    """
    from tokenizers import Tokenizer

    a_size = max(Tokenizer.from_file(a_files[0]).get_vocab(with_added_tokens=True).values()) + 1
    aligned = stage(align_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), a_files, b_file, digest), "aligned")
    links = aligned.where("stripe IS NOT NULL")
    scores = score_links(links, stage(pair_counts(links, a_size), "pair-counts"))
    numbers = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    nothing: Column = F.lit(0).cast("long")
    rows = aligned.where("stripe IS NULL").select("key", *numbers, nothing.alias("n_best"), nothing.alias("count_sum")).unionByName(scores, allowMissingColumns=True)
    return rows.groupBy("key").agg(
        *(F.max(c).alias(c) for c in numbers[:5]), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.max("groups").alias("groups")
    ).drop("key")
