"""Operator 3, best-fit packing of documents into sequences (best two fit).

Texts become ids once, in a map over whole texts; a document longer than a sequence is cut into
full sequences with the shorter piece first. Only lengths are packed: pieces are dealt by a hash of
a number that is written with each into groups of about ``GROUP`` pieces (so each group has the whole mix of lengths and fits one
task), full pieces are sequences of their own, and each group is packed on its own. A bin is
filled greedily with the largest piece that fits; then its smallest piece gives way to two
unpacked pieces that fit the widened gap more tightly, if such two exist.

Defined results: null or empty text is one separator id; repeated rows are documents of their own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

LENGTH, GROUP, SEPARATOR = 2048, 8192, 0
#: Texts within these code points are split alike by both libraries; any other text goes to the
#: slower one, whose ids are the definition.
_PLAIN = re.compile("[\t\n\r -~\xa1-ɏ‐-‧€]*")


class _Tokenizer:
    """Ids of the vocabulary in a tokenizers file, by the faster library where they are the same."""

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.exact, self.fast = Tokenizer.from_file(path), None
        if ranks_path and pattern:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and _PLAIN.fullmatch(text) and "<|" not in text:
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


def pieces_of(docs: DataFrame, tokenizer: tuple[str, str | None, str | None], length: int = LENGTH) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32``. tokenizer: files and split pattern."""

    def cut(batches):
        encode = _Tokenizer(*tokenizer)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), SEPARATOR], "<u4")
                at, piece, size = 0, 0, len(ids) % length or length
                while at < len(ids):
                    for column, value in zip(out, (doc_id, piece, at, size, zlib.crc32(ids[at : at + size].tobytes())), strict=True):
                        column.append(value)
                    at, piece, size = at + size, piece + 1, length
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_lengths(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size (1 to capacity), by best two fit."""
    order = np.argsort(sizes, kind="stable")
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in order[::-1].tolist():
        stacks[int(sizes[i])].append(i)
    have = np.array([len(s) for s in stacks])
    there = np.flatnonzero(have)  # sizes still unpacked, ascending
    bins, offsets, number = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0

    def take(size: int) -> None:
        nonlocal there
        have[size] -= 1
        if not have[size]:
            there = np.delete(there, np.searchsorted(there, size))

    while len(there):
        held: list[int] = []
        gap = capacity
        while gap and len(there) and (k := int(np.searchsorted(there, gap, "right"))):
            size = int(there[k - 1])
            held.append(size)
            gap -= size
            take(size)
        if gap and len(held) > 1 and len(there):
            smallest = held[-1]
            room = gap + smallest
            low = there[: np.searchsorted(there, room - 1, "right")]
            if len(low):
                other = np.searchsorted(low, room - low, "right") - 1  # the largest that fits beside each
                fits = other >= 0
                pair = np.where(fits, low + low[np.maximum(other, 0)], 0)
                single = fits & (low[np.maximum(other, 0)] == low) & (have[low] < 2)
                again = np.maximum(other - 1, 0)
                pair = np.where(single, np.where(other > 0, low + low[again], 0), pair)
                best = int(np.argmax(pair))
                if pair[best] > smallest:
                    one, two = int(low[best]), int(pair[best] - low[best])
                    have[smallest] += 1
                    if have[smallest] == 1:
                        there = np.insert(there, np.searchsorted(there, smallest), smallest)
                    take(one), take(two)
                    held[-1:] = [one, two]
        at = 0
        for size in held:
            i = stacks[size].pop()
            bins[i], offsets[i] = number, at
            at += size
        number += 1
    return bins, offsets


def pack(docs: DataFrame, tokenizer: tuple[str, str | None, str | None], length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    cut = pieces_of(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), tokenizer, length)
    pieces = stage(cut.withColumn("number", F.monotonically_increasing_id()), "pieces")
    full = F.col("length") == length
    groups = max(1, -(-pieces.where(~full).count() // GROUP))

    def pack_group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("number", "ascending")])
        bins, offsets = pack_lengths(table["length"].to_numpy(), length)
        group = table["group"][0].as_py()
        rest = table.drop_columns(["number", "group"])
        return rest.append_column("sequence_id", pa.array(2 * (bins * groups + group), pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    mixed = (
        pieces.where(~full).withColumn("group", F.pmod(F.xxhash64("number"), F.lit(groups)))
        .groupBy("group").applyInArrow(pack_group, schema)
    )
    alone = pieces.where(full).drop("number").withColumns({"sequence_id": F.monotonically_increasing_id() * 2 + 1, "offset": F.lit(0).cast("long")})
    return mixed.unionByName(alone)
