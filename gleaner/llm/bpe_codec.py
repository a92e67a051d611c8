"""Operator 11, byte-level BPE encoding and decoding by a hierarchical-bitmap rank queue.

A text is split by the pattern of its vocabulary and every match is merged on its own. The parts of a
match form a linked list over its bytes; each neighbouring pair that is a token waits in the bucket of
its merge rank. A bitmap of 64-bit words, whose words are themselves bits of a smaller bitmap above,
finds the lowest rank that has a bucket by a find-first-set a level. The leftmost position of that
bucket is merged, its two new pairs are queued, and entries that a merge has made stale are skipped
when they come up. So a match of n bytes takes n log n steps at most, however long it is. Matches that
are new to a task go through one queue together, side by side in one linked list; as matches recur, the
ids of short ones are remembered, in tables of bounded size.

The split pattern's letters and digits are those of the library that defines the ids: code points that
the pattern library here takes for letters or digits, and that one does not (they are newer than its
tables), are found once on the driver and split as the symbols which they are there.

Work is a map over whole texts without a shuffle, in batches of bounded size.

Defined results: null and empty texts have no ids and decode to no bytes; very long texts are split
piece by piece; repeated rows, and rows without an id, are encoded each; an empty table gives an empty
result; other columns are ignored. Null ids decode to no bytes; an id that the vocabulary lacks raises.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from array import array
from heapq import heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim
from .shingles import row_chunks, text_buffers

#: Bytes of texts encoded at once; code points up to which a text is split in one go; matches merged at once.
BYTES, AT_ONCE, MATCHES = 1 << 23, 1 << 20, 1 << 18
#: Positions of a bucket from which on they are merged at once.
MANY = 40
#: Rows decoded at once.
ROWS = 1000
#: Matches that a task remembers (twice as many for a while), and the longest of them in code points.
REMEMBERED, SHORT = 200_000, 48
#: A code point that is no letter, digit or white space in any version of Unicode.
SYMBOL = ""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ranks, of a file with a token in base64 and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def newer_letters() -> str:
    """What the pattern library calls letters or digits and the defining one does not, as a text of these code points."""
    import regex
    import tiktoken

    plain = {bytes([i]): i for i in range(256)}
    letter = tiktoken.Encoding("letters", pat_str=r"[\p{L}\p{N}]", mergeable_ranks=plain, special_tokens={})
    unassigned = "".join(c for c in map(chr, chain(range(0xD800), range(0xE000, 0x110000))) if unicodedata.category(c) == "Cn")
    return "".join(c for c in regex.findall(r"[\p{L}\p{N}]", unassigned) if not letter.encode_ordinary(c))


class RankQueue:
    """Buckets of positions by rank; the lowest rank comes first, and in it the lowest position."""

    def __init__(self, ranks: int):
        self.levels: list[list[int]] = []
        while not self.levels or len(self.levels[-1]) > 1:
            ranks = -(-ranks // 64)
            self.levels.append([0] * ranks)
        #: Heaps of positions, and the sorted positions that a rank was loaded with, until it is its turn.
        self.buckets: dict[int, list[int]] = {}
        self.loaded: dict[int, np.ndarray] = {}

    def load(self, ranks: np.ndarray) -> None:
        """Queue every position whose rank is not negative."""
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        firsts = np.flatnonzero(np.diff(ranks[order], prepend=-1))
        for rank, positions in zip(ranks[order[firsts]].tolist(), np.split(order, firsts[1:]), strict=False):
            self.loaded[rank] = positions
            self._mark(rank)

    def _mark(self, rank: int) -> None:
        for level in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            held = level[word]
            level[word] = held | bit
            if held:
                break
            rank = word

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
        else:
            self.buckets[rank] = [position]
            if rank not in self.loaded:
                self._mark(rank)

    def first(self) -> tuple[int, list[int]] | None:
        """The lowest rank, and its bucket, a heap that is not empty."""
        if not self.levels[-1][0]:
            return None
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = rank << 6 | ((word & -word).bit_length() - 1)
        positions = self.loaded.pop(rank, None)
        if positions is not None:
            self.buckets[rank] = sorted(positions.tolist() + self.buckets.get(rank, []))
        return rank, self.buckets[rank]

    def extend(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Queue many positions, each with its rank."""
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order].tolist()
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
        for rank, i, j in zip(ranks[cuts].tolist(), cuts, [*cuts, len(positions)][1:], strict=True):
            for position in positions[i:j]:
                self.push(rank, position)

    def emptied(self, rank: int) -> None:
        """The bucket of this rank is used up."""
        del self.buckets[rank]
        for level in self.levels:
            level[rank >> 6] &= ~(1 << (rank & 63))
            if level[rank >> 6]:
                break
            rank >>= 6


class Codec:
    """Encoder of a vocabulary."""

    def __init__(self, ranks_path: str, pattern: str, newer: str = ""):
        import regex

        self.ranks = read_ranks(ranks_path)
        self.longest = max(map(len, self.ranks))
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.of_one = np.array([self.ranks[bytes([byte])] for byte in range(256)], np.int32)
        self.of_two = np.array([self.ranks.get(bytes(pair), -1) for pair in np.ndindex(256, 256)], np.int32)
        pairs = {(self.ranks[a], self.ranks[b]): rank for token, rank in self.ranks.items() for i in range(1, len(token)) if (a := token[:i]) in self.ranks and (b := token[i:]) in self.ranks}
        codes = np.array([a << 32 | b for a, b in pairs] or [-1], np.int64)
        order = np.argsort(codes)
        #: Pairs of tokens that form a token, in order, and its rank.
        self.pairs, self.pair_ranks = codes[order], np.array(list(pairs.values()) or [-1], np.int32)[order]
        self.split, self.newer = regex.compile(pattern), frozenset(newer)
        self.symbols = dict.fromkeys(map(ord, newer), SYMBOL)
        #: Ids of matches, as the bytes of 32-bit numbers: those of late, and those that were remembered when these began.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of what pairs of tokens form; -1 where that is no token."""
        codes = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        return np.where(self.pairs[at] == codes, self.pair_ranks[at], np.int32(-1))

    def merge(self, pieces: list[bytes], short: bool = False) -> list[bytes]:
        """Ids of matches, as bytes, merged side by side in one list of parts, which no merge joins across matches.

        In each match always the pair of lowest rank, and of such the leftmost, is merged next. Where all
        matches are ``short``, a bucket of many positions is merged at once, one position a match.
        """
        if not pieces:
            return []
        ranks, longest, queue, data = self.ranks, self.longest, self.queue, b"".join(pieces)
        n, codes = len(data), np.frombuffer(data, np.uint8).astype(np.int32)
        ends = np.cumsum([len(p) for p in pieces])
        #: Per part the rank of the token that it forms with the next one; -1: none, or no longer a part.
        initial = np.append(self.of_two[codes[:-1] << 8 | codes[1:]], np.int32(-1))
        initial[ends - 1] = -1
        queue.load(initial)
        rank_at, token, following, before = (array("i", x.astype(np.int32).tobytes()) for x in (initial, self.of_one[codes], np.arange(1, n + 1), np.arange(-1, n)))
        buckets, push, of_pair = queue.buckets, queue.push, ranks.get
        begins = bytearray(n + 1)
        np.frombuffer(begins, np.uint8)[np.append(0, ends)] = 1
        if short:
            ranked, tokens, nexts, befores = (np.frombuffer(x, np.int32) for x in (rank_at, token, following, before))
            starts, match = np.frombuffer(begins, np.uint8), np.repeat(np.arange(len(pieces)), np.diff(ends, prepend=0))
        while found := queue.first():
            rank, bucket = found
            if short and len(bucket) >= MANY:
                at = np.sort(np.array(bucket))
                at = at[ranked[at] == rank]
                first = np.diff(match[at], prepend=-1) > 0
                bucket[:] = at[~first].tolist()
                at = at[first]
                gone = nexts[at]
                after = nexts[gone]
                nexts[at], befores[after], ranked[gone], tokens[at], tokens[gone] = after, at, -1, rank, -1
                more, inner = starts[after] == 0, starts[at] == 0
                ranked[at] = -1
                ranked[at[more]] = self.of_pairs(tokens[at[more]], tokens[after[more]])
                left = befores[at[inner]]
                ranked[left] = self.of_pairs(tokens[left], tokens[at[inner]])
                parts = np.concatenate([at, left])
                new = ranked[parts]
                if not bucket:
                    queue.emptied(rank)
                queue.extend(new[new >= 0], parts[new >= 0])
                continue
            while bucket:
                i = heappop(bucket)
                if rank_at[i] != rank:
                    continue
                gone = following[i]
                following[i] = after = following[gone]
                before[after] = i
                token[i] = rank
                token[gone] = -1
                rank_at[gone] = -1
                lowest = rank
                end = following[after] if not begins[after] else n + longest
                for part in (i,) if begins[i] else (i, before[i]):
                    if part != i:
                        end = after
                    new = of_pair(data[part:end], -1) if end - part <= longest else -1
                    rank_at[part] = new
                    if new >= 0:
                        waiting = buckets.get(new)
                        if waiting is None:
                            push(new, part)
                        else:
                            heappush(waiting, part)
                        if new < lowest:
                            lowest = new
                if lowest < rank:
                    break
            if not bucket:
                queue.emptied(rank)
        kept = (tokens := np.frombuffer(token, np.int32)) >= 0
        upto = (np.append(0, np.cumsum(kept))[np.append(0, ends)] * 4).tolist()
        ids = tokens[kept].tobytes()
        return [ids[i:j] for i, j in zip(upto, upto[1:], strict=False)]

    def learn(self, pieces: list[str]) -> None:
        """Have the ids of all these matches in ``known``."""
        if len(self.known) > REMEMBERED:
            self.before = {piece: ids for piece, ids in self.known.items() if len(piece) <= SHORT}
            self.known = {}
        new = []
        for piece in set(pieces).difference(self.known):
            ids = self.before.get(piece)
            if ids is None:
                whole = self.ranks.get(piece.encode())
                if whole is None:
                    new.append(piece)
                    continue
                ids = whole.to_bytes(4, sys.byteorder)
            self.known[piece] = ids
        for short in (True, False):
            some = [piece for piece in new if (len(piece) <= SHORT) == short]
            self.known.update(zip(some, self.merge([piece.encode() for piece in some], short), strict=True))

    def matches(self, text: str):
        """Lists of the pattern's matches, in order."""
        if not text.isascii() and not self.newer.isdisjoint(text):
            spans = (m.span() for m in self.split.finditer(text.translate(self.symbols)))
            while some := [text[a:b] for a, b in islice(spans, MATCHES)]:
                yield some
        elif len(text) <= AT_ONCE:
            yield self.split.findall(text)
        else:
            found = self.split.finditer(text)
            while some := [m.group() for m in islice(found, MATCHES)]:
                yield some

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as the bytes of 32-bit numbers."""
        out, pieces, counts = [[] for _ in texts], [], []

        def flush() -> None:
            self.learn(pieces)
            ids, at = self.known.__getitem__, 0
            for row, count in counts:
                out[row].append(b"".join(map(ids, pieces[at : at + count])))
                at += count
            pieces.clear(), counts.clear()

        for row, text in enumerate(texts):
            for some in self.matches(text):
                pieces.extend(some)
                counts.append((row, len(some)))
                if len(pieces) >= MATCHES:
                    flush()
        flush()
        return [b"".join(parts) for parts in out]


def encode_texts(docs: DataFrame, tokenizer: tuple[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every text. tokenizer: a file of ranks and the split pattern."""
    files = (*tokenizer, newer_letters())

    def encode(batches):
        codec = Codec(*files)
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for i, j in row_chunks(offsets, BYTES):
                ids = codec.encode([text or "" for text in batch.column(1).slice(i, j - i).to_pylist()])
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["doc_id", "ids"])
        trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with ``decoded``, the bytes of their ids one after another."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in encoded.schema.fields)}, decoded binary"

    def decode(batches):
        ranks = read_ranks(ranks_path)
        data = np.frombuffer(b"".join(ranks), np.uint8)
        sizes, begins = np.zeros((2, max(ranks.values()) + 1), np.int64)
        order = list(ranks.values())
        sizes[order] = [len(token) for token in ranks]
        begins[order] = np.append(0, np.cumsum(sizes[order])[:-1])
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(sizes) or not sizes[ids].all()):
                raise KeyError(f"ids that the vocabulary of {ranks_path} lacks")
            upto = np.append(0, np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)))
            for i in range(0, len(lists), ROWS):
                some = ids[upto[i] : upto[min(i + ROWS, len(lists))]]
                size = sizes[some]
                ends = np.cumsum(size)
                decoded = data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[some] - ends + size, size)]
                marks = np.append(0, ends)[upto[i : i + ROWS + 1] - upto[i]]
                column = pa.Array.from_buffers(pa.large_binary(), len(marks) - 1, [None, pa.py_buffer(marks.astype(np.int64)), pa.py_buffer(decoded)])
                yield batch.slice(i, ROWS).append_column("decoded", column.cast(pa.binary()))
        trim()

    return encoded.mapInArrow(decode, schema)


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded and decoded rows."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
