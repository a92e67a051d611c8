"""Operator 1, suffix-array dedup: a distributed, common-prefix-aware merge sort of suffixes.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else is removed.

Sparse suffix array. In every window of ``LENGTH`` bytes the position with the smallest hash of
its next 8 bytes, among those that leave ``CORE`` bytes inside the window, is an anchor. Equal
windows have equal anchors at equal offsets, so a repeat is found by sorting the suffixes at
anchors only (about one position in 76), each with the bytes before it. Per anchor it is enough to
know how far left and right of it some other anchor agrees, left and right together ``LENGTH``.

Distinguishing prefixes first (prefix doubling): anchors whose core of ``CORE`` bytes occurs once
cannot repeat and are not exchanged. The hash of the core only decides that; what agrees is
decided on bytes.

Merge sort. A task sorts the suffixes of its documents into a run, keeps one of each group of
equal suffixes (their members are repeats already), front-codes the run (common prefix length and
tail) and cuts it at splitters sampled from the repeated cores, into as many parts as keep each at
about ``PART_BYTES``. The parts are combined by a loser tree over the runs, whose
contenders carry their common prefix with the last output: it never compares known prefixes, and
yields the common prefixes of the merged order. Within a group that shares a core, the windows'
right parts are read off these, the left parts off hashes of the bytes before.

No key is a hot task: a run sends each distinct suffix once, so copies do not pile up, and equal
suffixes of several runs are answered as they meet. A core of very many surroundings (a passage
pasted everywhere) is dealt out by the offsets of the windows around it: those of offsets a to b
agree in a bytes before the core and ``LENGTH`` - b from its start on, and their suffixes are cut to
what such windows hold. Wherever more than ``HOT`` distinct suffixes agree in that, the offsets are
halved (see ``OFFSETS``), down to two, whose suffixes differ in one byte at either end. So no group
holds many more than 2**16 distinct suffixes.

Defined results: null text is empty; texts shorter than ``LENGTH`` bytes keep everything; rows
that share an id, or have none, are documents of their own, and copies of each other if their
texts are equal; an empty table gives an empty result; other columns are ignored. Texts of any
length are read ``SLICE`` bytes at a time for their anchors, which are those of the whole text.
"""

from __future__ import annotations

import functools
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keyed, partitions, stage, trim
from .shingles import mix64, row_chunks, text_buffers

LENGTH, CORE = 200, 50
REACH = LENGTH - CORE  # bytes before an anchor that a window can hold
#: Anchors of one core, then distinct suffixes of one node, beyond which window offsets are halved.
HOT = 50_000
#: Bytes of suffixes in a run at most, and about those of a part; splitter samples collected at most.
RUN_BYTES, PART_BYTES, SAMPLES = 48 << 20, 48 << 20, 20_000
#: Entries of one core up to which pairs are looked at one by one.
PAIRWISE = 64
#: Bytes of texts whose anchors are found together: what stays in a core's cache.
CHUNK = 1 << 18
#: Bytes of one text whose anchors are found together.
SLICE = 1 << 20


def _halves(node: int, first: int, last: int) -> dict[int, tuple[int, int]]:
    out = {node: (first, last)}
    if last - first > 1:
        middle = (first + last) // 2
        out |= _halves(2 * node, first, middle) | _halves(2 * node + 1, middle + 1, last)
    return out


#: The first and last window offset of each node by which hot cores are dealt; node n is halved into
#: 2n and 2n + 1, down to two offsets. All fit a byte; node 0 is for cores that are not hot.
OFFSETS = _halves(1, 0, REACH)
_POSITION = (1 << 28) - 1


def anchors_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Anchors of all rows' texts, ascending, as places in ``data``."""
    n, w = len(data), LENGTH - CORE + 1
    if n < LENGTH:
        return np.zeros(0, np.int64)
    if n > SLICE + LENGTH and len(offsets) == 2:
        parts = [data[s : s + SLICE + LENGTH - 1] for s in range(0, n - LENGTH + 1, SLICE)]
        return np.unique(np.concatenate([i * SLICE + anchors_of(p, np.array([0, len(p)])) for i, p in enumerate(parts)]))
    grams = np.ndarray((n - 7,), "<u8", data.tobytes(), strides=(1,))
    key = np.full(-(-n // w) * w + w, 2**64 - 1, np.uint64)
    hashed = grams * np.uint64(0x9E3779B97F4A7C15)  # the high bits, which order, depend on all 8 bytes
    hashed &= ~np.uint64(_POSITION)
    hashed |= np.arange(n - 7, dtype=np.uint64)
    key[: n - 7] = hashed
    table = key.reshape(-1, w)
    upto = np.minimum.accumulate(table, axis=1).ravel()
    onward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(onward[:n], upto[w - 1 : n + w - 1])
    begins, ends = offsets[:-1], offsets[1:]
    long = ends - begins >= LENGTH
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, begins[long], 1)
    np.add.at(edge, ends[long] - LENGTH + 1, -1)
    at = (least[np.cumsum(edge[:n]) > 0] & np.uint64(_POSITION)).astype(np.int64)
    return at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at


def core_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    cores = np.zeros((len(at), -(-CORE // 8) * 8), np.uint8)
    if len(at):
        cores[:, :CORE] = np.lib.stride_tricks.sliding_window_view(data, CORE)[at]
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for column in cores.view("<u8").T:
            h = mix64((h + column) * np.uint64(0x9E3779B97F4A7C15))
    return h


def _read_anchors(docs: DataFrame) -> DataFrame:
    """Per row ``row, at, core`` (places of its anchors and hashes of their cores), and some cores as samples."""

    def read(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in row_chunks(offsets, CHUNK):
                part = offsets[i : j + 1]
                rows = part - part[0]
                chunk = data[part[0] : part[-1]]
                at = anchors_of(chunk, rows)
                cuts = np.searchsorted(at, rows).astype(np.int32)
                places = at - np.repeat(rows[:-1], np.diff(cuts))
                cores = core_hashes(chunk, at).view(np.int64)
                samples = [{"core": int(cores[k]), "bytes": chunk[at[k] : at[k] + CORE].tobytes()} for k in range(int(part[0]) % 256, len(at), 256)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(cuts), pa.array(places)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(cores)),
                     pa.array([samples if r == 0 else [] for r in range(j - i)], pa.list_(pa.struct([("core", pa.int64()), ("bytes", pa.binary())])))],
                    ["row", "at", "core", "samples"],
                )
        trim()

    return docs.mapInArrow(read, "row long, at array<long>, core array<long>, samples array<struct<core:long,bytes:binary>>")


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no comparison."""
    n = min(len(a), len(b))
    a, b = a[known:n], b[known:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


def code_run(run: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """A sorted run of (key, left, row, at), front-coded and compressed."""
    shared, before = [], b""
    for key, *_ in run:
        shared.append(common(before, key))
        before = key
    head = np.array([len(run)], "<i8").tobytes()
    columns = [np.array(shared, np.uint8), np.array([len(r[0]) for r in run], np.uint8), np.array([len(r[1]) for r in run], np.uint8)]
    columns += [np.array([r[2] for r in run], "<i8"), np.array([r[3] for r in run], "<i8")]
    raw = head + b"".join(c.tobytes() for c in columns) + b"".join(r[0][s:] for r, s in zip(run, shared, strict=True)) + b"".join(r[1] for r in run)
    return np.array([len(raw)], "<i8").tobytes() + pa.compress(raw, "zstd", asbytes=True)


def read_run(blob: bytes) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    """(prefix shared with the one before, key, left, row, at) of a coded run, in order."""
    raw = pa.decompress(blob[8:], int(np.frombuffer(blob, "<i8", 1)[0]), "zstd", asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    at, columns = 8, []
    for kind in ("u1", "u1", "u1", "<i8", "<i8"):
        columns.append(np.frombuffer(raw, kind, n, at).tolist())
        at += n * np.dtype(kind).itemsize
    left_at = at + sum(columns[1]) - sum(columns[0])
    key = b""
    for shared, size, left, row, place in zip(*columns, strict=True):
        key = key[:shared] + raw[at : at + size - shared]
        at += size - shared
        yield shared, key, raw[left_at : left_at + left], row, place
        left_at += left


def merge_runs(runs: list[Iterator]) -> Iterator[tuple]:
    """All entries of sorted runs in order, each with its common prefix with the one before.

    A loser tree: a contender is (common prefix with the last output, entry, run). Of two, the one
    that shares more with the last output is smaller; only on a draw are bytes compared, from
    there on, and the loser then shares that much with the winner.
    """
    size = 1
    while size < max(1, len(runs)):
        size *= 2
    losers: list = [None] * size

    def play(a, b):
        """Winner and loser."""
        if a is None or b is None:
            return (b, a) if a is None else (a, b)
        if a[0] != b[0]:
            return (a, b) if a[0] > b[0] else (b, a)
        x, y = a[1][1], b[1][1]
        n = common(x, y, a[0])
        if x[n:] <= y[n:]:
            return a, (n, b[1], b[2])
        return b, (n, a[1], a[2])

    def start(node):
        if node >= size:
            run = node - size
            entry = next(runs[run], None) if run < len(runs) else None
            return None if entry is None else (0, entry, run)
        win, losers[node] = play(start(2 * node), start(2 * node + 1))
        return win

    winner = start(1)
    while winner is not None:
        yield winner[0], *winner[1][1:]
        run = winner[2]
        entry = next(runs[run], None)
        winner = None if entry is None else (entry[0], entry, run)
        node = (size + run) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def agreement(group: list[tuple]) -> list[tuple[int, int]]:
    """For entries of one core, sorted, how far left and right each agrees with some other one.

    Only agreements of ``LENGTH`` bytes together count; (0, 0) where there is none. An entry is
    (common prefix with the one before, key, left, ...); a key's first byte is its mode.
    """
    m = len(group)
    out = [(0, 0)] * m
    if m <= PAIRWISE:
        for i in range(m - 1):
            right, mine = 1 << 20, group[i][2]
            for j in range(i + 1, m):
                right = min(right, group[j][0])
                need, other = LENGTH + 1 - right, group[j][2]
                if need > 0 and (mine[:need] != other[:need] or len(mine) < need or len(other) < need):
                    continue
                left = common(mine, other)
                for k in (i, j):
                    out[k] = max(out[k][0], left), max(out[k][1], right - 1)
        return out
    prefix = np.array([g[0] - 1 for g in group])
    rights, lefts = np.array([len(g[1]) - 1 for g in group]), np.array([len(g[2]) for g in group])
    padded = np.zeros((m, REACH), np.uint8)
    for i, g in enumerate(group):
        padded[i, : len(g[2])] = np.frombuffer(g[2], np.uint8)
    hashed = np.zeros(m, np.uint64)  # of the o bytes before each
    most_left, most_right = np.zeros(m, np.int64), np.zeros(m, np.int64)
    with np.errstate(over="ignore"):
        for o in range(REACH + 1):
            if o:
                hashed = mix64(hashed * np.uint64(3) + padded[:, o - 1] + np.uint64(1))
            need = LENGTH - o
            able = np.flatnonzero((lefts >= o) & (rights >= need))
            if len(able) < 2:
                continue
            cls = np.cumsum(prefix < need)[able].astype(np.uint64)
            key = mix64(hashed[able] + cls * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            twin = np.zeros(len(able), bool)
            twin[order[1:][same]] = twin[order[:-1][same]] = True
            most_left[able[twin]] = o
            most_right[able[twin]] = np.maximum(most_right[able[twin]], need)
    return list(zip(most_left.tolist(), most_right.tolist(), strict=True))


def _grouped(entries: list[tuple[bytes, bytes, int, int]]):
    """Sorted, one of each (key, left, row, at) that are equal, and the spans of those that are several.

    One that stands for several has place -1: they are repeats already and need no answer.
    """
    entries.sort()
    kept, spans = [], []
    i = 0
    while i < len(entries):
        key, left, row, at = entries[i]
        j = i + 1
        while j < len(entries) and entries[j][0] == key and entries[j][1] == left:
            j += 1
        if j > i + 1:
            spans += [(r, a - len(left), a + len(key) - 1) for _, _, r, a in entries[i:j] if a >= 0]
            at = -1
        kept.append((key, left, row, at))
        i = j
    return kept, spans


def _coded(entries: list[tuple[bytes, bytes, int, int]], part_of) -> pa.RecordBatch:
    """A run of each part, the entries of hot cores as they are, and repeats found at once."""
    kept, spans = _grouped(entries)
    by_part: dict[int, list] = {}
    hot = []
    for entry in kept:
        part = part_of(entry[0], entry[1])
        if part is None:
            hot.append(entry)
        else:
            by_part.setdefault(part, []).append(entry)
    p, h, n = len(by_part), len(hot), len(spans)
    columns = [
        pa.array([*by_part, *[None] * (h + n)], pa.int32()), pa.array([*map(code_run, by_part.values()), *[None] * (h + n)], pa.binary()),
        pa.array([*[None] * p, *[e[2] for e in hot], *[x[0] for x in spans]], pa.int64()),
        pa.array([*[None] * p, *[e[3] for e in hot], *[x[1] for x in spans]], pa.int64()), pa.array([*[None] * (p + h), *[x[2] for x in spans]], pa.int64()),
        pa.array([*[None] * p, *[e[1] for e in hot], *[None] * n], pa.binary()), pa.array([*[None] * p, *[e[0][1:] for e in hot], *[None] * n], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["part", "run", "row", "start", "end", "left", "right"])


_RUNS = "part int, run binary, row long, start long, end long, left binary, right binary"


def _make_runs(splitters: list[bytes]):
    """Texts with their anchors to coded parts of sorted runs, distinct suffixes of hot cores, and repeats found inside a run."""

    def part_of(key, left):
        return None if key[0] else bisect_right(splitters, key[1 : 1 + CORE])

    def make(batches):
        entries, size = [], 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            body = memoryview(data)
            rows, places = batch.column(0).to_pylist(), batch.column(2)
            for r, row in enumerate(rows):
                b, e = int(offsets[r]), int(offsets[r + 1])
                for place in places[r].values.to_numpy().tolist():
                    at, hot = place >> 1, place & 1
                    right = bytes(body[b + at : min(b + at + LENGTH, e)])
                    left = bytes(body[max(b, b + at - REACH) : b + at])[::-1]
                    entries.append(((b"\1" if hot else b"\0") + right, left, row, at))
                    size += len(right) + len(left)
                    if size > RUN_BYTES:
                        yield _coded(entries, part_of)
                        entries, size = [], 0
        if entries:
            yield _coded(entries, part_of)
        del entries
        trim()

    return make


def _make_hot_runs(first: int, parts: int):
    """Suffixes dealt by nodes to runs of the parts from ``first`` on."""

    def part_of(key, left):
        a, b = OFFSETS[key[0]]
        return first + int.from_bytes(hashlib.blake2b(key[: 1 + LENGTH - b] + left[:a], digest_size=8).digest(), "big") % parts

    def make(batches):
        entries, size = [], 0
        for batch in batches:
            for node, right, left, row, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                entries.append((bytes([node]) + right, left, row, at))
                size += len(right) + len(left)
                if size > RUN_BYTES:
                    yield _coded(entries, part_of)
                    entries, size = [], 0
        if entries:
            yield _coded(entries, part_of)
        del entries
        trim()

    return make


def _deal(hot: DataFrame) -> list[DataFrame]:
    """Suffixes of hot cores (``row, at, left, right``) by nodes, each cut to the windows of its node.

    What agrees in a node's common bytes is one group of the merge if it has ``HOT`` distinct
    suffixes at most; else its offsets are halved. Equal windows take the same way, as all that
    decides is common to them. Groups with nothing to be answered are left out.
    """
    first, last = (F.element_at(F.array(*(F.lit(OFFSETS.get(n, (0, 0))[k]) for n in range(1, 256))), F.col("node")) for k in (0, 1))
    whole = [n for n, (a, b) in OFFSETS.items() if b - a <= 1]
    live, dealt = hot.select("row", "at", "left", "right", F.lit(1).alias("node")), []
    while True:
        live = live.select("row", "at", F.explode(F.array(F.col("node") * 2, F.col("node") * 2 + 1)).alias("node"), "left", "right")
        live = live.select("row", "at", "node", F.substring("left", F.lit(1), last).alias("left"), F.substring("right", F.lit(1), LENGTH - first).alias("right"))
        live = live.where((F.length("left") >= first) & (F.length("right") >= LENGTH - last) & (F.length("left") + F.length("right") >= LENGTH))
        head = F.format_string("%d,%d,", F.col("node"), F.length("left")).cast("binary")
        live = live.select(
            "*", F.unhex(F.md5(F.concat(F.col("node").cast("string").cast("binary"), F.substring("left", F.lit(1), first), F.substring("right", F.lit(1), LENGTH - last)))).alias("key"),
            F.unhex(F.md5(F.concat(head, F.col("left"), F.col("right")))).alias("suffix"),
        )
        alike = live.groupBy("key", "node", "suffix").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("most"))
        groups = alike.groupBy("key", "node").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.count(F.lit(1)).alias("distinct"))
        groups = stage(groups.where("n > 1 AND most >= 0").select("key", ((F.col("distinct") > HOT) & ~F.col("node").isin(whole)).alias("halve")), "hot-groups")
        dealt.append(stage(live.join(groups, "key").select("row", "at", "node", "left", "right", "halve"), "dealt"))
        drop(groups)
        live = dealt[-1].where("halve")
        if live.isEmpty():
            return dealt


def _merge_part(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = [read_run(blob.as_py()) for batch in batches for blob in batch.column("run")]
    spans: list[tuple[int, int, int]] = []

    def close(group: list[tuple]) -> None:
        if len(group) > 1:
            for (_, _, _, row, at), (left, right) in zip(group, agreement(group), strict=True):
                if right and at >= 0:
                    spans.append((row, at - left, at + right))

    group: list[tuple] = []
    alike: dict[bytes, int] = {}  # by their lefts, the places in the group of those of one key
    for entry in merge_runs(runs):
        shared, key, left, row, at = entry
        if shared <= CORE:
            close(group)
            group = []
        if not group or shared < len(key) or len(key) != len(group[-1][1]):
            alike = {}
        i = alike.setdefault(left, len(group))
        if i == len(group):
            group.append(entry)
            continue
        # Equal suffixes of several runs are all repeats, and one is enough to compare others with.
        spans += [(r, a - len(left), a + len(key) - 1) for r, a in (group[i][3:], (row, at)) if a >= 0]
        group[i] = (*group[i][:4], -1)
    close(group)
    columns = list(zip(*spans, strict=True)) or [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "start", "end"])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """``row, start, end`` (bytes): spans that repeat; texts: ``row, text``, row being each one's own."""
    spark = texts.sparkSession
    found = stage(_read_anchors(texts.select("row", "text")), "anchors")
    every = found.select("row", F.explode(F.arrays_zip("at", "core")).alias("a")).select("row", "a.at", "a.core")
    # Staged, so that both sides of the join below are plain exchanges and a hot core is split.
    counts = stage(every.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cores")
    hot = F.col("n") > HOT
    entries, any_hot = counts.agg(F.sum(F.when(~hot, F.col("n"))), F.coalesce(F.bool_or(hot), F.lit(False))).first()
    parts = max(2 * partitions(spark), (entries or 0) * (LENGTH + REACH) // PART_BYTES)
    repeated = every.join(counts, "core").groupBy("row").agg(F.collect_list(F.col("at") * 2 + hot.cast("long")).alias("places"))
    runs = stage(texts.join(repeated, "row").select("row", "text", "places").mapInArrow(_make_runs(_splitters(found, counts, parts)), _RUNS), "runs")
    drop(found, counts)
    every_run = runs
    if any_hot:
        dealt = _deal(runs.where("right IS NOT NULL").select("row", F.col("start").alias("at"), "left", "right"))
        of_hot = functools.reduce(DataFrame.unionByName, dealt).where("NOT halve").select("node", "right", "left", "row", "at")
        more = 1 + of_hot.count() * (LENGTH + REACH) // PART_BYTES
        hot_runs = stage(of_hot.mapInArrow(_make_hot_runs(parts, more), _RUNS), "hot-runs")
        drop(*dealt)
        every_run = runs.unionByName(hot_runs)
    merged = every_run.where("run IS NOT NULL").select("part", "run").groupBy("part").applyInArrow(_merge_part, "row long, start long, end long")
    spans = stage(every_run.where("end IS NOT NULL").select("row", "start", "end").unionByName(merged), "spans")
    drop(runs, *([hot_runs] if any_hot else []))
    return spans


def _splitters(found: DataFrame, counts: DataFrame, parts: int) -> list[bytes]:
    """At most parts - 1 cores that cut the suffixes of repeated cores into parts of like size."""
    samples = found.where(F.size("samples") > 0).select(F.explode("samples").alias("s")).select("s.core", "s.bytes")
    samples = samples.join(counts.where(F.col("n") <= HOT), "core", "left_semi")
    share = min(1.0, SAMPLES / max(1, samples.count()))
    few = samples.where(F.pmod(F.xxhash64("bytes"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("bytes").limit(2 * SAMPLES).collect()
    cores = sorted(bytes(r["bytes"]) for r in few)
    return sorted({cores[len(cores) * k // parts] for k in range(1, parts)}) if cores else []


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    rows, key = keyed(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    rows = rows.withColumnRenamed(key, "row")
    spans = repeated_spans(rows.select("row", "text")).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def cut(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            body = memoryview(data)
            out: list[list] = [[], [], [], []]
            for r, spans in enumerate(batch.column(2).to_pylist()):
                text = body[int(offsets[r]) : int(offsets[r + 1])]
                kept, at, removed, n = hashlib.sha256(), 0, 0, 0
                for s, e in merged_spans([(x["start"], x["end"]) for x in spans or []]):
                    kept.update(text[at:s])
                    removed, n, at = removed + e - s, n + 1, e
                kept.update(text[at:])
                for column, value in zip(out, (len(text), removed, n, kept.hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        trim()

    return (
        rows.join(spans, "row", "left").select("doc_id", "text", "spans")
        .mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs that spans cover."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out
