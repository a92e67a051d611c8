"""Operator 10, exact n-gram Jaccard join by T-occurrence search (DivideSkip).

A document is the set of its distinct k-word shingles, the inverted lists are those of the
shingles, and a partner at Jaccard >= t of a document of n shingles must occur on at least
T = ceil(t n) of its n lists. DivideSkip sets the T - 1 longest of them aside: every partner then
shows up on at least one of the n - T + 1 shortest lists, and on c of the n - T + c shortest. Those
are merged by a heap, c growing with n; the long lists are not merged but probed: whether a
candidate is on them is looked up by binary search, in its own sorted set (which holds the same
facts as the lists, so the long lists need not be built at all).

* Which lists are long is read off a sketch (counts of all shingles of all documents, in cells whose
  number grows with the table up to ``MOST_CELLS``). Any total order of the shingles gives exact
  results, so the sketch only decides how short the merged lists are.
* Equal sets are one class from the start; its smallest id stands for it.
* Exact bounds prune pairs: sizes and places on a shared list before the merge, then the number of
  short lists shared, then the bits in which 256-bit parity signatures differ (never more than the
  sets' symmetric difference).
* Groups of thousands of near copies are not expanded: first each document is compared with one
  leader per list (the one that meets most others, as an original does) and components are formed;
  lists whose documents are all in one component are then finished, and only pairs between
  different components go to the heap. So no link between components is lost, and none inside
  one needs to be found.

Defined results: null, empty or wordless text has 0 shingles and is its own component; fewer words
than k are one shingle; rows that share an id, or have none, are documents of their own, whose
component is named by its smallest id; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop, keyed, partitions, stage, trim
from .shingles import mix64, shingle_sets

#: Cells of the sketch: 16 a document, between these powers of two; a slice is added up by one task.
LEAST_CELLS, MOST_CELLS, SLICE = 1 << 16, 1 << 24, 1 << 16
#: Star rounds before the pairs between components.
ROUNDS = 2
#: Shingles of a document for each further short list that a pair must share.
PER_SHARED = 50
_U = np.uint64


def _ratio(percent: int):
    """Least overlap of sets of a and b shingles: I / (a + b - I) >= percent / 100."""
    return lambda a, b: F.ceil((a + b) * F.lit(percent) / F.lit(100 + percent))


def count_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Each cell's count of all shingles of all documents, on a logarithmic scale of one byte.

    Tasks add up what they have read, slices are added first among some of the tasks and then in
    all; ``MOST_CELLS`` bytes at most are collected, whatever the input.
    """
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << math.ceil(math.log2(16 * max(1, docs.count())))))
    schema = "slice int, part int, counts binary"

    def tally(batches):
        total = np.zeros(cells, np.uint32)
        for batch in batches:
            for s in shingle_sets(batch.column(0), k):
                total[(s & _U(cells - 1)).astype(np.int64)] += np.uint32(1)
        packed = [pa.compress(p.tobytes(), "zstd", asbytes=True) for p in total.reshape(-1, SLICE)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(packed)), pa.int32()), pa.array([0] * len(packed), pa.int32()), pa.array(packed, pa.binary())], ["slice", "part", "counts"])
        del total, packed
        trim()

    def added(last: bool):
        def add(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(SLICE, np.uint64)
            for group in groups:
                for part in group.column("counts"):
                    total += np.frombuffer(pa.decompress(part.as_py(), SLICE * 4, "zstd"), np.uint32)
            out = list_classes(total) if last else np.minimum(total, 2**32 - 1).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([pa.compress(out.tobytes(), "zstd", asbytes=True)], pa.binary())], ["slice", "part", "counts"]
            )

        return add

    tallies = docs.select("text").mapInArrow(tally, schema)
    several = partitions(docs.sparkSession) * SLICE // cells
    if several > 1:
        dealt = tallies.withColumn("part", F.spark_partition_id() % several)
        tallies = dealt.groupBy("slice", "part").applyInArrow(added(False), schema)
    total = np.zeros((cells // SLICE, SLICE), np.uint8)
    for row in tallies.groupBy("slice").applyInArrow(added(True), schema).collect():
        total[row["slice"]] = np.frombuffer(pa.decompress(row["counts"], SLICE, "zstd"), np.uint8)
    return total.ravel()


def list_classes(counts: np.ndarray) -> np.ndarray:
    """Shingles of cells with a lower class come first."""
    return np.minimum(255, np.round(8 * np.log2(1.0 + counts))).astype(np.uint8)


def signatures(docs: DataFrame, k: int, percent: int, classes: np.ndarray) -> DataFrame:
    """Per document: size, set fingerprint (128 bits), parity signature (256) and its short lists."""
    order = docs.sparkSession.sparkContext.broadcast(classes)  # MOST_CELLS bytes at most
    mask = _U(len(classes) - 1)

    def describe(batches):
        for batch in batches:
            n, prints, parity, lists = [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                m = len(s)
                n.append(m)
                if not m:
                    prints.append((0, 0)), parity.append(np.zeros(4, np.int64)), lists.append([])
                    continue
                with np.errstate(over="ignore"):
                    prints.append((int(np.add.reduce(mix64(s)).view(np.int64)), int(np.add.reduce(mix64(s ^ _U(0x5851F42D4C957F2D))).view(np.int64))))
                odd = (np.bincount((s >> _U(56)).astype(np.int64), minlength=256) & 1).astype(np.uint8)
                parity.append(np.packbits(odd).view(np.int64))
                short = m * (100 - percent) // 100 + 1 + m // PER_SHARED
                lists.append(s[np.lexsort((s, order.value[(s & mask).astype(np.int64)]))[:short]].view(np.int64).tolist())
            p = np.array(parity, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array([a for a, _ in prints], pa.int64()), pa.array([b for _, b in prints], pa.int64()),
                 *(pa.array(p[:, i]) for i in range(4)), pa.array(lists, pa.list_(pa.int64()))],
                ["doc_id", "n", "f1", "f2", "s0", "s1", "s2", "s3", "lists"],
            )
        trim()

    return docs.select("doc_id", "text").mapInArrow(
        describe, "doc_id long, n int, f1 long, f2 long, s0 long, s1 long, s2 long, s3 long, lists array<long>"
    )


def _near(percent: int, shared: bool = False):
    """Exact bounds on a pair (x, y) by sizes, and by what can follow at a shared shingle.

    They hold at the first shingle that the two share, with ``shared`` at each of the first that
    the merge must count.
    """
    rest = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    if shared:
        rest = rest + F.floor(F.least("x.n", "y.n") / PER_SHARED)
    return (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent) & (rest >= _ratio(percent)(F.col("x.n"), F.col("y.n")))


def _of(reps: DataFrame, name: str, *columns) -> DataFrame:
    return reps.select(F.col("doc").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))


def _alike(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose parity signatures differ no more than their sets may."""
    marks = ("n", "s0", "s1", "s2", "s3")
    differ = sum(F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b"))) for i in range(4))
    near = differ <= F.col("n_a") + F.col("n_b") - 2 * _ratio(percent)(F.col("n_a"), F.col("n_b"))
    return stage(pairs.join(_of(reps, "b", *marks), "b").join(_of(reps, "a", *marks), "a").where(near).select("a", "b"), "pairs")


def _on_short_lists(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs of a leader that are on enough short lists together: of these only some were met there."""
    on_both = F.size(F.array_intersect("lists_a", "lists_b")) > F.floor(F.least("n_a", "n_b") / PER_SHARED)
    return stage(pairs.join(_of(reps, "b", "n", "lists"), "b").join(_of(reps, "a", "n", "lists"), "a").where(on_both).select("a", "b"), "pairs")


def merged_lists(entries: DataFrame) -> DataFrame:
    """The pairs that occur on enough short lists, by a heap merge of each document's lists.

    entries: ``a, n_a, shingle, b, n_b``, b being on the list of a's shingle. A task reads its
    documents one after the other, each with its lists in order, and holds one document's lists.
    """

    def merge(batches):
        def partners(a: int, parts: list[pa.RecordBatch]):
            t = pa.Table.from_batches(parts)
            n_a, at = t["n_a"][0].as_py(), t["shingle"].to_numpy()
            items = list(zip(t["b"].to_pylist(), t["n_b"].to_pylist(), strict=True))
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            lists = [items[i:j] for i, j in zip(cuts, cuts[1:])]
            for (b, n_b), run in groupby(heapq.merge(*lists)):
                if sum(1 for _ in run) > min(n_a, n_b) // PER_SHARED:
                    yield a, b

        held, of = [], None
        for batch in batches:
            found, a = [], batch.column("a").to_numpy()
            cuts = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)] if len(a) else [0]
            for i, j in zip(cuts, cuts[1:]):
                if held and a[i] != of:
                    found.extend(partners(of, held))
                    held = []
                held.append(batch.slice(i, j - i))
                of = int(a[i])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])
        found = list(partners(of, held)) if held else []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return entries.repartition("a").sortWithinPartitions("a", "shingle", "b").mapInArrow(merge, "a long, b long")


def probe(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that link: the lists set aside are probed by binary search."""
    b = pairs.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
    both = b.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a").select("a", "b", "text_a", "text_b")

    def decide(batches):
        last, left = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            new = [i for i, x in enumerate(a) if x != (a[i - 1] if i else last)]
            lefts = dict(zip(new, shingle_sets(batch.column(2).take(pa.array(new, pa.int64())), k), strict=True))
            keep = []
            for i, right in enumerate(shingle_sets(batch.column(3), k)):
                left = lefts.get(i, left)
                short, long = (left, right) if len(left) <= len(right) else (right, left)
                at = np.minimum(np.searchsorted(long, short), len(long) - 1)
                common = int((long[at] == short).sum()) if len(short) else 0
                if common and 100 * common >= percent * (len(left) + len(right) - common):
                    keep.append(i)
            last = a[-1] if a else last
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])
        trim()

    return both.mapInArrow(decide, "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` at Jaccard >= percent / 100."""
    rows, key = keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    found = linked_rows(rows, k, percent, key)
    if hasattr(rows, "_staged_path"):
        found = found.join(rows.select(key, "doc_id"), key)
        names = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        return found.join(names, "component").select("doc_id", "n_shingles", "component_id")
    return found.select(F.col(key).alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def linked_rows(docs: DataFrame, k: int, percent: int, key: str, text_col: str = "text") -> DataFrame:
    """``key, n_shingles, component`` (its smallest key) of each row; ``key`` is a long, and each row's own."""
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    described = stage(signatures(texts, k, percent, count_sketch(texts, k)), "sets")
    # One document per class goes on: the one whose id is the class's smallest.
    one = F.min(F.struct("doc_id", "n", "s0", "s1", "s2", "s3", "lists")).alias("r")
    reps = stage(described.where("n > 0").groupBy("f1", "f2").agg(one).select(F.col("r.doc_id").alias("doc"), "r.n", "r.s0", "r.s1", "r.s2", "r.s3", "r.lists"), "reps")
    ids = stage(described.select("doc_id", "n", "f1", "f2"), "ids")
    drop(described)
    postings = reps.select("doc", F.posexplode("lists").alias("place", "shingle"))
    shared = postings.groupBy("shingle").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    met = stage(postings.join(shared, "shingle"), "met")
    # How many others a document meets: an original meets more than its altered copies do.
    meets = met.groupBy("doc").agg(F.sum("length").alias("meets"))
    lists = stage(met.drop("length").join(reps.select("doc", "n").join(meets, "doc"), "doc"), "lists")
    drop(met)
    # Only documents with a partner within the bounds are looked at again, so the texts are
    # shuffled once and what goes on is the near copies' share of them.
    partner = lists.alias("x").join(lists.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.doc") != F.col("y.doc")) & _near(percent), "left_semi")
    partnered = stage(partner.select("doc").distinct(), "partnered")
    every, lists = (lists, reps), stage(lists.join(partnered, "doc", "left_semi"), "lists")
    reps = stage(reps.join(partnered, "doc", "left_semi"), "reps")
    drop(*every)
    texts = stage(texts.join(partnered.withColumnRenamed("doc", "doc_id"), "doc_id", "left_semi"), "texts")

    links = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    named = lists.withColumn("component", F.col("doc"))
    for turn in range(ROUNDS):
        # Stars: on each list a document meets the leader, in a later round another one.
        by = F.col("meets") if turn == 0 else F.xxhash64("doc", F.lit(turn))
        leaders = named.groupBy("shingle").agg(F.max_by(F.struct("doc", "component", "n", "place"), F.struct(by.alias("by"), (-F.col("doc")).alias("id"))).alias("y"))
        pairs = (
            named.alias("x").join(leaders, "shingle").where(F.col("x.component") != F.col("y.component")).where(_near(percent))
            .select(F.col("y.doc").alias("a"), F.col("x.doc").alias("b")).distinct()
        )
        alike = _alike(pairs, reps, percent)
        likely = _on_short_lists(alike, reps)
        found = stage(probe(likely, texts, k, percent), "links")
        drop(alike, likely)
        links = links.unionByName(found)
        labels = components(links, "near")
        named = lists.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    open_lists = named.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("shingle")
    left = stage(named.join(open_lists, "shingle", "left_semi"), "open")
    entries = (
        left.alias("x").join(left.alias("y"), "shingle").where("x.doc < y.doc AND x.component <> y.component").where(_near(percent, shared=True))
        .select(F.col("x.doc").alias("a"), F.col("x.n").alias("n_a"), "shingle", F.col("y.doc").alias("b"), F.col("y.n").alias("n_b"))
    )
    likely = _alike(merged_lists(entries), reps, percent)
    found = stage(probe(likely, texts, k, percent), "links")
    drop(likely)
    labels = components(links.unionByName(found), "near")
    drop(reps, partnered, lists, texts, left)
    classes = ids.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("doc"))
    named = classes.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("f1", "f2", F.coalesce("component", "doc").alias("component"))
    sizes = ids.where("n > 0").join(named, ["f1", "f2"]).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component")
    every = sizes.unionByName(ids.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component")))
    return every.withColumnRenamed("doc_id", key)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(x) = 0 THEN [] WHEN len(x) < 3 THEN [list_aggregate(x, 'string_agg', ' ')]
    ELSE list_transform(range(1, len(x) - 1), lambda i: x[i] || ' ' || x[i + 1] || ' ' || x[i + 2]) END) AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
c AS (SELECT doc_id AS a, doc_id AS r FROM documents UNION SELECT c.a, p.b FROM c JOIN p ON c.r = p.a)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, (SELECT min(r) FROM c WHERE c.a = s.doc_id) AS component_id FROM s
"""
