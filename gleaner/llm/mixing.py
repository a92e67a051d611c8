"""Operator 7, mixing sources to target weights by a low-discrepancy schedule (DataFrame only).

The budget is 150 % of all words. It is shared by weight under a ceiling of twice each source's
size (water filling in closed form over the source table). Every slot of ``BLOCK`` words gets a
point of the golden-ratio sequence; cumulative target shares map the point to a source, slots are
ranked within their source, and rank r takes block r mod n of the source's shuffled word stream.

Nothing is ordered in one task but the table of sources (a row each): ranks and word offsets are
prefix sums over chunks (of 4096 slots, of 4096 hash ranges a source) and over groups of 4096
chunks, so a hot source is spread out.

Defined results: null text has size 0 and takes nothing; null source is a source of its own,
last; repeated rows, and rows without an id, are documents of their own; an empty table gives an empty
result. The order of documents is that of a digest of their id, so reruns agree; where ids repeat or
are null it is that of the id with a number written with each row, so that no such rows fill one hash
range (reruns then agree as long as the table is split alike).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, partitions, stage

#: Words of a block and of a slot.
BLOCK = 64
WEIGHTS, SHARE, CEILING = (5, 2, 1), 1.5, 2
#: Slots that one task makes.
SLOTS = 1 << 22
#: 2**32 over the golden ratio, odd: slot times this, modulo 2**32, is the slot's point.
GOLDEN, POINTS, CELLS, CHUNK = 2654435769, 1 << 32, 4096, 4096


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """``(key, source, source_size)`` to the same with ``target, low, high`` (its points).

    One row a source: the only table here that one task orders as a whole.
    """
    all_, by_rank = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    full = Window.orderBy("ratio", "key")
    w = sizes.select(
        "*", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_rank) - 1) % len(weights) + 1).cast("int")).cast("double").alias("weight"),
        (F.sum("source_size").over(all_) * F.lit(share)).alias("budget"), (F.col("source_size") * ceiling).cast("double").alias("most"),
    ).withColumn("ratio", F.col("most") / F.col("weight"))
    w = w.withColumn(
        "level",
        (F.col("budget") - F.coalesce(F.sum("most").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)),
    )
    w = w.withColumn("water", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(all_))
    w = w.withColumn("target", F.least("most", F.coalesce(F.col("water") * F.col("weight"), F.col("most"))))
    upto = F.sum("target").over(by_rank.rowsBetween(Window.unboundedPreceding, 0))
    w = w.withColumn("high", F.coalesce(F.floor(F.round(F.try_divide(upto, F.sum("target").over(all_)) * F.lit(POINTS), 3)), F.lit(0)))
    return w.select("key", "source", "source_size", "target", F.coalesce(F.lag("high").over(by_rank), F.lit(0)).alias("low"), "high", "budget")


def point_of(slot: Column) -> Column:
    """The slot's point of the sequence: slot times ``GOLDEN`` modulo ``POINTS``, by halves so that nothing overflows."""
    low, high = slot.bitwiseAND(0xFFFF), F.shiftright(slot, 16).bitwiseAND(0xFFFF)
    return (low * GOLDEN + (high * GOLDEN).bitwiseAND(0xFFFF) * 0x10000).bitwiseAND(POINTS - 1)


def _before(chunks: DataFrame, place: str, count: str) -> DataFrame:
    """``key, place, before``: what a source's earlier chunks hold, ordered group by group."""
    grouped = chunks.withColumn("group", F.floor(F.col(place) / CHUNK))
    groups = grouped.groupBy("key", "group").agg(F.sum(count).alias("sum"))
    earlier = groups.select("key", "group", (F.sum("sum").over(Window.partitionBy("key").orderBy("group")) - F.col("sum")).alias("earlier"))
    within = F.sum(count).over(Window.partitionBy("key", "group").orderBy(place)) - F.col(count)
    return grouped.select("key", "group", place, within.alias("within")).join(earlier, ["key", "group"]).select("key", place, (F.col("earlier") + F.col("within")).alias("before"))


def schedule(targets: DataFrame, block: int = BLOCK, ceiling: int = CEILING) -> DataFrame:
    """One row per slot: ``slot, key, rank, block, pass``; a block is taken ``ceiling`` times at most."""
    spark = targets.sparkSession
    n = targets.agg(F.ceil(F.max("budget") / block).cast("long").alias("n")).first()["n"] or 0
    slots = (
        spark.range(0, n, 1, max(partitions(spark), n // SLOTS)).select(F.col("id").alias("slot"), F.floor(F.col("id") / CHUNK).alias("chunk"), point_of(F.col("id")).alias("point"))
        .withColumn("cell", F.floor(F.col("point") / (POINTS // CELLS)))
    )
    cells = targets.where("high > low").select(
        "key", "low", "high", F.ceil(F.col("source_size") / block).alias("blocks"),
        F.explode(F.sequence(F.floor(F.col("low") / (POINTS // CELLS)), F.floor((F.col("high") - 1) / (POINTS // CELLS)))).alias("cell"),
    )
    # Sizes of exploded sequences are underestimated: without the hints these sides would be broadcast.
    drawn = slots.join(cells.hint("merge"), "cell").where("point >= low AND point < high").select("slot", "chunk", "key", "blocks")
    per_chunk = drawn.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("c"))
    ranked = drawn.join(_before(per_chunk, "chunk", "c").hint("merge"), ["key", "chunk"]).withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("key", "chunk").orderBy("slot")) - 1
    )
    return ranked.where(F.col("rank") < F.col("blocks") * ceiling).select(
        "slot", "key", "rank", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("pass")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, row_col: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``.

    ``row_col``: a key of each row, returned with its answer.
    """
    row = [row_col] if row_col else []
    rows = stage(
        docs.select(
            *row, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null")).alias("key"),
            words_of(F.col(text_col)).alias("size"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("number"),
        ),
        "mix",
    )
    own = F.col("number" if row_col else "doc_id").cast("string")
    if not row_col and not rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        own = F.concat(F.coalesce(own, F.lit("")), F.lit(":"), F.col("number").cast("string"))
    rows = rows.withColumn("h", F.md5(own.cast("binary"))).withColumn("range", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    ranges = rows.groupBy("key", "source", "range").agg(F.sum("size").alias("words"))
    targets = stage(source_targets(ranges.groupBy("key", "source").agg(F.sum("words").alias("source_size"))), "targets")
    starts = ranges.select("key", "range", (F.sum("words").over(Window.partitionBy("key").orderBy("range")) - F.col("words")).alias("start"))
    inside = Window.partitionBy("key", "range").orderBy("h", "doc_id", "size", "number").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(starts.hint("merge"), ["key", "range"]).select(
        *row, "doc_id", "key", "size", (F.col("start") + F.sum("size").over(inside) - F.col("size")).alias("at")
    )
    takes = schedule(targets, block).groupBy("key", "block").agg(F.count(F.lit(1)).alias("passes"))
    pieces = placed.where("size > 0").select(
        *row, "doc_id", "key", "at", "size",
        F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"),
    )
    overlap = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("at"), F.col("block") * block)
    taken = (
        pieces.join(takes.hint("merge"), ["key", "block"], "left")
        .groupBy(*row, "doc_id", "key", "at", "size").agg(F.sum(overlap * F.coalesce("passes", F.lit(0))).alias("taken"))
    )
    taken = taken.unionByName(placed.where("size = 0").select(*row, "doc_id", "key", "at", "size", F.lit(0).cast("long").alias("taken")))
    per_source = targets.select("key", "source_size", "target")
    return taken.join(per_source, "key").select(
        *row, "doc_id", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", F.col("taken").cast("long").alias("taken")
    )


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(doc_id::VARCHAR) AS h FROM documents),
z AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, source_size * 2.0::DOUBLE AS most, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM z),
l AS (
  SELECT *, most / weight AS ratio,
         (budget - coalesce(sum(most) OVER (ORDER BY most / weight, coalesce('=' || source, 'null') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY most / weight, coalesce('=' || source, 'null') ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, budget, least(most, (SELECT min_by(level, ratio) FROM l WHERE level <= ratio) * weight) AS target FROM l),
b AS (
  SELECT *, floor(round(sum(target) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) / sum(target) OVER () * {POINTS}::DOUBLE, 3))::BIGINT AS high FROM t),
r AS (SELECT *, coalesce(lag(high) OVER (ORDER BY source NULLS LAST), 0) AS low, ceil(source_size / {BLOCK}.0)::BIGINT AS blocks FROM b),
s AS (SELECT i AS slot, (i * {GOLDEN}) % {POINTS} AS point FROM range((SELECT ceil(max(budget) / {BLOCK})::BIGINT FROM r)) q(i)),
k AS (
  SELECT source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM s JOIN r ON point >= low AND point < high),
p AS (SELECT source, rank % blocks AS block, count(*) AS passes FROM k WHERE rank < 2 * blocks GROUP BY ALL),
o AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS pos FROM d),
e AS (SELECT *, unnest(range(pos // {BLOCK}, (pos + size - 1) // {BLOCK} + 1)) AS block FROM o WHERE size > 0),
a AS (
  SELECT doc_id, sum((least(pos + size, (e.block + 1) * {BLOCK}) - greatest(pos, e.block * {BLOCK})) * coalesce(passes, 0)) AS taken
  FROM e LEFT JOIN p ON e.source IS NOT DISTINCT FROM p.source AND e.block = p.block GROUP BY doc_id)
SELECT doc_id, size::BIGINT AS size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN a USING (doc_id)
"""
