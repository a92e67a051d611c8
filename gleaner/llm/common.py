"""What the operators of this subpackage share: reading tables, staging tables in the
cluster's shared folder, and connected components.

Intermediate tables are cut from their lineage by writing them as Parquet below the folder
named in ``spark.checkpoint.dir`` (never a machine-local folder on a cluster), so a lost
executor costs a re-read of shared files and not a recomputation of the whole plan.
"""

from __future__ import annotations

import atexit
import ctypes
import sys
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract of this subpackage: U+0020 and U+0009 to U+000D.
WHITE_SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_staged: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark's own reader whatever the store is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; the warehouse where that is unset on one machine (tests)."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return there or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or what it becomes with underscores until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/gleaner-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _staged:
        atexit.register(lambda: release(staged_paths()))
    _staged[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def keyed(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """The rows with a key of each row, and its column's name.

    The key is the id; only where rows share an id, or have none, is it a number written with the
    rows, so that they are documents of their own.
    """
    key = free_name(docs, "row_key")
    ids = docs.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    if ids.where("n > 1 OR id IS NULL").isEmpty():
        return docs.withColumn(key, F.col(id_col)), key
    return stage(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def staged_paths() -> list[str]:
    """Folders of all staged tables that are still there, oldest first."""
    return list(_staged)


def release(paths: list[str]) -> None:
    """Delete staged tables that nothing lazy reads any more; the rest goes when the driver ends."""
    for path in paths:
        spark = _staged.pop(path, None)
        jsc = spark and spark.sparkContext._jsc
        if jsc is not None:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Release tables that ``stage`` returned, and the shuffle files behind them.

    Spark deletes shuffle files once the driver's collector finds their plans unused, which may
    be much later; a collection now frees the disks of all executors before the next large step.
    """
    release([t._staged_path for t in tables])
    tables[0].sparkSession.sparkContext._jvm.System.gc()


def trim() -> None:
    """At the end of a Python task: hand freed memory back, since the worker stays for later stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of an undirected edge table ``(a, b)`` of longs.

    Alternating large-star and small-star contraction: every round only rewires edges to the
    smallest neighbour, so the table never grows, and rounds go on until nothing changes: few on the
    shallow groups that near-duplicates form, O(log**2) of the nodes on any graph. Minima are partially
    aggregated before the shuffle, so a hot vertex is no hot task there, and staged: the join that
    hands them back is then one of two tables, in which adaptive execution can split a hot vertex. Returns ``(node, component)`` for every node of an edge,
    ``component`` being the smallest node reachable. No edge or label is collected.
    """
    here = stage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label
    )
    while True:
        both = here.unionByName(here.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), label)
        large = both.join(smallest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, label)
        low = stage(large.groupBy("a").agg(F.min("b").alias("m")), label)
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*").where("a <> b").distinct()
        )
        new = stage(small, label)
        # A fixpoint is reached once every node points straight at a root that points nowhere.
        chained = new.join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        several = new.groupBy("a").count().where("count > 1").limit(1).count()
        release([t._staged_path for t in (here, smallest, large, low)])
        here = new
        if not chained and not several:
            break
    roots = here.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return here.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
