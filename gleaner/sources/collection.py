"""Collections of points on Parquet: a log of small JSON files, each naming the folders that are current.

A collection is a base folder and a few folders of changes (points put, ids deleted), so a write is
as large as what changes; every ``CHANGES`` writes they are folded into a new base. A writer makes
its folder first and then adds the next entry of the log, by renaming a finished file: readers see
the newest whole entry, there always is one, and a lost writer leaves it standing. Of two writers at
once one finds its entry taken, and starts over from the newer one.

Hashed sparse vectors are stored with the points, so a sparse search reads them instead of texts.
"""

from __future__ import annotations

import json
import time
import uuid
from contextlib import ExitStack, contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T
from ..functions import vector as V
from ..operators import ingest, search
from ..operators.registry import backends

#: Payload fields kept as columns of their own, so that filters on them reach the scan.
FIELDS = {"text": "string", "filepath": "string", "chunk_index": "int", "source": "string", "category": "string"}


#: Folders of changes that are folded into a new base; log entries whose folders stay for readers;
#: seconds for which a folder that no entry names may be a write under way.
CHANGES, KEPT, UNNAMED = 8, 4, 3600


class Collections:
    """All collections below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        path = self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path.getFileSystem(self._conf), path

    def _entries(self, name: str) -> list[int]:
        fs, path = self._path(name, "log")
        if not fs.exists(path):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "_")

    def _meta(self, name: str) -> dict:
        entries = self._entries(name)
        if not entries:
            raise ValueError(f"no collection {name}")
        row = self.spark.read.text("/".join((self.root, name, "log", f"{entries[-1]:012d}.json")), wholetext=True).first()
        return json.loads(row["value"]) | {"entry": entries[-1]}

    def _add(self, name: str, meta: dict) -> bool:
        """Add the entry after ``meta["entry"]``; False if another writer has."""
        number = meta["entry"] + 1
        fs, to = self._path(name, "log", f"{number:012d}.json")
        _, new = self._path(name, "log", f"_{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({k: v for k, v in meta.items() if k != "entry"}), "utf-8"))
        out.close()
        if fs.exists(to) or not fs.rename(new, to):
            fs.delete(new, False)
            return False
        return True

    def _folder(self, name: str, rows: DataFrame) -> str:
        folder = f"v-{uuid.uuid4().hex}"
        rows.write.parquet("/".join((self.root, name, folder)))
        return folder

    def exists(self, name: str) -> bool:
        return bool(self._entries(name))

    def names(self) -> list[str]:
        fs, path = self._path()
        found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in found if n[0] != "_" and self.exists(n))

    def health(self) -> dict:
        return {"status": "ok", "collections": self.names()}

    def create(self, name: str, size: int, metric: str = "cosine", image_size: int | None = None) -> None:
        """A new empty collection; nothing happens if it exists. Unknown metrics are cosine."""
        if self.exists(name):
            return
        fields = [S.StructField("id", S.StringType()), S.StructField("dense", S.ArrayType(S.DoubleType())), S.StructField("image", S.ArrayType(S.DoubleType()))]
        schema = S.StructType(fields)
        for field, kind in FIELDS.items():
            schema = schema.add(field, S.IntegerType() if kind == "int" else S.StringType())
        schema = schema.add("metadata", S.MapType(S.StringType(), S.StringType()))
        schema = schema.add("sparse", S.StructType([S.StructField("indices", S.ArrayType(S.IntegerType())), S.StructField("values", S.ArrayType(S.DoubleType()))]))
        base = self._folder(name, self.spark.createDataFrame([], schema))
        self._add(name, {"entry": 0, "base": base, "changes": [], "size": size, "image_size": image_size or size, "metric": V.METRICS.get(metric.lower(), "cosine")})

    def _current(self, name: str, meta: dict) -> DataFrame:
        there = self.spark.read.parquet("/".join((self.root, name, meta["base"])))
        if not meta["changes"]:
            return there
        parts = [self.spark.read.parquet("/".join((self.root, name, c))).withColumn("_n", F.lit(n)) for n, c in enumerate(meta["changes"])]
        changes = reduce(DataFrame.unionByName, parts)
        last = changes.groupBy("id").agg(F.max("_n").alias("_n"))
        newest = changes.join(last, ["id", "_n"]).where("NOT _deleted").select(*there.columns)
        return there.join(last.select("id"), "id", "left_anti").select(*there.columns).unionByName(newest)

    def read(self, name: str) -> DataFrame:
        return self._current(name, self._meta(name))

    def _change(self, name: str, rows: DataFrame) -> None:
        """Add a folder of points put (``_deleted`` false) and ids deleted; one row an id."""
        folder = self._folder(name, rows)
        while True:
            meta = self._meta(name)
            if self._add(name, meta | {"changes": [*meta["changes"], folder]}):
                break
        if len(meta["changes"]) + 1 >= CHANGES:
            self.compact(name)

    def compact(self, name: str) -> None:
        """Fold the changes into a new base, and delete folders that the last ``KEPT`` entries do not name."""
        meta = self._meta(name)
        base = self._folder(name, self._current(name, meta))
        if not self._add(name, meta | {"base": base, "changes": []}):
            return  # another writer came first: its entry will be folded by a later write
        entries = self._entries(name)
        fs, path = self._path(name)
        named = {"log"}
        for entry in entries[-KEPT:]:
            row = self.spark.read.text("/".join((self.root, name, "log", f"{entry:012d}.json")), wholetext=True).first()
            told = json.loads(row["value"])
            named |= {told["base"], *told["changes"]}
        old = [f for f in fs.listStatus(path) if f.getPath().getName() not in named and f.getModificationTime() < (time.time() - UNNAMED) * 1000]
        for f in old:
            fs.delete(f.getPath(), True)

    def upsert(self, name: str, points: DataFrame) -> None:
        """Points ``id, dense`` with any payload; other columns become entries of ``metadata``.

        An ``image`` array column, or ``image_vector``, is the second vector, and no payload.
        """
        if "image" not in points.columns and "image_vector" in points.columns:
            points = points.withColumnRenamed("image_vector", "image")
        known = {"id", "dense", "image", "metadata", "_order", *FIELDS}
        extra = [c for c in points.columns if c not in known]
        old = F.col("metadata") if "metadata" in points.columns else F.create_map().cast("map<string,string>")
        more = F.map_from_arrays(F.array(*(F.lit(c) for c in extra)), F.array(*(F.col(c).cast("string") for c in extra))) if extra else F.create_map().cast("map<string,string>")
        there = self.read(name)
        shaped = points.withColumn("id", F.col("id").cast("string")).withColumn("metadata", F.map_concat(F.map_filter(old, lambda k, _: ~k.isin(extra or [""])), more))
        for field in there.schema.fields:
            if field.name in shaped.columns:
                shaped = shaped.withColumn(field.name, F.col(field.name).cast(field.dataType))
            else:
                shaped = shaped.withColumn(field.name, F.lit(None).cast(field.dataType))
        order = ["_order"] if "_order" in shaped.columns else []
        shaped = shaped.select(*there.columns, *order)
        # One row an id: the last by ``_order``, or any where callers give none.
        new = ingest.upsert(there.limit(0), shaped) if order else shaped.dropDuplicates(["id"])
        vectors = search.sparse_vectors(new.where("text IS NOT NULL").select("id", "text")).select("id", F.struct("indices", "values").alias("sparse"))
        self._change(name, new.drop("sparse").join(vectors, "id", "left").select(*there.columns, F.lit(False).alias("_deleted")))

    def delete(self, name: str, ids: list[str] | DataFrame) -> None:
        """Ids as a list, or as a table with a column ``id``."""
        there = self.read(name)
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(str(i),) for i in ids], "id string")
        gone = ids.select(F.col("id").cast("string").alias("id")).distinct()
        self._change(name, gone.select("id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in there.schema.fields if f.name != "id"), F.lit(True).alias("_deleted")))

    def store(self, texts: DataFrame, embed, name: str) -> None:
        """Texts (``text``, optional ``id``) with vectors of ``embed``; without an id it is a UUID
        of collection and text, so storing twice changes nothing. Blank texts raise; of rows that
        share an id the last wins."""
        blank = F.col("text").isNull() | (T.strip(F.col("text")) == "")
        if texts.where(blank).limit(1).count():
            raise ValueError("text must not be blank")
        own = T.store_id(F.lit(name), F.col("text"))
        points = texts.withColumn("id", F.coalesce(F.col("id").cast("string"), own) if "id" in texts.columns else own).withColumn("_order", F.monotonically_increasing_id())
        with self.staged(points.withColumn("dense", embed(F.col("text")))) as made:
            first = made.select(F.size("dense").alias("n")).first()
            if first is None:
                return
            if not self.exists(name):
                self.create(name, first["n"])
            self.upsert(name, made)

    @contextmanager
    def staged(self, df: DataFrame):
        """A table written below the collections' folder for as long as it is needed."""
        fs, path = self._path("_staged", uuid.uuid4().hex)
        df.write.parquet(str(path))
        try:
            yield self.spark.read.schema(df.schema).parquet(str(path))
        finally:
            fs.delete(path, True)

    def ingest(self, name: str, scan: DataFrame, state: DataFrame, embed, dimensions: int, image_size: int | None = None, **options) -> tuple[list, DataFrame]:
        """Run all jobs of a scan against the collection: stale points go, new ones come.

        Returns how many jobs ran by action and status, as rows (action, status, one of their errors,
        n), and the next state, which is written below the collection and read back.
        """
        self.create(name, dimensions, image_size=image_size)
        with ExitStack() as stack:
            run = ingest.plan_run(scan, state, name, embed, store=lambda df, _: stack.enter_context(self.staged(df)), **options)
            jobs = stack.enter_context(self.staged(run.jobs))
            new = stack.enter_context(self.staged(run.points))
            gone = stack.enter_context(self.staged(run.stale))
            folder = self._folder(f"_state/{name}", run.state)
            if gone.limit(1).count():
                self.delete(name, gone.join(new, "id", "left_anti"))
            if new.limit(1).count():
                self.upsert(name, new)
            counts = [tuple(r) for r in jobs.groupBy("action", "status").agg(F.min("error").alias("error"), F.count(F.lit(1)).alias("n")).orderBy("action", "status").collect()]
        return counts, self.spark.read.schema(ingest.STATE).parquet("/".join((self.root, "_state", name, folder)))

    def search(self, name: str, query: list[float], default: str | None = None, **options) -> DataFrame:
        """Search a collection; one that is missing is replaced by ``default`` or finds nothing."""
        if not self.exists(name) and default is not None and self.exists(default):
            name = default
        if not self.exists(name):
            return self.spark.createDataFrame([], "id string, score double")
        return search.search(self.read(name), query, metric=self._meta(name)["metric"], **options)


@backends.register("parquet")
def parquet_backend(spark: SparkSession, root: str) -> Collections:
    return Collections(spark, root)
