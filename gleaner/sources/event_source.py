"""An event source for streams: Parquet files of events that a server keeps adding, as a Python data source.

    event_source.register(spark)
    spark.readStream.format("session_events").option("path", "s3://bucket/events").option("rows", 50_000).load()

An offset is the name of a file and a number of its rows: what lies before it has been read. Files count
in the order of their paths below the folder, so new ones must sort after those that are there (a writer
names them, or their folders, by time or number), and a file is complete when it appears. A batch takes
whatever there is, in partitions of about ``rows`` rows (whole row groups, cut where a batch ends inside
one); files are read on executors, batch by batch, columns as they are. Restarted, a query goes on at the
offset of its checkpoint.

Defined results: hidden files and those of other endings are left out; an empty folder gives no rows, but
then the schema must be stated; files without rows are passed over; columns that a file lacks are null.
The folder may be any that Arrow's file systems reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

ROWS = 100_000


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def event_files(path: str) -> list[str]:
    """Names of the folder's Parquet files, below it and in order."""
    fs, root = _open(path)
    root = root.rstrip("/")
    found = fs.get_file_info(pa.fs.FileSelector(root, recursive=True, allow_not_found=True))
    names = [f.path[len(root) + 1 :] for f in found if f.type == pa.fs.FileType.File and f.path.endswith(".parquet")]
    return sorted(n for n in names if not any(part.startswith(("_", ".")) for part in n.split("/")))


def footer(path: str, name: str) -> pq.FileMetaData:
    fs, root = _open(path)
    return pq.read_metadata(f"{root.rstrip('/')}/{name}", filesystem=fs)


class EventPart(InputPartition):
    """Rows ``[begin, end)`` of a file's row groups ``groups``, counted from the first of them."""

    def __init__(self, name: str, groups: list[int], begin: int, end: int):
        self.name, self.groups, self.begin, self.end = name, groups, begin, end


class EventReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.rows = options["path"], int(options.get("rows", ROWS))
        self.schema = to_arrow_schema(schema)

    def initialOffset(self) -> dict:
        return {"file": "", "row": 0}

    def latestOffset(self) -> dict:
        names = event_files(self.path)
        return {"file": names[-1], "row": footer(self.path, names[-1]).num_rows} if names else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[EventPart]:
        parts = []
        for name in event_files(self.path):
            if start["file"] <= name <= end["file"]:
                meta = footer(self.path, name)
                begin = start["row"] if name == start["file"] else 0
                stop = min(end["row"], meta.num_rows) if name == end["file"] else meta.num_rows
                parts += self.cut(name, [meta.row_group(i).num_rows for i in range(meta.num_row_groups)], begin, stop)
        return parts

    def cut(self, name: str, sizes: list[int], begin: int, stop: int) -> list[EventPart]:
        """Parts of one file's rows ``[begin, stop)``, whole row groups of about ``rows`` rows together."""
        parts, groups, first, at = [], [], 0, 0
        for group, size in enumerate(sizes):
            low, high = max(begin, at), min(stop, at + size)
            if low < high:
                if not groups:
                    first, taken_from = at, low
                groups.append(group)
                if high - taken_from >= self.rows:
                    parts.append(EventPart(name, groups, taken_from - first, high - first))
                    groups = []
                last = high
            at += size
        if groups:
            parts.append(EventPart(name, groups, taken_from - first, last - first))
        return parts

    def read(self, partition: EventPart) -> Iterator[pa.RecordBatch]:
        fs, root = _open(self.path)
        with fs.open_input_file(f"{root.rstrip('/')}/{partition.name}") as file:
            source, at = pq.ParquetFile(file), 0
            there = [f.name for f in self.schema if f.name in source.schema_arrow.names]
            for batch in source.iter_batches(batch_size=8192, row_groups=partition.groups, columns=there):
                low, high = max(partition.begin, at), min(partition.end, at + len(batch))
                if low < high:
                    some = batch.slice(low - at, high - low)
                    columns = [some.column(f.name).cast(f.type) if f.name in there else pa.nulls(len(some), f.type) for f in self.schema]
                    yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
                at += len(batch)


class EventSource(DataSource):
    """Options: ``path``; ``rows``, about how many a partition has."""

    @classmethod
    def name(cls) -> str:
        return "session_events"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        names = event_files(self.options["path"])
        if not names:
            raise ValueError("a schema must be stated for a folder without files")
        fs, root = _open(self.options["path"])
        return from_arrow_schema(pq.read_schema(f"{root.rstrip('/')}/{names[0]}", filesystem=fs))

    def streamReader(self, schema: StructType) -> EventReader:
        return EventReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventSource)
