"""A change feed as a streaming source whose offset is the version.

The feed is a folder of Parquet files whose rows have a ``version``; the newest
``reach`` rows are what the remote side still tells.  A micro-batch covers the
versions after the last one, read by file and row group from the footers'
statistics.  If all rows within reach are newer than the last version, changes
before them may be lost: the batch is one row with ``reload`` set, and a whole
scan is due.  What a batch holds depends on its two offsets only, so a restarted
query repeats it exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import BooleanType, StructType


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _files(disk: fs.FileSystem, root: str) -> list[str]:
    infos = disk.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(f.path for f in infos if f.type == fs.FileType.File and f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")))


class Versions(InputPartition):
    """Rows with start < version <= end of some row groups; a reload if there is no file."""

    def __init__(self, start: int, end: int, file: str = "", groups: list[int] | None = None):
        self.start, self.end, self.file, self.groups = start, end, file, groups or []


class FeedReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        self.reach, self.together = int(options.get("reach", 30)), int(options.get("rowsperpartition", 1_000_000))
        self._footers: dict[str, list[tuple[int, int, int]]] = {}

    def _groups(self) -> dict[str, list[tuple[int, int, int]]]:
        """Least version, highest version and rows of each row group by file; each footer is read once."""
        disk, root = _open(self.path)
        for file in _files(disk, root):
            if file not in self._footers:
                meta = pq.read_metadata(file, filesystem=disk)
                at = meta.schema.names.index("version")
                stats = [(meta.row_group(i).column(at).statistics, meta.row_group(i).num_rows) for i in range(meta.num_row_groups)]
                self._footers[file] = [(s.min, s.max, n) if s is not None and s.has_min_max else (-(1 << 63), 0, n) for s, n in stats]
        return self._footers

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        return {"version": max([0, *(high for groups in self._groups().values() for _, high, _ in groups)])}

    def _count(self, start: int, end: int) -> int:
        """Rows with start < version <= end: by footers where a group lies within, else by reading one column."""
        disk, _ = _open(self.path)
        total = 0
        for file, groups in self._groups().items():
            some = [i for i, (low, high, _) in enumerate(groups) if high > start and low <= end]
            inside = [i for i in some if groups[i][0] > start and groups[i][1] <= end]
            total += sum(groups[i][2] for i in inside)
            if edge := [i for i in some if i not in inside]:
                version = ds.field("version")
                part = ds.ParquetFileFormat().make_fragment(file, disk, row_groups=edge)
                total += part.count_rows(filter=(version > start) & (version <= end), schema=pa.schema([("version", pa.int64())]))
        return total

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, upto = start["version"], end["version"]
        if upto <= after:
            return []
        fresh = self._count(after, upto)
        if after <= 0 or fresh >= min(self.reach, fresh + self._count(-(1 << 62), after)):
            return [Versions(after, upto)]
        found = []
        for file, groups in self._groups().items():
            held, rows = [], 0
            for i, (low, high, n) in enumerate(groups):
                if high > after and low <= upto:
                    held, rows = [*held, i], rows + n
                    if rows >= self.together:
                        found.append(Versions(after, upto, file, held))
                        held, rows = [], 0
            if held:
                found.append(Versions(after, upto, file, held))
        return found

    def read(self, partition: Versions) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        if not partition.file:
            row = {f.name: None for f in schema} | {"version": partition.end, "reload": True}
            yield pa.RecordBatch.from_pylist([row], schema=schema)
            return
        disk, _ = _open(self.path)
        part = ds.ParquetFileFormat().make_fragment(partition.file, disk, row_groups=partition.groups)
        version = ds.field("version")
        for batch in part.to_batches(filter=(version > partition.start) & (version <= partition.end), columns=[f.name for f in schema if f.name != "reload"]):
            columns = [pa.repeat(False, batch.num_rows) if f.name == "reload" else batch.column(f.name).cast(f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def commit(self, end: dict) -> None:
        """Nothing to give back: the remote side forgets by itself."""


class FeedSource(DataSource):
    """Options: ``path``; ``reach``, how many of the newest rows the feed tells (30);
    ``rowsperpartition``.  The columns are those of the files, and ``reload``."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> StructType:
        disk, root = _open(self.options["path"])
        files = _files(disk, root)
        if not files:
            raise ValueError(f"no feed files in {root}: give a schema")
        own: Any = from_arrow_schema(pq.read_schema(files[0], filesystem=disk))
        return own.add("reload", BooleanType())

    def streamReader(self, schema: StructType) -> FeedReader:
        return FeedReader(schema, dict(self.options))


def feed_stream(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """The feed in ``path`` as a stream: its columns and ``reload``."""
    spark.dataSource.register(FeedSource)
    return spark.readStream.format("feed").options(path=path, **options).load()
