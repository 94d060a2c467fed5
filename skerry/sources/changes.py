"""Changed files of a folder as a stream: the event source of a watcher.

The offset is the time of the last change that was told, in microseconds; a
micro-batch tells the files that changed after it, so a file that is written
again is told again, and a restarted query repeats what it told before.  Only
changes that are older than ``settle`` milliseconds are told, since a file
system gives later writes the same time.  The folder is listed on the driver, as
Spark lists a file source's; its rows are made in tasks.  A deletion is no
change: it shows in the next whole listing.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "root string, path string, size bigint, ts timestamp"
_SCHEMA = pa.schema([("root", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("ts", pa.timestamp("us", "UTC"))])


class Files(InputPartition):
    def __init__(self, rows: list[tuple[str, int, int]]):
        self.rows = rows


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.settle = options["path"], int(options.get("settle", 1000))
        self.together = int(options.get("filespertask", 10_000))

    def _listed(self) -> list[tuple[str, int, int]]:
        """(path below the root, size, microseconds of the last change) of the visible files."""
        disk, root = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        files = disk.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        below = ((f.path[len(root) :].lstrip("/"), f) for f in files if f.type == fs.FileType.File)
        return [(p, f.size, f.mtime_ns // 1000) for p, f in below if not any(part.startswith(".") for part in p.split("/"))]

    def initialOffset(self) -> dict:
        return {"us": 0}

    def latestOffset(self) -> dict:
        return {"us": int(time.time() * 1_000_000) - 1000 * self.settle}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        rows = sorted((r for r in self._listed() if start["us"] < r[2] <= end["us"]), key=lambda r: r[2])
        return [Files(rows[k : k + self.together]) for k in range(0, len(rows), self.together)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        columns = list(zip(*partition.rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([self.path] * len(partition.rows)), pa.array(columns[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()).cast(_SCHEMA.field(3).type)], schema=_SCHEMA)

    def commit(self, end: dict) -> None:
        """Nothing to give back."""


class ChangeSource(DataSource):
    """Options: ``path``; ``settle``, how old a change must be, in milliseconds (1000);
    ``filespertask`` (10,000)."""

    @classmethod
    def name(cls) -> str:
        return "changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> ChangeReader:
        return ChangeReader(dict(self.options))


def changed_files(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """A stream of (root, path, size, ts): files below ``path`` as they change."""
    spark.dataSource.register(ChangeSource)
    return spark.readStream.format("changes").options(path=path, **options).load()
