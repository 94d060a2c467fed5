"""Kept versions and desktop files, which lie in folders by id.

``<folder>/<id>/<version>`` are gzipped notes; what is to be read is chosen from
names and sizes alone, then each task opens its files and unpacks them in a
stream, one at a time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions.names import col

_NUMBER = re.compile("[0-9]{1,18}$")
_VERSION = pa.schema([("file_id", pa.string()), ("version", pa.int64()), ("size", pa.int64()), ("path", pa.string())])
_TEXT = pa.schema([("path", pa.string()), ("content", pa.binary())])


def list_versions(spark: SparkSession, folder: str) -> DataFrame:
    """file_id, version, size, path of the versions below ``folder``; only numbers are
    versions.  One task names the folders, all of them list what is in them; nothing
    of it goes through the driver."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            disk, root = fs.FileSystem.from_uri(folder)
            names = [f.base_name for f in disk.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory and not f.base_name.startswith(("_", "."))]
            for i in range(0, len(names), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 10_000], pa.string())], ["file_id"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = [(d, int(f.base_name), f.size, f"{folder}/{d}/{f.base_name}") for d in batch.column(0).to_pylist() for f in disk.get_file_info(fs.FileSelector(f"{root}/{d}")) if f.type == fs.FileType.File and _NUMBER.match(f.base_name)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_VERSION)], schema=_VERSION)

    folder = folder.rstrip("/") if "://" in folder or folder.startswith("file:") else f"file://{folder.rstrip('/')}"
    folders = spark.range(1, numPartitions=1).mapInArrow(named, "file_id string")
    return folders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(listed, "file_id string, version long, size long, path string")


def richest(versions: DataFrame) -> DataFrame:
    """Each file's largest version, the earliest of equal ones."""
    best = F.max_by(F.struct("version", "size", "path"), F.struct("size", -F.col("version")))
    return versions.groupBy("file_id").agg(best.alias("v")).select("file_id", "v.*")


def desktop_path(folder: str, file_id: Column | str) -> Column:
    """Where the desktop keeps a file: by the lower-cased first character of its id."""
    id_ = col(file_id)
    return F.when(id_ != "", F.concat(F.lit(folder.rstrip("/") + "/file/"), F.lower(F.substring(id_, 1, 1)), F.lit("/"), id_))


def contents(files: DataFrame, packed: bool = True) -> DataFrame:
    """``files`` (path and more) with ``content``: the bytes of each file, unpacked if
    ``packed``; null for a file that is missing or damaged."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            data = _content(path, packed)
            held.append((path, data))
            size += len(data or b"") + 100
            if size > 1 << 22:
                yield _batch(held)
                held, size = [], 0
        yield _batch(held)

    def _batch(rows: list[tuple[str, bytes | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_TEXT)], schema=_TEXT)

    wanted = files.where("path IS NOT NULL").select("path").distinct()
    return files.join(wanted.mapInArrow(read, "path string, content binary"), "path", "left")


def _content(path: str, packed: bool) -> bytes | None:
    try:
        disk, at = fs.FileSystem.from_uri(path if path.startswith("file:") or "://" in path else f"file://{path}")
        unpack, out = zlib.decompressobj(47), []
        with disk.open_input_stream(at, compression=None) as stream:
            while piece := stream.read(1 << 20):
                out.append(unpack.decompress(piece) if packed else piece)
        if packed and not unpack.eof:
            return None
        return b"".join(out)
    except (FileNotFoundError, zlib.error, IsADirectoryError):
        return None
