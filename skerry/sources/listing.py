"""A paged remote listing as a Spark data source, and its stop rules.

``spark.read.format("listing")`` deals lanes of the folders' pages out to
partitions and asks a fetcher for them.  A fetcher is any importable
``function(path, dir_id, start) -> dict`` that returns a page (``entries``,
``count``) or raises; :func:`stored_page` reads pages from files.  What ends a
listing is decided afterwards, in :func:`listed`, by expressions over all pages
of a folder, so that lanes need not wait for each other.  A lane stops at a page
that ends the listing, so a folder costs as many requests as it has pages, and one
more for each lane, however many pages a listing may have.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

ENTRY = "struct<id:string,name:string,is_dir:boolean,mtime:bigint,ctime:bigint,domain:int>"
PAGE = f"dir_id string, page int, start bigint, total bigint, error string, entries array<{ENTRY}>"
_ENTRY = pa.struct([("id", pa.string()), ("name", pa.string()), ("is_dir", pa.bool_()), ("mtime", pa.int64()), ("ctime", pa.int64()), ("domain", pa.int32())])
_PAGE = pa.schema([("dir_id", pa.string()), ("page", pa.int32()), ("start", pa.int64()), ("total", pa.int64()), ("error", pa.string()), ("entries", pa.list_(_ENTRY))])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def stored_page(path: str, dir_id: str, start: int) -> dict:
    """A page from ``path/dir=<dir_id>/start=<start>/``; beyond the last, an empty one."""
    disk, root = _open(path)
    files = disk.get_file_info(fs.FileSelector(f"{root}/dir={dir_id}/start={start}", allow_not_found=True))
    parts = [f for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    if not parts:
        return {"entries": [], "count": 0}
    with disk.open_input_stream(parts[0].path) as stream:
        return json.loads(stream.read())


def stored_folders(path: str) -> list[str]:
    """The folders that have pages in ``path``."""
    disk, root = _open(path)
    return sorted(f.base_name.removeprefix("dir=") for f in disk.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory and f.base_name.startswith("dir="))


def _number(value: object) -> int | None:
    return int(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def _entry(raw: object) -> dict:
    e = raw.get("fileEntry") if isinstance(raw, dict) else None
    e = e if isinstance(e, dict) else {}
    id_ = e.get("id")
    text = lambda v: v if isinstance(v, str) else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else ""
    return {"id": text(id_), "name": text(e.get("name")), "is_dir": bool(e.get("dir")), "mtime": _number(e.get("modifyTimeForSort")) or 0, "ctime": _number(e.get("createTimeForSort")) or 0, "domain": _number(e.get("domain"))}


class Pages(InputPartition):
    """Lanes (number, its folders) that one task fetches."""

    def __init__(self, lanes: list[tuple[int, list[str]]]):
        self.lanes = lanes


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.mode = options["path"], options.get("mode", "PERMISSIVE").upper()
        self.size, self.most, self.range, self.tasks, self.lanes = (int(options.get(k, d)) for k, d in (("pagesize", 100), ("mostpages", 50), ("rangepages", 10), ("tasks", 200), ("lanes", 5)))
        self.fetcher, self.root = options.get("fetcher", f"{__name__}:stored_page"), options.get("root")
        self.dirs = json.loads(options["dirs"]) if "dirs" in options else None
        if self.mode not in ("PERMISSIVE", "FAILFAST"):
            raise ValueError(f"mode {self.mode}: PERMISSIVE or FAILFAST")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A folder asked for by id is the only one fetched."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("dir_id",):
                self.dirs = [d for d in (self.dirs if self.dirs is not None else [f.value]) if d == f.value]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        dirs = self.dirs if self.dirs is not None else stored_folders(self.path)
        lanes = min(self.lanes, -(-self.most // self.range))
        tasks = min(self.tasks, len(dirs) * lanes)
        return [Pages([(n, dirs[(k - n) % tasks :: tasks]) for n in range(lanes)]) for k in range(tasks)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        module, _, name = self.fetcher.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        for lane, dirs in partition.lanes:
            for dir_id in dirs:
                yield from self._lane(fetch, dir_id, lane)

    def _lane(self, fetch: Callable[[str, str, int], dict], dir_id: str, lane: int) -> Iterator[pa.RecordBatch]:
        """Every so many ranges of a folder's pages, up to one that ends the listing."""
        known: list[set[str]] = []  # ids of the lane's first page and of the one before
        step = min(self.lanes, -(-self.most // self.range)) * self.range
        for page in (p for first in range(lane * self.range, self.most, step) for p in range(first, min(first + self.range, self.most))):
            start = page * self.size
            try:
                data = fetch(self.path, dir_id, start)
                raw, error = data.get("entries"), None
            except Exception as e:  # what a fetcher raises is the remote side's failure
                if self.mode == "FAILFAST" or dir_id == self.root:
                    raise
                data, raw, error = {}, [], f"{type(e).__name__}: {e}"
            entries = [_entry(x) for x in raw] if isinstance(raw, list) else []
            row = {"dir_id": dir_id, "page": page, "start": start, "total": _number(data.get("count")) or 0, "error": error, "entries": entries}
            yield pa.RecordBatch.from_pylist([row], schema=_PAGE)
            ids = {e["id"] for e in entries if e["id"]}
            if error is not None or len(entries) < self.size or not ids or any(ids <= old for old in known):
                return  # every rule ends the listing here, too
            known = [*known[:1], ids]


class ListingSource(DataSource):
    """Options: ``path``; ``pagesize`` (100), ``mostpages`` of a folder (50),
    ``rangepages`` that are fetched one after another (10); ``lanes`` (5), which take
    a folder's ranges in turn, each until a page ends the listing, dealt out to
    ``tasks`` partitions (200); ``dirs`` (a JSON list; all stored ones);
    ``mode`` for a folder that fails: FAILFAST, or PERMISSIVE (it has no entries);
    ``root``, a folder that must not fail; ``fetcher`` (module:function)."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema: object) -> ListingReader:
        return ListingReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ListingSource)


def read_pages(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    register(spark)
    return spark.read.format("listing").options(path=path, **options).load()


def listed(pages: DataFrame, size: int = 100) -> DataFrame:
    """dir_id, and the entries of each folder's listing, each id once.

    A listing ends with its first page that is empty, has no new id, is shorter
    than ``size``, or completes the folder's ``total``; pages beyond it don't
    count.  A folder with a failed page before that end has no entries.  An entry
    without an id is none; an id's first place counts.  An entry occurs in few
    pages, so the shuffles are by (folder, id) and (folder, page).
    """
    entry = pages.select("dir_id", "page", F.posexplode("entries").alias("place", "e")).where("e.id <> ''")
    first = entry.groupBy("dir_id", F.col("e.id").alias("id")).agg(F.min(F.struct("page", "place", "e")).alias("f")).select("dir_id", "id", F.col("f.page").alias("page"), F.col("f.e").alias("e"))
    fresh = first.groupBy("dir_id", "page").agg(F.count("*").alias("fresh"))
    upto = Window.partitionBy("dir_id").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # mostpages rows a folder
    counted = pages.select("dir_id", "page", "total", "error", F.size("entries").alias("n")).join(fresh, ["dir_id", "page"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(0)))
    so_far = counted.withColumn("known", F.sum("fresh").over(upto))
    ends = F.col("error").isNotNull() | (F.col("fresh") == 0) | (F.col("n") < size) | (F.col("known") >= F.col("total"))
    cut = so_far.groupBy("dir_id").agg(F.coalesce(F.min(F.when(ends, F.col("page"))), F.max("page")).alias("last"), F.min(F.when(F.col("error").isNotNull(), F.col("page"))).alias("failed"))
    good = cut.where(F.col("failed").isNull() | (F.col("failed") > F.col("last"))).select("dir_id", "last")
    return first.join(good, "dir_id").where(F.col("page") <= F.col("last")).select("dir_id", "e.*")


def failures(pages: DataFrame) -> DataFrame:
    """dir_id, error of each folder's first failed page."""
    return pages.where("error IS NOT NULL").groupBy("dir_id").agg(F.min_by("error", "page").alias("error"))


def scan(spark: SparkSession, path: str, root: str, **options: str | int) -> DataFrame:
    """Every file and folder below ``root`` (id, parent_id, name, is_dir, times,
    domain, path, depth), from all stored folders at once.

    Folders are listed in parallel and put together afterwards by
    :func:`skerry.operators.trees.tree_paths`, so the number of rounds is the
    logarithm of the depth instead of one for each level.  An empty ``root`` is an
    error, as is a failure of the root's listing.  Hidden names, and all below
    them, are left out.
    """
    from skerry.functions.names import map_remote_name
    from skerry.operators.trees import tree_paths
    from skerry.sources.staging import written

    if not root:
        raise ValueError("a scan needs a root")
    size = int(options.get("pagesize", 100))
    pages = written(read_pages(spark, path, root=root, **options), "pages")
    rows = written(listed(pages, size).withColumnRenamed("dir_id", "parent_id").where(~F.col("name").startswith(".")), "listed")
    label = F.when(F.col("is_dir"), F.col("name")).otherwise(map_remote_name("name"))
    top = spark.createDataFrame([(root, None, "")], "id string, parent_id string, name string")
    nodes = rows.select("id", "parent_id", label.alias("name")).unionByName(top)
    placed = tree_paths(nodes).where("depth > 0").withColumn("path", F.expr("substr(path, 2)"))
    return rows.join(placed, "id")
