"""Trees: parent pointers to paths, listings, search, and hashes of directories."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.names import basename, dirname
from skerry.sources.staging import written


def tree_paths(nodes: DataFrame, most: int | None = 50) -> DataFrame:
    """id, path, depth of every node (id, parent_id, name) below a root (null
    parent).  A node on or below a cycle, below a parent that isn't there, or
    deeper than ``most`` (None: any depth), has none; an id given more than once
    counts with its least parent and name.

    Pointers are doubled: after round r a folder knows what stands 2**r levels
    above it, so a chain of a million folders takes twenty rounds.  Only folders
    take part, and of those only the ones that haven't met their root.  A first
    walk, without names, tells which folders have a root; only those are walked
    again for their paths, so a cycle never makes a path grow.  Every table has a
    row for each folder, and paths grow when read, so none is broadcast.
    """
    own = nodes.groupBy("id").agg(F.min(F.struct("parent_id", "name")).alias("n")).select("id", "n.*")
    own = written(own, "nodes")
    folders = written(own.join(own.select(F.col("parent_id").alias("id")).distinct().hint("merge"), "id", "left_semi"), "folders")
    limit = folders.count() if most is None else min(most, folders.count())
    start = folders.select("id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"))
    depths = _doubled(start, limit, lambda mine, above: (mine + above).alias("depth"))
    rooted = folders.join(depths.where(F.col("depth") <= limit).select("id", "depth").hint("merge"), "id")
    names = _doubled(rooted.select("id", F.col("parent_id").alias("up"), F.col("name").alias("path")), limit, lambda mine, above: F.concat_ws("/", above, mine).alias("path"))
    placed = names.join(depths.select("id", "depth").hint("merge"), "id").select(F.col("id").alias("parent_id"), F.col("path").alias("_above"), (F.col("depth") + 1).alias("depth"))
    roots = own.where("parent_id IS NULL").select("id", F.col("name").alias("path"), F.lit(0).alias("depth"))
    below = own.join(placed.hint("merge"), "parent_id").select("id", F.concat_ws("/", "_above", "name").alias("path"), "depth")
    return roots.unionByName(below if most is None else below.where(F.col("depth") <= most))


def _doubled(table: DataFrame, limit: int, join: Callable[[Column, Column], Column]) -> DataFrame:
    """Of (id, up, value): id and the value joined along all pointers up to a root
    (null ``up``).  Rows whose pointers end nowhere, or not within ``limit`` steps, go."""
    value = table.columns[2]
    table, steps = written(table, "pointers"), 1
    while True:
        waiting = table.where("up IS NOT NULL")
        if steps > 2 * limit or waiting.isEmpty():
            return table.where("up IS NULL").drop("up")
        above = table.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col(value).alias("_above"))
        moved = waiting.join(above.hint("merge"), "up").select("id", F.col("_up").alias("up"), join(F.col(value), F.col("_above")))
        table, steps = written(table.where("up IS NULL").unionByName(moved), "pointers"), 2 * steps


def listing(paths: DataFrame, depth: int) -> DataFrame:
    """Nodes less deep than ``depth``."""
    return paths.where(F.col("depth") < depth)


def entries(listed: DataFrame, dir_id: str | None = None) -> DataFrame:
    """What a folder holds (the root's entries without ``dir_id``): id, name, is_dir,
    size and both times of listed rows, nulls as defaults."""
    here = F.col("parent_id").isNull() if dir_id is None else F.col("parent_id") == dir_id
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    return listed.where(here).select("id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("is_dir", F.lit(False)).alias("is_dir"), number("size"), number("mtime"), number("ctime"))


def search(rows: DataFrame, name: str, exact: bool = False) -> DataFrame:
    """Rows whose name equals ``name``, or contains it in any case."""
    found = F.col("name") == name if exact else F.contains(F.lower("name"), F.lit(name.lower()))
    return rows.where(found)


def lookup(rows: DataFrame, path: str, most: int = 5) -> DataFrame:
    """The row of a path or, if there is none, the first ``most`` whose path contains its stem."""
    exact = rows.where(F.col("path") == path)
    name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    near = rows.where(F.col("path").contains(name)).orderBy("path").limit(most)
    return exact.unionByName(near.join(exact.select(F.lit(1).alias("_e")).limit(1), how="left_anti", on=F.lit(True)))


def directories(files: DataFrame) -> DataFrame:
    """dir, depth of every directory above a file; the root is ''."""
    parts = F.split(dirname("path"), "/")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    own = F.when(dirname("path") == "", F.array(F.lit(""))).otherwise(F.array_union(F.array(F.lit("")), upto))
    return files.select(F.explode(own).alias("dir")).distinct().select("dir", depth_of(F.col("dir")).alias("depth"))


def depth_of(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def merkle(files: DataFrame, depths: int) -> DataFrame:
    """dir, tree_hash: md5 over each directory's children as ``name:hash``,
    sorted by name and joined by ``|``; a child without a hash is ``unknown``.

    Names are sorted as people do in any language (the root collation of Unicode:
    ``a`` before ``B``, punctuation before digits before letters), then by bytes.

    Built from the deepest directories up, one written level per depth; files
    (path, hash).  A directory's sorted children run through its digest one by
    one, so a very large directory needs no memory.
    """
    children = files.select(dirname("path").alias("dir"), basename("path").alias("name"), F.coalesce(F.nullif("hash", F.lit("")), F.lit("unknown")).alias("hash"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in batches:
            done = []
            for folder, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if folder != now:
                    if running is not None:
                        done.append((now, running.hexdigest()))
                    now, running = folder, hashlib.md5(line.encode())
                else:
                    running.update(b"|" + line.encode())
            yield _pairs(done)
        if running is not None:
            yield _pairs([(now, running.hexdigest())])

    out = None
    for depth in range(depths, -1, -1):
        here = children.where(depth_of(F.col("dir")) == depth).select("dir", F.concat("name", F.lit(":"), "hash").alias("line"), "name")
        ordered = here.repartition("dir").sortWithinPartitions("dir", F.collate("name", "UNICODE"), "name").select("dir", "line")
        level = written(ordered.mapInArrow(digest, "dir string, tree_hash string"), "merkle")
        out = level if out is None else out.unionByName(level)
        if depth:
            children = children.unionByName(level.select(dirname("dir").alias("dir"), basename("dir").alias("name"), F.col("tree_hash").alias("hash")))
    return out


def _pairs(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["dir", "tree_hash"])


def merkle_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Directories whose hash differs or that one side lacks; nothing if the roots are equal."""
    both = old.select("dir", F.col("tree_hash").alias("a")).join(new.select("dir", F.col("tree_hash").alias("b")), "dir", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    root = both.where("dir = ''").select(F.lit(True).alias("_r"))
    return both.select("dir").join(root, how="left_semi", on=F.lit(True))
