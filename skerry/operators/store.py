"""Stored tables beside the baseline: folders, base contents, scans, versions.

As in :mod:`skerry.operators.state`, each function takes tables and returns the
new table or rows to append; writing is the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions.names import cached_name, extension, is_conflict, join_path, map_remote_name, seconds
from skerry.operators.reconcile import usable
from skerry.operators.state import cache_remote, last_writer_wins, linked, upsert
from skerry.sources.staging import numbered
from skerry.streaming.feed import is_usable

DIRS = ("path", "dir_id", "parent_id")


def set_dirs(dirs: DataFrame, delta: DataFrame) -> DataFrame:
    """Folders (path, dir_id, parent_id), replaced by path; a folder needs an id."""
    return last_writer_wins(dirs, delta.where("dir_id <> ''").select(*DIRS), "path")


def new_dirs(dirs: DataFrame, listed: DataFrame) -> DataFrame:
    """Folders of a listing that aren't stored yet, to be calibrated: each counts once."""
    known = dirs.where("dir_id <> ''").select("path")
    return listed.where("dir_id <> ''").join(known, "path", "left_anti").select(*DIRS)


def save_base(contents: DataFrame, delta: DataFrame) -> DataFrame:
    """Base contents for merging (path, content, content_hash), replaced by path."""
    return last_writer_wins(contents, delta.select("path", "content", "content_hash"), "path")


def base_content(contents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Base content of each wanted path (null without one)."""
    return wanted.select("path").join(contents.select("path", "content", "content_hash"), "path", "left")


def record_sync(base: DataFrame, done: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(baseline, log rows) after actions: done has the baseline's columns and
    action, direction, old_hash."""
    fields = [c for c in done.columns if c not in ("action", "direction", "old_hash", "last_sync_at")]
    synced = upsert(base, done.select(*fields, F.lit(now).cast("long").alias("last_sync_at")))
    log = done.where("action IS NOT NULL").select(F.lit(now).cast("long").alias("timestamp"), "path", "action", "direction", "old_hash", F.col("content_hash").alias("new_hash"), F.col("file_id").alias("cloud_id"))
    return synced, log


def original_domain(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """(path, original_domain): a delta fills only what is missing."""
    return stored.join(delta.select("path", F.col("original_domain").alias("_new")), "path", "left").select("path", F.coalesce("original_domain", "_new").alias("original_domain"))


def set_fields(base: DataFrame, delta: DataFrame, *fields: str) -> DataFrame:
    """Point updates by path: the fields of ``delta`` replace those of existing rows."""
    changed = delta.select("path", F.struct(*fields).alias("_d"))
    rows = base.join(changed, "path", "left")
    value = lambda c: F.when(F.col("_d").isNotNull(), F.col(f"_d.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
    return rows.select(*(value(c) for c in base.columns))


def save_scan(base: DataFrame, dirs: DataFrame, state: DataFrame, listed: DataFrame, version: int, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(baseline, folders, state) after a whole scan: listed rows have is_dir;
    state (key, value) gets the version and both times."""
    files = cache_remote(base, listed.where(~F.col("is_dir")))
    folders = set_dirs(dirs, listed.where("is_dir").select("path", F.col("id").alias("dir_id"), "parent_id"))
    spark = listed.sparkSession
    keys = spark.createDataFrame([("cloud_version", str(version)), ("last_scan_time", str(now)), ("last_full_scan", str(now))], "key string, value string")
    return files, folders, last_writer_wins(state, keys, "key")


def cached_listing(base: DataFrame, dirs: DataFrame) -> DataFrame:
    """The remote listing as stored: linked files that aren't conflict copies, and
    folders whose path isn't a file."""
    files = linked(base).where(~is_conflict("path")).select("path", F.col("file_id").alias("id"), "parent_id", cached_name("path", "domain").alias("name"), F.col("cloud_mtime").alias("mtime"), F.col("create_time").alias("ctime"), "domain", F.lit(False).alias("is_dir"))
    folders = dirs.join(files.select("path"), "path", "left_anti").select("path", F.col("dir_id").alias("id"), "parent_id", F.substring_index("path", "/", -1).alias("name"), F.lit(0).cast("long").alias("mtime"), F.lit(0).cast("long").alias("ctime"), F.lit(1).alias("domain"), F.lit(True).alias("is_dir"))
    return files.unionByName(folders)


def scan_phase(live: DataFrame, base: DataFrame, dirs: DataFrame, full: bool, allowed: Column | None = None) -> DataFrame:
    """The listing a sync works on: the live one after a full scan, else the stored one."""
    rows = live if full else cached_listing(base, dirs)
    return rows if allowed is None else rows.where(allowed | F.col("is_dir"))


def replace_listing(stored: DataFrame, live: DataFrame) -> DataFrame:
    """The live listing, unless it is empty or lost more than half of the stored
    one: then an error, before anything is replaced."""
    now, prior = live.count(), stored.count()
    if not is_usable(now, prior):
        raise ValueError(f"live listing of {now} rows against {prior}")
    return live


def current_cache(cache: DataFrame, stored_version: str, version: str) -> DataFrame:
    """The hash cache; nothing of it after a change of the algorithm's version."""
    return cache.where(F.lit(stored_version == version))


def local_collisions(files: DataFrame) -> DataFrame:
    """One file for each mapped path of (folder, name, mtime, size): Markdown before
    other files, those before notes and clips, then the later name."""
    rank = F.when(extension("name") == "md", 2).when(extension("name").isin("note", "clip"), 0).otherwise(1)
    rows = files.withColumn("path", join_path("folder", map_remote_name("name")))
    best = F.max_by(F.struct("name", "mtime", "size"), F.struct(rank, "name"))
    return rows.groupBy("path").agg(best.alias("b")).select("path", "b.*")


def import_folders(books: DataFrame, paths: DataFrame) -> DataFrame:
    """Folders of another program's table: books (id, parent_id), paths (id, path)."""
    rows = paths.where("path <> ''").join(books.select("id", "parent_id"), "id", "left")
    return rows.select("path", F.col("id").alias("dir_id"), F.coalesce("parent_id", F.lit("")).alias("parent_id"))


def import_notes(notes: DataFrame, paths: DataFrame) -> DataFrame:
    """Baseline rows of another program's notes: (id, title, parent_id, modified,
    created, domain, deleted, is_dir), under their folders' paths."""
    live = notes.where("NOT deleted AND NOT is_dir")
    rows = live.join(paths.select(F.col("id").alias("parent_id"), F.col("path").alias("folder")), "parent_id", "left")
    return rows.select(join_path(F.coalesce("folder", F.lit("")), map_remote_name(F.coalesce("title", F.lit("")))).alias("path"), F.col("id").alias("file_id"), seconds("modified").alias("cloud_mtime"), F.lit(0).cast("long").alias("local_mtime"), "parent_id", "domain", seconds("created").alias("create_time"))


def seed(base: DataFrame, notes: DataFrame, paths: DataFrame) -> DataFrame:
    """Cold start: an empty baseline takes the imported notes, another one stays."""
    some = base.agg((F.count("*") == 0).alias("_empty"))  # one row
    rows = import_notes(notes, paths)
    return rows.join(F.broadcast(some.where("_empty").select(F.lit(1).alias("_one"))), how="left_semi", on=F.col("_one") == 1)


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """Kept versions in a folder: version (numeric file names), size, content."""
    rows = spark.read.format("binaryFile").load(folder).withColumn("version", F.substring_index("path", "/", -1).try_cast("long"))
    return rows.where("version IS NOT NULL").select("version", F.col("length").alias("size"), "content")


def richest(versions_: DataFrame, *keys: str) -> DataFrame:
    """The largest version (the first of equal ones)."""
    return versions_.groupBy(*keys).agg(F.max_by("version", F.struct("size", -F.col("version"))).alias("version"), F.max("size").alias("size")).where("version IS NOT NULL")


def linked_twin(base: DataFrame) -> DataFrame:
    """path, twin: for each row, the first other linked row with its usable hash.

    Two least paths of each hash are enough, so there is no self-join of rows.
    """
    rows = base.where(usable(F.col("content_hash")).isNotNull()).select("path", "content_hash", (F.col("file_id") != "").alias("linked"))
    first = rows.where("linked").groupBy("content_hash").agg(F.min("path").alias("one"))
    second = rows.where("linked").join(first, "content_hash").where("path > one").groupBy("content_hash").agg(F.min("path").alias("two"))
    both = first.join(second, "content_hash", "left")
    return rows.join(both, "content_hash").select("path", F.when(F.col("path") == F.col("one"), F.col("two")).otherwise(F.col("one")).alias("twin")).where("twin IS NOT NULL")


def cached_refs(current: DataFrame, cache: DataFrame) -> DataFrame:
    """path, use_cache: whether stored references are of the file's present mtime."""
    return current.select("path", "mtime").join(cache.select("path", F.col("mtime").alias("_m")).distinct(), "path", "left").groupBy("path").agg(F.coalesce(F.bool_or(F.col("_m") == F.col("mtime")), F.lit(False)).alias("use_cache"))


def merge_wanted(listing: DataFrame, listed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (path, id, name, mtime) that a later listing adds or changes among the
    wanted paths: the preferred one of both, if its id or name is new."""
    from skerry.sources.readers import preferred

    new = listed.join(wanted.select("path"), "path", "left_semi").select("path", "id", "name", "mtime")
    old = listing.join(new.select("path").distinct(), "path", "left_semi").select("path", "id", "name", "mtime")
    best = preferred(old.unionByName(new))
    same = [best[c].eqNullSafe(old[c]) for c in ("path", "id", "name")]
    return best.join(old, same[0] & same[1] & same[2], "left_anti")


def fallback_deletes(failed: DataFrame, uploaded: DataFrame) -> DataFrame:
    """Old ids of failed moves (old_path, new_path, file_id) whose new path was uploaded after all."""
    return failed.join(uploaded.select(F.col("path").alias("new_path")), "new_path", "left_semi").select("old_path", "file_id")


def retries(merged: DataFrame) -> DataFrame:
    """Clean merges whose upload failed: recorded under the hash before, so that
    the next run sees a local change and uploads again."""
    failed = ~F.col("uploaded")
    return merged.select("path", F.when(failed, F.col("previous_hash")).otherwise(F.col("merged_hash")).alias("content_hash"), F.when(failed, "merge-upload-deferred").otherwise("merge").alias("action"))


def append_log(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with rows appended under the next ids, in the order of time and path."""
    last = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))  # one row
    new = numbered(rows.withColumn("_log", F.lit(0)), ["_log"], ["timestamp", "path"])
    return log.unionByName(new.crossJoin(F.broadcast(last)).withColumn("id", (F.col("_last") + F.col("n")).cast("long")).select(*log.columns))


def remove(table: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    """A keyed table without the given keys."""
    return table.join(gone.select(key), key, "left_anti")


def rewrite_paths(table: DataFrame, new: Column) -> tuple[DataFrame, DataFrame]:
    """(table under rewritten paths, one row: renamed and whether the version restarts).

    Of rows that come to one path the one that had it stays, else the first by
    its old path; any rename sets the stored version back to 0.
    """
    rows = table.withColumn("_new", new)
    changed = F.col("_new") != F.col("path")
    kept = rows.groupBy("_new").agg(F.min(F.struct(changed.alias("moved"), "path"))["path"].alias("_kept"))
    out = rows.join(kept, "_new").where(F.col("path") == F.col("_kept"))
    renamed = rows.agg(F.count_if(changed).alias("renamed")).select("renamed", (F.col("renamed") > 0).alias("restart"))
    return out.select(F.col("_new").alias("path"), *(c for c in table.columns if c != "path")), renamed


def filter_listing(listed: DataFrame, allowed: Column) -> DataFrame:
    """A listing's allowed rows without conflict copies; folders stay."""
    return listed.where(F.col("is_dir") | (allowed & ~is_conflict("path")))


def confirmed_parents(wanted: DataFrame, tree: DataFrame) -> DataFrame:
    """path, confirmed: whether walking the tree (id, path) to a parent's path ends at its listed id."""
    at = wanted.join(tree.select(F.col("path").alias("parent"), F.col("id").alias("_found")), "parent", "left")
    return at.select("path", F.coalesce(F.col("_found") == F.col("parent_id"), F.col("parent") == "").alias("confirmed"))


def dedup_inputs(local: DataFrame, hashes: DataFrame, base: DataFrame) -> DataFrame:
    """path, hash, size, file_id, create_time of local files, for finding duplicates."""
    rows = local.select("path", "size").join(hashes.select("path", "hash"), "path", "left").join(base.select("path", "file_id", "create_time"), "path", "left")
    return rows.select("path", F.coalesce("hash", F.lit("")).alias("hash"), "size", F.coalesce("file_id", F.lit("")).alias("file_id"), F.coalesce("create_time", F.lit(0).cast("long")).alias("create_time"))
