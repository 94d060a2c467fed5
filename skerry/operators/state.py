"""The baseline as a table: deltas applied by a keyed full outer join, plus retention.

Each function takes tables and returns the new table (or the delta); writing it
is the caller's, so that computing and applying stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators.reconcile import usable

BASE = ("file_id", "cloud_mtime", "local_mtime", "content_hash", "cloud_content_hash", "last_sync_at", "parent_id", "domain", "create_time")
_DEFAULTS = {"file_id": "", "cloud_mtime": 0, "local_mtime": 0, "last_sync_at": 0, "domain": 1, "create_time": 0}


def _merge(base: DataFrame, delta: DataFrame, update: dict[str, Column], insert: dict[str, Column]) -> DataFrame:
    b = base.select("path", F.struct(*BASE).alias("b"))
    d = delta.select("path", F.struct(*(c for c in delta.columns if c != "path")).alias("d"))
    both = b.join(d, "path", "full")
    value = lambda c: F.when(F.col("d").isNull(), F.col(f"b.{c}")).when(F.col("b").isNull(), insert[c]).otherwise(update[c]).alias(c)
    return both.select("path", *(value(c) for c in BASE))


def _new(c: str) -> Column:
    return F.coalesce(F.col(f"d.{c}"), F.lit(_DEFAULTS[c])) if c in _DEFAULTS else F.col(f"d.{c}")


def upsert(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Ids and mtimes are replaced; hashes, parent and domain only by values;
    create_time and last_sync_at only by positive ones."""
    update = {c: _new(c) for c in ("file_id", "cloud_mtime", "local_mtime")}
    update |= {c: F.coalesce(f"d.{c}", f"b.{c}") for c in ("content_hash", "cloud_content_hash", "parent_id", "domain")}
    update |= {c: F.when(F.col(f"d.{c}") > 0, F.col(f"d.{c}")).otherwise(F.col(f"b.{c}")) for c in ("create_time", "last_sync_at")}
    return _merge(base, delta, update, {c: _new(c) for c in BASE})


def cache_remote(base: DataFrame, remote: DataFrame) -> DataFrame:
    """Takes a listing in without touching what was synced: a synced row keeps
    its remote mtime unless its id changed, and local fields stay."""
    delta = remote.select("path", F.col("id").alias("file_id"), F.col("mtime").alias("cloud_mtime"), "parent_id", "domain", F.col("ctime").alias("create_time"))
    keep = (F.col("b.last_sync_at") > 0) & (F.col("b.file_id") == F.col("d.file_id"))
    update = {c: F.col(f"b.{c}") for c in BASE} | {"file_id": F.col("d.file_id"), "cloud_mtime": F.when(keep, F.col("b.cloud_mtime")).otherwise(F.col("d.cloud_mtime"))}
    update |= {c: F.coalesce(f"d.{c}", f"b.{c}") for c in ("parent_id", "domain")}
    update["create_time"] = F.when(F.col("d.create_time") > 0, F.col("d.create_time")).otherwise(F.col("b.create_time"))
    insert = {"file_id": F.col("d.file_id"), "cloud_mtime": F.col("d.cloud_mtime"), "local_mtime": F.lit(0).cast("long"), "content_hash": F.lit(None).cast("string"), "cloud_content_hash": F.lit(None).cast("string"), "last_sync_at": F.lit(0).cast("long"), "parent_id": F.col("d.parent_id"), "domain": F.coalesce("d.domain", F.lit(1)), "create_time": F.coalesce("d.create_time", F.lit(0).cast("long"))}
    return _merge(base, delta, update, insert)


def rename(keyed: DataFrame, renames: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Rewrites ``path`` by ``renames`` (path, new_path); a row whose new path is
    already taken is dropped."""
    taken = (existing if existing is not None else keyed).select(F.col("path").alias("new_path"), F.lit(True).alias("taken")).distinct()
    out = keyed.join(renames, "path", "left").join(taken, "new_path", "left").where(F.col("new_path").isNull() | F.col("taken").isNull())
    one = Window.partitionBy(F.coalesce("new_path", "path")).orderBy("path")
    out = out.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    return out.select(F.coalesce("new_path", "path").alias("path"), *(c for c in keyed.columns if c != "path"))


def replace_refs(refs: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges (source_path, ref_path): all edges of each source in ``changed`` are replaced."""
    return refs.join(changed.select("source_path").distinct(), "source_path", "left_anti").unionByName(changed).distinct()


def last_writer_wins(table: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    return table.join(delta.select(key), key, "left_anti").unionByName(delta, allowMissingColumns=True)


def stale(base: DataFrame, cutoff: int) -> DataFrame:
    """Paths that were synced, but not since ``cutoff``."""
    return base.where((F.col("last_sync_at") > 0) & (F.col("last_sync_at") < cutoff)).select("path")


def not_active(base: DataFrame, *active: DataFrame) -> DataFrame:
    """Baseline paths that no given snapshot has."""
    out = base.select("path")
    for snapshot in active:
        out = out.join(snapshot.select("path"), "path", "left_anti")
    return out


def linked(base: DataFrame) -> DataFrame:
    return base.where(usable(F.col("file_id")).isNotNull())


def log_tail(log: DataFrame, limit: int = 0, path: str | None = None) -> DataFrame:
    """Newest log rows first; 0 is no limit."""
    out = log if path is None else log.where(F.col("path") == path)
    out = out.orderBy(F.desc("id"))
    return out.limit(limit) if limit else out


def log_after(log: DataFrame, cutoff: int) -> DataFrame:
    """The log without rows older than ``cutoff`` seconds."""
    return log.where(F.col("timestamp") >= cutoff)
