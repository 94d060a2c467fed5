"""Integrity and repair: calibrating, healing, verifying and collecting garbage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.operators.reconcile import joined, usable

# Fixed value: the 128-bit XXH3 of no bytes, which no file's hash may be.
EMPTY_HASH = "99aa06d3014798d86001c324468d497f"
DAY = 86_400


def calibrate(remote: DataFrame, local: DataFrame, base: DataFrame) -> DataFrame:
    """Delta rows for paths on both sides: a zero remote mtime is filled in,
    and an incomplete row is linked and marked synced if its hash is usable.

    ``calibrated`` counts the steps (a row may take both).
    """
    both = joined(remote, local, base).where(F.col("r").isNotNull() & F.col("l").isNotNull())
    old, linked = F.col("b").isNotNull(), usable(F.col("b.file_id")).isNotNull()
    fills = F.coalesce(old & linked & (F.col("b.local_mtime") > 0) & (F.col("b.cloud_mtime") == 0) & (F.col("r.mtime") > 0), F.lit(False))
    settled = F.coalesce(F.col("b.content_hash").isNotNull() | (F.col("b.last_sync_at") > 0), F.lit(False))
    good = usable(F.col("l.local_hash")).isNotNull() & (F.col("l.local_hash") != EMPTY_HASH)
    links = F.when(fills, ~settled & good).otherwise(~(old & linked & settled) & good)
    out = both.withColumns({"fills": fills, "links": links}).where("fills OR links")
    return out.select(
        "path",
        F.when(F.col("links"), F.col("r.id")).otherwise(F.col("b.file_id")).alias("file_id"),
        F.col("r.mtime").alias("cloud_mtime"),
        F.when(F.col("links"), F.col("l.mtime")).otherwise(F.col("b.local_mtime")).alias("local_mtime"),
        F.when(F.col("links"), F.col("l.local_hash")).otherwise(F.col("b.content_hash")).alias("content_hash"),
        (F.col("fills").cast("int") + F.col("links").cast("int")).alias("calibrated"),
    )


def heal_baseline(remote: DataFrame, base: DataFrame) -> DataFrame:
    """Repairs of synced rows: another id is relinked, else a remote mtime that
    is ahead of the listing is taken back."""
    both = base.where("last_sync_at > 0").join(remote.select("path", "id", F.col("mtime").alias("remote_mtime")), "path")
    relink = (F.col("file_id") != "") & (F.col("file_id") != F.col("id"))
    issue = F.when(relink, "relink").when(F.col("cloud_mtime") > F.col("remote_mtime"), "ahead")
    return both.withColumn("issue", issue).where("issue IS NOT NULL").select("path", "issue", F.when(relink, F.col("id")).otherwise(F.col("file_id")).alias("file_id"), F.col("remote_mtime").alias("cloud_mtime"))


def rebuild(remote: DataFrame, local: DataFrame, base: DataFrame) -> DataFrame:
    """A new baseline from both listings; a stored hash is kept only where both mtimes still match."""
    rows = joined(remote, local, base).where(F.col("r").isNotNull() | F.col("l").isNotNull())
    same = F.coalesce((F.col("b.cloud_mtime") == F.col("r.mtime")) & (F.col("b.local_mtime") == F.col("l.mtime")), F.lit(False))
    return rows.select("path", F.coalesce("r.id", F.lit("")).alias("file_id"), F.coalesce("r.mtime", F.lit(0).cast("long")).alias("cloud_mtime"), F.coalesce("l.mtime", F.lit(0).cast("long")).alias("local_mtime"), F.when(same, F.col("b.content_hash")).alias("content_hash"), same.alias("reused"))


def verify(local: DataFrame, base: DataFrame, dirs: DataFrame | None = None, local_dirs: DataFrame | None = None) -> DataFrame:
    """path and issue: linked rows without a file, hash mismatches, directories without a folder."""
    both = base.join(local.select("path", "local_hash"), "path", "left")
    missing = F.col("local_hash").isNull() & (F.col("file_id") != "")
    differs = usable(F.col("content_hash")) != usable(F.col("local_hash"))
    out = both.withColumn("issue", F.when(missing, "missing_file").when(differs, "hash_mismatch")).where("issue IS NOT NULL").select("path", "issue")
    if dirs is not None and local_dirs is not None:
        out = out.unionByName(dirs.select("path").join(local_dirs.select("path"), "path", "left_anti").withColumn("issue", F.lit("missing_dir")))
    return out


def fixes(issues: DataFrame) -> DataFrame:
    """What each issue asks for."""
    return issues.withColumn("fix", F.when(F.col("issue") == "hash_mismatch", "rehash").otherwise("remove_row"))


def drift(local: DataFrame, base: DataFrame) -> DataFrame:
    """path and repair: orphans (neither linked nor on disk), mtimes that moved
    under an unchanged hash, hashes to fill in."""
    both = base.join(local.select("path", "mtime", "local_hash"), "path", "left")
    there = F.col("mtime").isNotNull()
    no_hash = usable(F.col("content_hash")).isNull() | (F.col("content_hash") == EMPTY_HASH)
    repair = (
        F.when(~there & (F.col("file_id") == ""), "orphan")
        .when(there & (F.col("mtime") != F.col("local_mtime")) & (F.col("local_hash") == F.col("content_hash")), "mtime")
        .when(there & (F.col("file_id") != "") & (F.col("mtime") == F.col("local_mtime")) & no_hash, "hash")
    )
    return both.withColumn("repair", repair).where("repair IS NOT NULL").select("path", "repair")


def gc_counts(base: DataFrame, local: DataFrame, log: DataFrame, refs: DataFrame, now: int, keep_days: int = 30, keep_log_days: int = 90) -> DataFrame:
    """One row: how many rows each retention rule removes."""
    old = base.where((F.col("last_sync_at") > 0) & (F.col("last_sync_at") < now - keep_days * DAY)).join(local, "path", "left_anti").agg(F.count("*").alias("files"))
    late = log.agg(F.count_if(F.col("timestamp") < now - keep_log_days * DAY).alias("log_rows"))
    loose = refs.join(local.select(F.col("path").alias("source_path")), "source_path", "left_anti").agg(F.count("*").alias("refs"))
    return old.join(late).join(loose)


def gc_rows(base: DataFrame, local: DataFrame, log: DataFrame, refs: DataFrame, now: int, keep_days: int = 30, keep_log_days: int = 90) -> DataFrame:
    """kind, key: what each retention rule removes."""
    old = base.where((F.col("last_sync_at") > 0) & (F.col("last_sync_at") < now - keep_days * DAY)).join(local, "path", "left_anti")
    late = log.where(F.col("timestamp") < now - keep_log_days * DAY)
    loose = refs.join(local.select(F.col("path").alias("source_path")), "source_path", "left_anti")
    row = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), key.cast("string").alias("key"))
    return row(old, "file", F.col("path")).unionByName(row(late, "log", F.col("id"))).unionByName(row(loose, "reference", F.col("source_path")))


def cache_counts(base: DataFrame, local: DataFrame) -> DataFrame:
    """One row of counts over the baseline beside what is on disk."""
    both = base.join(local.select("path", F.lit(True).alias("there")), "path", "left")
    no_hash = usable(F.col("content_hash")).isNull()
    return both.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("file_id") != "").alias("linked"),
        F.count_if(F.col("file_id") == "").alias("unlinked"),
        F.count_if(no_hash).alias("without_hash"),
        F.count_if(F.col("cloud_mtime") == 0).alias("zero_cloud_mtime"),
        F.count_if(F.col("there").isNull()).alias("not_on_disk"),
    )


def cached_hashes(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files with the hash remembered for the same path, mtime and size, if any."""
    return files.join(cache, ["path", "mtime", "size"], "left")
