"""Completing a stored listing: feeds, live overlays, and folders of local-only files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.names import dirname, join_path, map_remote_name


def incremental(stored: DataFrame, feed: DataFrame, dirs: DataFrame) -> DataFrame:
    """Feed rows (id, name, parent_id, mtime) with a path: the stored one of the
    same id, else the parent's path and the mapped name; a row whose parent is
    unknown is dropped."""
    known = stored.select("id", F.col("path").alias("known_path"))
    parent = dirs.select(F.col("id").alias("parent_id"), F.col("path").alias("parent_path"))
    both = feed.join(known, "id", "left").join(parent, "parent_id", "left")
    path = F.coalesce("known_path", F.when(F.col("parent_path").isNotNull(), join_path("parent_path", map_remote_name("name"))))
    return both.withColumn("path", path).where("path IS NOT NULL").select("path", *feed.columns)


def overlay_mtimes(snapshot: DataFrame, recent: DataFrame) -> DataFrame:
    """The snapshot with live mtimes (id, mtime) where the id is known."""
    live = recent.groupBy("id").agg(F.max("mtime").alias("live"))
    return snapshot.join(live, "id", "left").withColumn("mtime", F.coalesce("live", "mtime")).select(*snapshot.columns)


def parent_ids(paths: DataFrame, dirs: DataFrame, remote: DataFrame, root_id: str) -> DataFrame:
    """path, parent_id by the folders' table, else by any remote sibling; '' is the root."""
    want = paths.select("path", dirname("path").alias("dir"))
    known = dirs.select(F.col("path").alias("dir"), F.col("id").alias("by_dir"))
    sibling = remote.groupBy(dirname("path").alias("dir")).agg(F.min("parent_id").alias("by_sibling"))
    return want.join(known, "dir", "left").join(sibling, "dir", "left").select("path", F.when(F.col("dir") == "", F.lit(root_id)).otherwise(F.coalesce("by_dir", "by_sibling")).alias("parent_id"))


def hydrate(local_only: DataFrame, parents: DataFrame, listed: DataFrame, remote: DataFrame) -> DataFrame:
    """path, id, status of local-only paths looked up in live listings of their folders.

    ``found`` takes the listed row; a folder that lists none of its known
    siblings isn't trusted (``blocked``); else ``absent``.
    """
    want = local_only.join(parents, "path", "left")
    live = listed.select("parent_id", join_path(F.lit(""), map_remote_name("name")).alias("name"), F.col("id").alias("listed_id"))
    siblings = remote.select(F.col("parent_id"), F.col("id"))
    seen = siblings.join(listed.select("id"), "id", "left_semi").select("parent_id").distinct().withColumn("seen", F.lit(True))
    any_known = siblings.select("parent_id").distinct().withColumn("known", F.lit(True))
    both = want.withColumn("name", F.substring_index("path", "/", -1)).join(live, ["parent_id", "name"], "left").join(seen, "parent_id", "left").join(any_known, "parent_id", "left")
    blocked = F.col("parent_id").isNull() | (F.col("known").isNotNull() & F.col("seen").isNull())
    return both.select("path", F.when(~blocked, F.col("listed_id")).alias("id"), F.when(blocked, "blocked").when(F.col("listed_id").isNotNull(), "found").otherwise("absent").alias("status"))


def upload_targets(paths: DataFrame, base: DataFrame, remote: DataFrame) -> DataFrame:
    """path, file_id, domain: the scanned row wins over the stored one, field by field."""
    r = remote.select("path", F.nullif("id", F.lit("")).alias("rid"), F.col("domain").alias("rdomain"))
    b = base.select("path", F.nullif("file_id", F.lit("")).alias("bid"), F.col("domain").alias("bdomain"))
    return paths.select("path").join(r, "path", "left").join(b, "path", "left").select("path", F.coalesce("rid", "bid").alias("file_id"), F.coalesce("rdomain", "bdomain").alias("domain"))
