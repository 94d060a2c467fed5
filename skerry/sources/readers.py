"""Sources: files of a folder, nested listings, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.functions.names import is_artifact_dir, is_conflict, join_path, map_remote_name, remote_rank


def local_files(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative), mtime, size, content of every visible file below ``folder``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.split("://")[-1].rstrip("/")
    path = F.regexp_replace(F.substring_index("path", root + "/", -1), "^/+", "")
    out = rows.select(path.alias("path"), F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    return out.where(~F.col("path").rlike(r"(^|/)\.") & ~is_conflict("path") & ~is_artifact_dir("path"))


def listing_rows(pages: DataFrame, base: str = "") -> DataFrame:
    """Rows of nested listing pages (entries: array of struct fileEntry): without
    hidden names and repeated ids, files under their mapped names."""
    e = F.col("e.fileEntry")
    rows = pages.select(F.explode("entries").alias("e")).select(e["id"].alias("id"), e["name"].alias("name"), e["parentId"].alias("parent_id"), F.coalesce(e["dir"], F.lit(False)).alias("is_dir"), F.coalesce(e["modifyTimeForSort"], F.lit(0)).cast("long").alias("mtime"), F.coalesce(e["createTimeForSort"], F.lit(0)).cast("long").alias("ctime"), F.coalesce(e["domain"], F.lit(0)).alias("domain"))
    rows = rows.where(~F.col("name").startswith(".")).dropDuplicates(["id"])
    return rows.withColumn("path", join_path(F.lit(base), F.when(F.col("is_dir"), F.col("name")).otherwise(map_remote_name("name"))))


def preferred(rows: DataFrame) -> DataFrame:
    """One row for each path: the best kind of name, then the newest, then the last id."""
    best = Window.partitionBy("path").orderBy(remote_rank("name").desc(), F.desc("mtime"), F.desc("id"))
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def cpu_profile(spark: SparkSession, path: str) -> DataFrame:
    """node id, function, url, line and self time (microseconds) of a CPU profile in JSON."""
    p = spark.read.option("multiLine", "true").json(path)
    nodes = p.select(F.explode("nodes").alias("n")).select(F.col("n.id").alias("id"), F.col("n.callFrame.functionName").alias("function"), F.col("n.callFrame.url").alias("url"), F.col("n.callFrame.lineNumber").alias("line"))
    samples = p.select(F.explode(F.arrays_zip("samples", "timeDeltas")).alias("s")).select(F.col("s.samples").alias("id"), F.col("s.timeDeltas").alias("delta"))
    return hot_functions(nodes, samples)


def hot_functions(nodes: DataFrame, samples: DataFrame) -> DataFrame:
    """Each node's self time and share of all time; unknown and negative ids only count for the total."""
    total = samples.agg(F.coalesce(F.sum("delta"), F.lit(0)).alias("total"))
    own = samples.where("id >= 0").groupBy("id").agg(F.sum("delta").alias("self_time"))
    share = F.when(F.col("total") > 0, F.round(100.0 * F.col("self_time") / F.col("total"), 4)).otherwise(0.0)
    return nodes.join(own, "id").join(F.broadcast(total)).withColumn("pct", share).drop("total")  # one row
