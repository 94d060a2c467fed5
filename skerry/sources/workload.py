"""Snapshots derived from the driver's tables.

A reconciliation needs a remote listing, a local listing and the last known
baseline.  The driver's tables have none, so they are derived from
``documents`` by integer arithmetic on ``doc_id`` and md5, which any SQL engine
can repeat.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Epoch second of the first baseline row, and of the baseline's last sync.
START, SYNCED_AT = 1_700_000_000, 1_700_000_500
DAY = 86_400


class Snapshots(NamedTuple):
    remote: DataFrame
    local: DataFrame
    base: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str, most: int = 20_000) -> DataFrame:
    """The rows dealt by ``key`` to as many tasks as have ``most`` rows each, and no
    fewer than shuffles have: short rows lie in few parts of a file, however long
    each of them takes."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // most)), key)


def epoch(ts: str) -> Column:
    """Epoch seconds of a timestamp without a zone, taken as UTC in any session."""
    day = F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return day * DAY + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, dir, name, path, text of every document."""
    folder = F.concat_ws("/", "source", "lang")
    name = F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select("doc_id", folder.alias("dir"), name.alias("name"), F.concat_ws("/", folder, name).alias("path"), "text")


def snapshots(spark: SparkSession, sf_dir: str) -> Snapshots:
    d = paths(spark, sf_dir)
    i = F.col("doc_id")
    plain, edited, elsewhere = F.md5("text"), F.md5(F.concat("text", F.lit("#edited"))), F.md5(F.concat("text", F.lit("#cloud")))
    base = d.where(i % 10 != 0).select(
        "path",
        F.when(i % 17 == 0, "").otherwise(F.concat(F.lit("F"), i)).alias("file_id"),
        F.when(i % 19 == 0, 0).otherwise(START + i).cast("long").alias("cloud_mtime"),
        F.when(i % 29 == 0, 0).otherwise(START + 100 + i).cast("long").alias("local_mtime"),
        F.when(i % 6 != 0, plain).alias("content_hash"),
        plain.alias("cloud_content_hash"),
        F.when(i % 13 == 0, 0).otherwise(SYNCED_AT).cast("long").alias("last_sync_at"),
        F.col("dir").alias("parent_id"),
        (i % 2).cast("int").alias("domain"),
        (START - 1000 + i % 100).cast("long").alias("create_time"),
    )
    local = d.where(i % 7 != 0).select(
        "path",
        (START + 100 + i + F.when(i % 4 == 0, 60).otherwise(0)).cast("long").alias("mtime"),
        F.length("text").cast("long").alias("size"),
        F.when((i % 5).isin(0, 1), edited).otherwise(plain).alias("local_hash"),
    )
    remote = d.where(i % 11 != 0).select(
        "path",
        F.concat(F.lit("F"), i).alias("id"),
        F.col("dir").alias("parent_id"),
        "name",
        (START + i + F.when(i % 3 == 0, 60).otherwise(0)).cast("long").alias("mtime"),
        (START - 1000 + i % 100).cast("long").alias("ctime"),
        (i % 2).cast("int").alias("domain"),
        F.when((i % 15).isin(6, 10), edited).when((i % 3 == 0) & (i % 4).isin(0, 3), elsewhere).otherwise(plain).alias("cloud_hash"),
    )
    return Snapshots(remote, local, base)
