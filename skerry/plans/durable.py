"""Operations that change several stored tables at once, over a :class:`Store`.

A store of a synchronised folder has the tables ``files`` (the baseline),
``dirs``, ``log``, ``state`` (key, value) and whatever else is put into it.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators import health
from skerry.operators import store as tables
from skerry.operators.state import last_writer_wins
from skerry.sources.commit import Store
from skerry.sources.feed_source import feed_stream
from skerry.streaming.feed import apply_feed, follow

STATE = "key string, value string"
DIRS = "path string, dir_id string, parent_id string"


def state_rows(spark: SparkSession, **values: int | str) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in values.items()], STATE)


def state_value(store: Store, key: str, default: int = 0) -> int:
    """A number of the state table; the default if it isn't there or isn't a number."""
    if "state" not in store.names():
        return default
    found = store.read("state").where(F.col("key") == key).select(F.expr("try_cast(value AS bigint)")).first()
    return default if found is None or found[0] is None else int(found[0])


def begin(spark: SparkSession, folder: str, files: DataFrame) -> Store:
    """A new store with a baseline and empty other tables."""
    store = Store(spark, folder)
    store.commit({"files": files, "dirs": spark.createDataFrame([], DIRS), "state": spark.createDataFrame([], STATE)})
    return store


def commit_sync(store: Store, done: DataFrame, now: int, batch: int | None = None) -> int:
    """Records finished actions: baseline and log change together."""
    files, log = tables.record_sync(store.read("files"), done, now)
    return store.commit({"files": files}, {"log": log}, "sync", batch)


def commit_scan(store: Store, listed: DataFrame, version: int, now: int) -> int:
    """Saves a whole scan: baseline, folders, and the version with its times."""
    held = store.read_all()
    files, dirs, state = tables.save_scan(held["files"], held["dirs"], held["state"], listed, version, now)
    return store.commit({"files": files, "dirs": dirs, "state": state})


def commit_gc(store: Store, local: DataFrame, now: int) -> int:
    """Applies the retention rules to files, log and references in one step."""
    held = store.read_all()
    gone = health.gc_rows(held["files"], local, held["log"], held["refs"], now)
    keys = lambda kind, key: gone.where(F.col("kind") == kind).select(F.col("key").alias(key))
    log = held["log"].join(keys("log", "_id").withColumn("_id", F.col("_id").cast("long")), F.col("id") == F.col("_id"), "left_anti")
    return store.commit({"files": held["files"].join(keys("file", "path"), "path", "left_anti"), "log": log, "refs": held["refs"].join(keys("reference", "source_path").distinct(), "source_path", "left_anti")})


def put_state(store: Store, **values: int | str) -> int:
    return store.commit({"state": last_writer_wins(store.read("state"), state_rows(store.spark, **values), "key")})


def follow_feed(store: Store, path: str, rescan: Callable[[int], DataFrame], checkpoint: str, table: str = "listing", key: str = "id", **options: str | int) -> int:
    """Brings ``table`` of the store up to the feed in ``path``, and returns how many
    batches that took; the next call with the same checkpoint continues.  A run
    that finds a batch left unfinished does that one alone, so runs go on until
    one has nothing to do.

    A batch's rows replace those with their key, the newest version first.  After
    a gap ``rescan(version)`` gives the whole table instead.  Table, version and
    the number of reloads are committed together and once for each batch, so a
    batch that is repeated after a failure changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        writer = f"feed {checkpoint}"
        if store.manifest()["batches"].get(writer, -1) >= number:
            return
        head = batch.agg(F.max("version").alias("version"), F.max(F.col("reload").cast("int")).alias("reload")).first()
        if head["version"] is None:
            return
        if head["reload"]:
            rows = rescan(head["version"])
        else:
            rows = apply_feed(store.read(table), batch.drop("reload"), state_value(store, "version"), key)
        known = store.read("state") if "state" in store.names() else store.spark.createDataFrame([], STATE)
        state = last_writer_wins(known, state_rows(store.spark, version=head["version"], reloads=state_value(store, "reloads") + head["reload"]), "key")
        store.commit({table: rows, "state": state}, writer=writer, batch=number)

    for done in itertools.count():
        run = follow(feed_stream(store.spark, path, **options), apply, checkpoint, once=True)
        run.awaitTermination()
        if not any(p["numInputRows"] for p in run.recentProgress):
            return done
