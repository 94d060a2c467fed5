"""Change feeds and debouncing, as batch functions and as streaming queries.

The same column logic serves both: a feed batch is applied to the stored
snapshot by version, and changes are emitted after a silence by session windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from skerry.functions.names import is_watched
from skerry.operators.state import last_writer_wins


def watermark(feed: DataFrame) -> DataFrame:
    """One row: the highest version."""
    return feed.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def latest(feed: DataFrame, key: str) -> DataFrame:
    """The newest version of each key."""
    newest = Window.partitionBy(key).orderBy(F.desc("version"))
    return feed.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def coverage(feed: DataFrame, stored: int) -> DataFrame:
    """One row: new rows, and whether the feed overflowed.

    A feed page that reaches back to a version already stored has no gap; if
    all its rows are new, changes before it may be lost and a full scan is due.
    """
    return feed.agg(F.count_if(F.col("version") > stored).alias("fresh"), (F.count_if(F.col("version") <= stored) == 0).alias("overflow"))


def recent(feed: DataFrame, most: int = 30) -> DataFrame:
    """A page of the feed: the newest ``most`` rows."""
    return feed.orderBy(F.desc("version")).limit(most)


def scan_due(state: DataFrame, most_age: int = 3600) -> DataFrame:
    """key, due: whether a full scan is due, by version, age and rows without an id
    (:func:`needs_full_scan` over columns); key, fresh: whether a scan is so new, and
    nothing synced since, that the stored listing serves."""
    due = (F.col("version") <= 0) | (F.col("empty_ids") > 0) | (F.col("age") >= most_age)
    return state.select("key", due.alias("due"), ((F.col("age") < 60) & (F.col("synced") == 0)).alias("fresh"))


def scan_due_of(state: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """:func:`scan_due` for state rows (key, version, age): rows without an id, and
    rows that were synced, are counted in the stored files, which have ``key``."""
    held = base.groupBy(F.col(key).alias("key")).agg(F.count_if(F.col("file_id") == "").alias("empty_ids"), F.count_if(F.col("last_sync_at") > 0).alias("synced"))
    return scan_due(state.join(held, "key", "left").fillna(0, ["empty_ids", "synced"]))


def apply_feed(snapshot: DataFrame, feed: DataFrame, stored: int, key: str = "id") -> DataFrame:
    """The snapshot with the newest row of each key of the feed beyond ``stored``."""
    fresh = latest(feed.where(F.col("version") > stored), key)
    return last_writer_wins(snapshot, fresh.select(*snapshot.columns), key)


def needs_full_scan(version: int, seconds_since_full: int, empty_ids: int, most_age: int = 3600) -> bool:
    return version <= 0 or empty_ids > 0 or seconds_since_full >= most_age


def is_usable(live: int, prior: int) -> bool:
    """A live listing that shrank by more than half isn't trusted."""
    return live > 0 and (prior == 0 or 2 * live >= prior)


def usable(live: Column | str, prior: Column | str) -> Column:
    """:func:`is_usable` over columns."""
    return (F.col(live) > 0) & ((F.col(prior) == 0) | (2 * F.col(live) >= F.col(prior)))


def watched(changes: DataFrame, path: str = "path") -> DataFrame:
    """The changes, of a batch or a stream, that start a sync."""
    return changes.where(is_watched(path))


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """key, session start and end, and number of events, by silences of ``gap``."""
    return events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def debounced(changes: DataFrame, root: str = "root", ts: str = "ts", path: str = "path", silence: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """For a stream of changes: the distinct paths of each burst below a watched
    folder, once it is silent."""
    bursts = changes.withWatermark(ts, late).groupBy(F.session_window(ts, silence).alias("w"), root).agg(F.collect_set(path).alias("paths"))
    return bursts.select(root, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "paths")


def follow(feed: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str = "5 minutes", once: bool = False) -> StreamingQuery:
    """Runs ``apply(batch, batch_id)`` on each micro-batch of the feed; batches
    never overlap, and the checkpoint keeps the place."""
    writer = feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime=every).start()
