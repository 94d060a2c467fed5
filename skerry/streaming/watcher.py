"""A folder watcher as a stateful streaming operator with event-time timers.

Changes below a root are gathered until it has been silent for a while; that, or
a poll, triggers a run.  A root has one run at a time: a trigger that comes while
one is under way is dropped, with its changes.

State is kept for each root in the state store: the open burst (first and last
change, counts), its distinct paths as map entries, the changes that the
watermark hasn't passed yet and that may still be overtaken by earlier ones, and
when the run under way ends.  A burst of any length holds one map entry a path;
only changes within the permitted lateness are kept as rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from skerry.functions.names import is_watched

TRIGGER = Row("root", "kind", "started", "ended", "changes", "paths", "accepted")
TRIGGERS = "root string, kind string, started long, ended long, changes long, paths long, accepted boolean"


class Watcher(StatefulProcessor):
    """Rows (root, us, path) in, triggers out; a null path is a poll.

    Every call of a state is a message to the executor's store, so a root's numbers
    are one value, read and written once, and paths go to the map only if their
    burst is still open when all that is final has been gone through.
    """

    def __init__(self, silence: int, busy: int):
        self.silence, self.busy = silence, busy  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the open burst (null without one), the end of the run under way, the timer, the first change held back
        self.root = handle.getValueState("root", "first long, last long, changes long, paths long, until long, timer long, held long")
        self.paths = handle.getMapState("paths", "path string", "n int")
        self.recent = handle.getListState("recent", "ts long, path string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs(), [(int(r["us"]), r["path"]) for r in rows], False)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs(), [], True)

    def _advance(self, key: Any, watermark_ms: int, new: list[tuple], expired: bool) -> list[Row]:
        """What the watermark has passed is final: goes through it in order of time."""
        now, out, stored = watermark_ms * 1000, [], self.root.get()
        first, last, changes, paths, until, timer, waiting = stored if stored is not None else (None,) * 7
        burst, kept = (None, False) if first is None else ((first, last, changes, paths), True)  # kept: its paths are in the map
        known: dict[str, bool] = {}  # this burst's paths, and whether the map has them
        held = new
        if waiting is not None and waiting <= now:
            held = [*(tuple(r) for r in self.recent.get()), *new]
        held = sorted(held, key=lambda r: (r[0], r[1] is None, r[1] or ""))
        final, later = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        if waiting is None or waiting > now:
            if later:
                self.recent.appendList(later)
                waiting = later[0][0] if waiting is None else min(waiting, later[0][0])
        else:
            self.recent.put(later) if later else self.recent.clear()
            waiting = later[0][0] if later else None

        def trigger(kind: str, started: int, ended: int, changes: int, paths: int) -> None:
            nonlocal until
            free = until is None or until <= ended
            if free:
                until = ended + self.busy
            out.append(TRIGGER(key[0], kind, started, ended, changes, paths, free))

        def close() -> None:
            nonlocal burst, kept
            trigger("changes", burst[0], burst[1] + self.silence, burst[2], burst[3])
            if kept:
                self.paths.clear()
            burst, kept = None, False
            known.clear()

        for ts, path in final:
            if burst is not None and ts - burst[1] >= self.silence:
                close()
            if path is None:
                trigger("poll", ts, ts, 0, 0)
                continue
            fresh = path not in known
            if fresh:
                known[path] = kept and self.paths.containsKey((path,))
                fresh = not known[path]
            burst = (ts, ts, 1, 1) if burst is None else (burst[0], ts, burst[2] + 1, burst[3] + fresh)
        if burst is not None and burst[1] + self.silence <= now and (waiting is None or waiting >= burst[1] + self.silence):
            close()
        for path, there in known.items():
            if not there:
                self.paths.updateValue((path,), (1,))
        wake = [t for t in (None if burst is None else burst[1] + self.silence, waiting) if t is not None]
        due = max(watermark_ms + 1, -(-min(wake) // 1000)) if wake else None
        if expired or due != timer:
            if timer is not None and not expired:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.root.update((*(burst or (None,) * 4), until, due, waiting))
        return out

    def close(self) -> None:
        pass


def triggers(changes: DataFrame, silence: str = "5 seconds", busy: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """For a stream of changes (root, ts, path; a null path is a poll): the runs
    that silence and polls ask for, and whether each is ``accepted``.

    Paths that aren't watched are left out.  Needs the RocksDB state store.
    """
    spark = changes.sparkSession
    us = lambda text: int(pd.Timedelta(text).total_seconds() * 1_000_000)
    use_rocksdb(spark)
    rows = changes.where(F.col("path").isNull() | is_watched("path")).withWatermark("ts", late).select("root", "ts", F.unix_micros("ts").alias("us"), "path")
    out = rows.groupBy("root").transformWithState(statefulProcessor=Watcher(us(silence), us(busy)), outputStructType=TRIGGERS, outputMode="Append", timeMode="EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("started", "ended")})


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
