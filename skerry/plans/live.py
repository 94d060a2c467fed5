"""Queries of sources, streams and stores that live in the shared folder (paged
listings, the followed feed, the watcher, commits of several tables, kept
versions), and of trees and nested notes."""

from __future__ import annotations

import gzip
import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.functions import names
from skerry.operators import dedup, notes, trees
from skerry.plans import durable
from skerry.plans.oracle import DUP_ACTIONS, FILES, SNAPSHOTS
from skerry.plans.queries import _files, query
from skerry.plans.stored import NOW, _dirs, _done, _scan_parts
from skerry.plans.stored_oracle import STORED
from skerry.sources import listing, versions
from skerry.sources.changes import changed_files
from skerry.sources.commit import Store
from skerry.sources.staging import scratch, written
from skerry.sources.workload import epoch, paths, snapshots, table
from skerry.streaming import feed
from skerry.streaming.watcher import triggers


# --- paged listings -------------------------------------------------------------

#: Documents of a folder and of a page in the written listings.
FOLDER, PAGE = 20, 4


def written_pages(spark: SparkSession, sf: str, broken: bool = False) -> str:
    """Listing pages written from documents: a root of folders of 20, in pages of 4.

    Of every five folders, one repeats its first page for ever, one gives a total
    of 6, one has a short second page; with ``broken``, one has an unreadable page, its
    second or only one.
    """
    i = F.col("doc_id")
    kind = F.floor(i / FOLDER) % 5
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("d"), F.floor(i / FOLDER)).alias("dir"), (F.floor(i % FOLDER / PAGE) * PAGE).cast("long").alias("start"), kind.alias("kind"))
    entry = lambda id_, name, is_dir: F.struct(F.struct(id_.alias("id"), name.alias("name"), is_dir.alias("dir"), F.lit(7).alias("modifyTimeForSort"), F.lit(5).alias("createTimeForSort"), F.lit(1).alias("domain")).alias("fileEntry"))
    name = F.concat(F.when(i % 9 == 4, ".").otherwise(""), F.lit("n"), i, F.when(i % 2 == 0, ".note").otherwise(".md"))
    files = d.select("dir", "start", "kind", i.alias("at"), entry(F.concat(F.lit("f"), i), name, F.lit(False)).alias("e")).where((F.col("kind") != 3) | (F.col("start") != PAGE) | (i % PAGE < 2))
    again = files.where("kind = 1 AND start = 0").withColumn("start", F.lit(PAGE).cast("long"))
    files = files.where(f"kind <> 1 OR start <> {PAGE}").unionByName(again)
    pages = files.groupBy("dir", "start", "kind").agg(F.sort_array(F.collect_list(F.struct("at", "e"))).alias("es"))
    total = F.when(F.col("kind") == 2, 6).otherwise(1000)
    body = F.to_json(F.struct(total.alias("count"), F.transform("es", lambda x: x["e"]).alias("entries")))
    if broken:
        pages = pages.withColumn("bad", F.least(F.lit(PAGE), F.max("start").over(Window.partitionBy("dir"))))
        body = F.when((F.col("kind") == 4) & (F.col("start") == F.col("bad")), "{no page").otherwise(body)
    folders = d.select("dir").distinct().select(F.lit("top").alias("dir"), F.regexp_extract("dir", "[0-9]+", 0).cast("long").alias("n"), "dir").toDF("dir", "n", "id")
    top = folders.groupBy("dir", (F.floor(F.col("n") / PAGE) * PAGE).cast("long").alias("start")).agg(F.sort_array(F.collect_list(F.struct("n", entry(F.col("id"), F.concat(F.lit("folder "), "n"), F.lit(True)).alias("e")))).alias("es"))
    top = top.select("dir", "start", F.to_json(F.struct(F.lit(1 << 40).alias("count"), F.transform("es", lambda x: x["e"]).alias("entries"))).alias("body"))
    out = scratch(spark, "pages")
    every = pages.select("dir", "start", body.alias("body")).unionByName(top).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "dir", "start")
    _kept(every.select(F.concat(F.lit("dir="), "dir", F.lit("/start="), "start", F.lit("/part-0.txt")).alias("path"), F.col("body").alias("content")), out, packed=False)
    return out


def _options(spark: SparkSession, sf: str) -> dict[str, int]:
    """As many pages as the root's listing may need."""
    return {"pagesize": PAGE, "rangepages": 5, "tasks": 16, "mostpages": table(spark, sf, "documents").count() // (FOLDER * PAGE) + 5}


@query
def listing_scan(spark, sf):
    """Files and folders of a paged listing below its root."""
    found = listing.scan(spark, written_pages(spark, sf), "top", **_options(spark, sf))
    return found.select("id", "parent_id", "path", "is_dir", "mtime", "depth")


@query
def listing_broken(spark, sf):
    """Entries of each folder of a listing in which some folders fail."""
    pages = written(listing.read_pages(spark, written_pages(spark, sf, broken=True), **_options(spark, sf)), "pages")
    counts = listing.listed(pages, PAGE).groupBy("dir_id").agg(F.count("*").alias("n"))
    failed = listing.failures(pages).select("dir_id", F.substring_index("error", ":", 1).alias("error"))
    return counts.join(failed, "dir_id", "full").where("dir_id <> 'top'").select("dir_id", F.coalesce("n", F.lit(0)).alias("n"), "error")


# --- feed -----------------------------------------------------------------------


def _follow(spark: SparkSession, sf: str, reach: int) -> DataFrame:
    """Events as a feed that arrives in three parts, followed after each."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("id"), (F.col("event_id") + 1).alias("version"), F.col("event_type").alias("name"))
    last = rows.agg(F.max("version")).first()[0]
    folder, checkpoint, store = scratch(spark, "feed"), scratch(spark, "place"), Store(spark, scratch(spark, "store"))
    newest = lambda version: rows.where(F.col("version") <= version).groupBy("id").agg(F.max("version").alias("version"), F.max_by("name", "version").alias("name"))
    for low, high in ((0, last // 2), (last // 2, last - 20), (last - 20, last)):
        rows.where((F.col("version") > low) & (F.col("version") <= high)).write.mode("append").parquet(folder)
        durable.follow_feed(store, folder, newest, checkpoint, reach=reach)
    return store.read("listing").withColumn("reloads", F.lit(durable.state_value(store, "reloads")))


@query
def feed_followed(spark, sf):
    """One scan, then two batches of changes."""
    return _follow(spark, sf, 1 << 40)


@query
def feed_gaps(spark, sf):
    """A feed that tells only its newest 30 rows: the second part makes a gap, the third doesn't."""
    return _follow(spark, sf, 30)


# --- watcher --------------------------------------------------------------------


def _micros(ts: str) -> Column:
    return epoch(ts) * 1_000_000 + F.date_format(ts, "SSSSSS").cast("long")


def watched_events(spark: SparkSession, sf: str, parts: int = 4) -> Iterator[DataFrame]:
    """Events as a stream of changes and polls that arrives in parts, and a last
    change long after that moves the watermark past all others.

    The stream is told after each part, to be followed to its end: a part is one
    batch, in however many files it is.  Batches of a number of files would grow in
    number with the table, and could move the watermark past the rest of a part.
    """
    us = _micros("ts")
    path = F.when(F.col("event_type") != "error", F.concat(F.lit("p"), F.col("event_id") % 7, F.when(F.col("event_id") % 5 == 0, ".txt").otherwise(".md")))
    rows = table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("root"), us.alias("us"), path.alias("path"))
    out = scratch(spark, "changes")
    cuts = [float(x) for x in rows.approxQuantile("us", [k / parts for k in range(1, parts)], 0.01)]
    edges = [None, *cuts, None]
    every = [rows.where((F.lit(True) if low is None else F.col("us") > low) & (F.lit(True) if high is None else F.col("us") <= high)) for low, high in zip(edges, edges[1:])]
    every.append(spark.createDataFrame([("", 4_000_000_000_000_000, "end.md")], rows.schema))
    for part in every:
        part.write.mode("append").parquet(out)
        yield spark.readStream.schema(rows.schema).parquet(out).select("root", F.timestamp_micros("us").alias("ts"), "path")


@query
def watcher_runs(spark, sf):
    """Runs that bursts of changes and polls ask for; those during another run are dropped."""
    out, place = scratch(spark, "runs"), scratch(spark, "place")
    for changes in watched_events(spark, sf):
        runs = triggers(changes, "30 minutes", "2 hours", "1 hour")
        runs.writeStream.format("parquet").option("path", out).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(runs.schema).parquet(out).where("root <> ''")
    return found.select("root", "kind", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "changes", "paths", "accepted")


@query
def files_changed(spark, sf):
    """Files of a folder that a stream tells: all, then those written again."""
    folder, out, place, i = scratch(spark, "watched"), scratch(spark, "told"), scratch(spark, "place"), F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("s"), i % 7, F.when(i % 11 == 0, "/.hidden/n").otherwise("/n"), i, F.lit(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    for part in (d, d.where("doc_id % 10 = 3")):
        _kept(part, folder)
        time.sleep(0.3)  # what has just been written isn't told yet
        changed_files(spark, folder, settle=200).writeStream.format("parquet").option("path", out).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(changed_files(spark, folder).schema).parquet(out).groupBy("path").agg(F.count("*").alias("times"))


# --- duplicates and folders --------------------------------------------------------


@query
def dup_split(spark, sf):
    """Linked and other paths of each group of equal files."""
    found = dedup.split(_files(spark, sf))
    return found.select("hash", F.array_join("linked", ",").alias("linked"), F.array_join("local", ",").alias("local"))


@query
def dedup_run(spark, sf):
    """Files that stay and go in a sync with, and one without, the removal of duplicates."""
    referenced = paths(spark, sf).where("doc_id % 9 = 0").select("path")
    out = None
    for enabled in (True, False):
        stay, go = dedup.run(_files(spark, sf), referenced, enabled)
        rows = stay.select(F.lit(enabled).alias("enabled"), "path", F.lit("stays").alias("what")).unionByName(go.select(F.lit(enabled).alias("enabled"), "path", F.lit("goes").alias("what")))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def directory_entries(spark, sf):
    """What one folder of the paged listing holds, and the root."""
    found = listing.scan(spark, written_pages(spark, sf), "top", **_options(spark, sf))
    rows = found.select("id", F.when(F.col("parent_id") != "top", F.col("parent_id")).alias("parent_id"), "name", "is_dir", F.lit(None).cast("long").alias("size"), "mtime", "ctime")
    return trees.entries(rows).unionByName(trees.entries(rows, "d4")).select("id", "name", "is_dir", "size", "mtime", "ctime")


# --- stores ---------------------------------------------------------------------


@query
def sync_committed(spark, sf):
    """Baseline and log of a store after a sync, read back."""
    store = durable.begin(spark, scratch(spark, "store"), snapshots(spark, sf).base)
    for _ in range(2):  # the second is a repeat
        durable.commit_sync(store, _done(spark, sf), NOW, batch=1)
    files = store.read("files").select(F.lit("files").alias("kind"), "path", F.col("file_id").alias("id"), F.col("last_sync_at").alias("at"))
    return files.unionByName(store.read("log").select(F.lit("log").alias("kind"), "path", F.col("cloud_id").alias("id"), F.col("timestamp").alias("at")))


@query
def scan_committed(spark, sf):
    """Baseline, folders and state of a store after a whole scan, read back."""
    base, dirs, known, listed = _scan_parts(spark, sf)
    store = Store(spark, scratch(spark, "store"))
    store.commit({"files": base, "dirs": dirs, "state": known})
    durable.commit_scan(store, listed, 77, NOW)
    row = lambda kind, key, value: store.read(kind).select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col(value).alias("value"))
    return row("files", "path", "file_id").unionByName(row("dirs", "path", "dir_id")).unionByName(row("state", "key", "value"))


@query
def gc_committed(spark, sf):
    """What stays in a store after its retention rules."""
    s = snapshots(spark, sf)
    store = Store(spark, scratch(spark, "store"))
    store.commit({"files": s.base, "log": table(spark, sf, "events").select(F.col("event_id").alias("id"), epoch("ts").alias("timestamp")), "refs": s.base.select(F.col("path").alias("source_path"), F.concat("path", F.lit(".png")).alias("ref_path"))})
    durable.commit_gc(store, s.local, 1_706_600_000 + 60 * 86_400)
    row = lambda kind, key: store.read(kind).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"))
    return row("files", "path").unionByName(row("log", "id")).unionByName(row("refs", "source_path"))


# --- trees ----------------------------------------------------------------------


@query
def merkle_names(spark, sf):
    """Digests of directories whose names differ by case, dots, blanks and accents."""
    i = F.col("doc_id")
    stem = F.element_at(F.array(*(F.lit(x) for x in ("a", "A", "b", "B c", "a.md", "a-b", "é", "Z"))), (i % 8 + 1).cast("int"))
    path = F.concat(F.lit("d"), F.floor(i / 40) % 9, F.lit("/"), stem, F.when(i % 3 == 0, F.concat(F.lit("/"), i)).otherwise(F.concat(F.lit("."), i, F.lit(" x"))))
    return trees.merkle(table(spark, sf, "documents").select(path.alias("path"), F.md5("text").alias("hash")), 2)


@query
def deep_paths(spark, sf):
    """A chain of documents, each below the one before, cut into chains by source; cycles among them have no path."""
    d = paths(spark, sf).select("doc_id")
    i = F.col("doc_id")
    up = F.when(i % 100 == 0, None).when(i % 100 == 98, i + 1).otherwise(i - 1)
    return trees.tree_paths(d.select(i.alias("id"), up.alias("parent_id"), F.concat(F.lit("n"), i % 10).alias("name")), None)


# --- notes and kept versions ------------------------------------------------------


def _nested_note(i: Column) -> Column:
    """A note with a table of rows of cells of paragraphs (five levels of nodes), and
    paragraphs beside it; one in eleven isn't JSON, one in thirteen has no nodes."""
    span = lambda t: F.concat(F.lit('{"7":[{"8":"'), t, F.lit('"},{"8":"."},{"8":7}]}'))
    line = lambda t: F.concat(F.lit('{"5":['), span(t), F.lit("]}"))
    cell = F.concat(F.lit('{"6":"tc","5":['), line(F.concat(F.lit("c"), i)), F.lit("]}"))
    row = F.concat(F.lit('{"6":"tr","5":['), F.repeat(F.concat(cell, F.lit(",")), (i % 3).cast("int")), cell, F.lit("]}"))
    grid = F.concat(F.lit('{"6":"t","5":['), F.repeat(F.concat(row, F.lit(",")), (i % 2).cast("int")), row, F.lit("]}"))
    top = F.when(i % 4 == 0, grid).when(i % 4 == 1, line(F.lit(" | a |"))).when(i % 4 == 2, F.lit('"text"')).otherwise(F.lit('{"6":3,"8":"own","5":{"x":[{"8":""},{"8":"deep"}]}}'))
    note = F.concat(F.lit('{"5":['), top, F.lit(","), line(F.concat(F.lit("p"), i)), F.lit('],"8":"end","a":null}'))
    return F.when(i % 11 == 5, F.concat(note, F.lit("}"))).when(i % 13 == 7, F.lit("[]")).otherwise(note)


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", _nested_note(F.col("doc_id")).alias("note"))


@query
def note_node_counts(spark, sf):
    return notes.table_counts(_notes(spark, sf), "doc_id", "note").withColumnRenamed("key", "doc_id")


@query
def note_deep_texts(spark, sf):
    return notes.note_texts(_notes(spark, sf), "doc_id", "note").select(F.col("key").alias("doc_id"), F.array_join("texts", "/").alias("texts"))


def _kept(rows: DataFrame, folder: str, packed: bool = True) -> None:
    """Writes (path, content) as files, gzip ones if ``packed``; a repeated task
    writes the same again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                disk.create_dir(f"{root}/{path.rpartition('/')[0]}")
                with disk.open_output_stream(f"{root}/{path}", compression=None) as out:
                    out.write(gzip.compress(content.encode(), 1) if packed else content.encode())
            yield batch.slice(0, 0)

    rows.select("path", "content").mapInArrow(write, "path string, content string").count()


@query
def kept_versions(spark, sf):
    """Each note's versions, and the texts of the largest, read back from gzip files;
    beside some lie files that aren't versions."""
    folder, i = scratch(spark, "kept"), F.col("doc_id")
    version = _notes(spark, sf).select("doc_id", "note", F.explode(F.sequence(F.lit(1).cast("long"), i % 3 + 1)).alias("v"))
    body = F.when(F.col("v") == i % 3, F.col("note")).otherwise(F.concat(F.lit('{"8":"v'), "v", F.lit('"}')))
    _kept(version.select(F.concat(F.lit("F"), i, F.lit("/"), "v").alias("path"), body.alias("content")).unionByName(version.where("doc_id % 10 = 1").select(F.concat(F.lit("F"), i, F.lit("/"), "v", F.lit(".index")).alias("path"), F.lit("x").alias("content"))), folder)
    found = written(versions.list_versions(spark, folder), "versions")
    counts = found.groupBy("file_id").agg(F.count("*").alias("versions"))
    read = written(versions.contents(versions.richest(found)).select("file_id", "version", F.col("content").cast("string").alias("note")), "read")
    texts = notes.note_texts(read, "file_id", "note").select(F.col("key").alias("file_id"), F.array_join("texts", "/").alias("texts"))
    return read.join(counts, "file_id").join(texts, "file_id").select("file_id", "versions", "version", "texts")


@query
def desktop_files(spark, sf):
    """Bytes of the desktop's files by id; some ids have none, some are empty."""
    folder, i = scratch(spark, "desktop"), F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id", F.when(i % 7 == 0, "").otherwise(F.concat(F.when(i % 2 == 0, "W").otherwise("s"), i)).alias("file_id"), "text")
    path = F.concat(F.lit("file/"), F.lower(F.substring("file_id", 1, 1)), F.lit("/"), "file_id")
    _kept(d.where((F.col("file_id") != "") & (i % 5 != 0)).select(path.alias("path"), F.col("text").alias("content")), folder)
    found = versions.contents(d.select("doc_id", versions.desktop_path(folder, "file_id").alias("path")))
    return found.select("doc_id", F.md5("content").alias("hash"))


@query
def push_errors(spark, sf):
    """Codes and ids of errors in remote answers with text before the object, and of broken ones."""
    k = F.col("p_partkey")
    answer = F.element_at(F.array(*(F.lit(x) for x in ('HTTP 500: {"error":"20108","duplicateFileId":"W#"}', '{"error":211}', 'no object', '{"error":"","x":1}', '{"error":"1"} and more', 'a {"error":null}', '{"error":{"error":"2"}}', 'x{"error":"20108","duplicateFileId":5}'))), (k % 8 + 1).cast("int"))
    e = notes.push_error(F.replace(answer, F.lit("#"), k.cast("string")))
    return table(spark, sf, "part").select("p_partkey", e["code"].alias("code"), e["duplicate_id"].alias("duplicate_id"))


@query
def listing_lines(spark, sf):
    i = F.col("doc_id")
    line = names.listing_line(F.concat(F.lit("F"), i), F.when(i % 4 != 0, F.concat(F.lit("n"), i)), F.when(i % 3 != 0, i % 3 == 1), F.when(i % 5 != 0, i * i * i), (i % 7) * 250_000_000_000)
    return table(spark, sf, "documents").select("doc_id", line.alias("l")).select("doc_id", "l.*")


@query
def references_by_source(spark, sf):
    """The references of each document, as edges that come more than once."""
    i = F.col("doc_id")
    edges = table(spark, sf, "documents").select(F.concat(F.lit("d"), i % 50).alias("source_path"), F.explode(F.array(F.concat(F.lit("r"), i % 70), F.concat(F.lit("r"), i % 3))).alias("ref_path"))
    return dedup.reference_lists(edges).select("source_path", F.array_join("refs", ",").alias("refs"))


@query
def scans_needed(spark, sf):
    """Whether a whole scan of each folder is due, by the files stored for it."""
    base = snapshots(spark, sf).base
    state = base.groupBy(F.col("parent_id").alias("key")).agg((F.max("cloud_mtime") % 3).alias("version"), (F.max("local_mtime") % 5000).alias("age"))
    files = base.where("path NOT LIKE '%/fr/%' OR file_id <> ''").withColumn("last_sync_at", F.when(F.col("path").like("%/de/%"), 0).otherwise(F.col("last_sync_at")))
    return feed.scan_due_of(state.unionByName(state.select(F.concat("key", F.lit("/none")).alias("key"), "version", "age")), files, "parent_id")


_NESTED = """WITH f AS (SELECT doc_id AS i, '{"7":[{"8":"' || 'c' || doc_id || '"},{"8":"."},{"8":7}]}' AS c, '{"5":[{"7":[{"8":"p' || doc_id || '"},{"8":"."},{"8":7}]}]}' AS p FROM documents),
g AS (SELECT i, p, '{"6":"tc","5":[{"5":[' || c || ']}]}' AS cell FROM f),
h AS (SELECT i, p, '{"6":"tr","5":[' || repeat(cell || ',', i % 3) || cell || ']}' AS line FROM g),
n AS (SELECT i AS doc_id, '{"5":[' || CASE i % 4 WHEN 0 THEN '{"6":"t","5":[' || repeat(line || ',', i % 2) || line || ']}' WHEN 1 THEN '{"5":[{"7":[{"8":" | a |"},{"8":"."},{"8":7}]}]}' WHEN 2 THEN '"text"'
  ELSE '{"6":3,"8":"own","5":{"x":[{"8":""},{"8":"deep"}]}}' END || ',' || p || '],"8":"end","a":null}' || CASE WHEN i % 11 = 5 THEN '}' ELSE '' END AS made FROM h),
notes AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 5 AND doc_id % 13 = 7 THEN '[]' ELSE made END AS note FROM n),
nodes AS (SELECT doc_id, t.* FROM (SELECT * FROM notes WHERE json_valid(note)) s, json_tree(s.note) t)"""

_TEXTS = """texts AS (SELECT doc_id, CASE WHEN NOT json_valid(note) OR note = '[]' THEN ''
  ELSE 'end/' || CASE doc_id % 4 WHEN 0 THEN repeat('c' || doc_id || '/./', (doc_id % 2 + 1) * (doc_id % 3 + 1)) WHEN 1 THEN ' | a |/./' WHEN 2 THEN '' ELSE 'own/deep/' END || 'p' || doc_id || '/.' END AS texts FROM notes)"""

LIVE = {
    "note_node_counts": _NESTED + """, k AS (SELECT doc_id, count(*) FILTER (key = '6' AND atom = '"t"' AND path ~ '^\\$\\."?5"?\\[[0-9]+\\]$') AS tables, count(*) FILTER (key = '6' AND atom = '"tr"') AS rows, count(*) FILTER (key = '6' AND atom = '"tc"') AS cells FROM nodes GROUP BY doc_id)
SELECT doc_id, coalesce(tables, 0) AS tables, (doc_id % 4 = 1 AND json_valid(note) AND note <> '[]')::BIGINT AS pipes, coalesce(rows, 0) AS rows, coalesce(cells, 0) AS cells,
  CASE WHEN tables > 0 THEN 'native-table' WHEN doc_id % 4 = 1 AND json_valid(note) AND note <> '[]' THEN 'pipe-text' ELSE 'no-table' END AS shape FROM notes LEFT JOIN k USING (doc_id)""",
    "note_deep_texts": _NESTED + ", " + _TEXTS + " SELECT doc_id, texts FROM texts",
    "kept_versions": _NESTED + ", " + _TEXTS + """, r AS (SELECT doc_id, note = '[]' AS short, doc_id % 3 + 1 AS versions FROM notes),
v AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 1 WHEN short THEN 3 - doc_id % 3 ELSE doc_id % 3 END AS version FROM r)
SELECT 'F' || doc_id AS file_id, versions, version, CASE WHEN doc_id % 3 = 0 OR short THEN 'v' || version ELSE texts END AS texts FROM v JOIN texts USING (doc_id)""",
    "desktop_files": "SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN md5(text) END AS hash FROM documents",
    "push_errors": """WITH a AS (SELECT p_partkey, replace(list_value('HTTP 500: {"error":"20108","duplicateFileId":"W#"}', '{"error":211}', 'no object', '{"error":"","x":1}', '{"error":"1"} and more', 'a {"error":null}', '{"error":{"error":"2"}}', 'x{"error":"20108","duplicateFileId":5}')[p_partkey % 8 + 1], '#', p_partkey::VARCHAR) AS raw FROM part),
j AS (SELECT p_partkey, CASE WHEN contains(raw, '{') AND json_valid(substr(raw, instr(raw, '{'))) THEN substr(raw, instr(raw, '{')) END AS body FROM a),
e AS (SELECT p_partkey, CASE WHEN json_type(body, '$.error') IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE') THEN nullif(json_extract_string(body, '$.error'), '') END AS code, CASE WHEN json_type(body, '$.duplicateFileId') = 'VARCHAR' THEN json_extract_string(body, '$.duplicateFileId') END AS dup FROM j)
SELECT p_partkey, code, CASE WHEN code IS NOT NULL THEN dup END AS duplicate_id FROM e""",
    "listing_lines": """WITH e AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN doc_id * doc_id * doc_id ELSE 0 END AS size, doc_id % 7 * 250000000000 AS modified, doc_id % 3 = 1 AS is_dir FROM documents)
SELECT doc_id, 'F' || doc_id AS id, CASE WHEN doc_id % 4 <> 0 THEN 'n' || doc_id ELSE '(unnamed)' END AS name, is_dir, size, modified, CASE WHEN is_dir THEN 'folder' ELSE 'file' END AS type,
  CASE WHEN modified > 0 THEN strftime(make_timestamp(modified * 1000), '%Y-%m-%d %H:%M') ELSE '-' END AS time_text,
  CASE WHEN size = 0 THEN '-' WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', floor(size / 102.4 + 0.5) / 10) WHEN size < 1073741824 THEN printf('%.1f MB', floor(size / 104857.6 + 0.5) / 10) ELSE printf('%.1f GB', floor(size / 107374182.4 + 0.5) / 10) END AS size_text FROM e""",
    "references_by_source": "SELECT source_path, string_agg(ref_path, ',' ORDER BY ref_path) AS refs FROM (SELECT DISTINCT 'd' || doc_id % 50 AS source_path, 'r' || unnest([doc_id % 70, doc_id % 3]) AS ref_path FROM documents) GROUP BY 1",
    "scans_needed": SNAPSHOTS + """, s AS (SELECT parent_id AS key, max(cloud_mtime) % 3 AS version, max(local_mtime) % 5000 AS age FROM base GROUP BY 1),
every AS (SELECT * FROM s UNION ALL SELECT key || '/none', version, age FROM s),
h AS (SELECT parent_id AS key, count(*) FILTER (file_id = '') AS empty_ids, count(*) FILTER (last_sync_at > 0 AND path NOT LIKE '%/de/%') AS synced FROM base WHERE path NOT LIKE '%/fr/%' OR file_id <> '' GROUP BY 1)
SELECT key, version <= 0 OR coalesce(empty_ids, 0) > 0 OR age >= 3600 AS due, age < 60 AND coalesce(synced, 0) = 0 AS fresh FROM every LEFT JOIN h USING (key)""",
    "listing_scan": f"""WITH d AS (SELECT doc_id, doc_id // {FOLDER} AS n, (doc_id // {FOLDER}) % 5 AS kind, doc_id % {FOLDER} // {PAGE} AS page FROM documents),
told AS (SELECT * FROM d WHERE CASE kind WHEN 1 THEN page = 0 WHEN 2 THEN page < 2 WHEN 3 THEN page = 0 OR page = 1 AND doc_id % {PAGE} < 2 ELSE true END)
SELECT 'f' || doc_id AS id, 'd' || n AS parent_id, 'folder ' || n || '/n' || doc_id || '.md' AS path, false AS is_dir, 7 AS mtime, 2 AS depth FROM told WHERE doc_id % 9 <> 4
UNION ALL SELECT DISTINCT 'd' || n, 'top', 'folder ' || n, true, 7, 1 FROM d""",
    "listing_broken": f"""WITH d AS (SELECT doc_id, doc_id // {FOLDER} AS n, (doc_id // {FOLDER}) % 5 AS kind, doc_id % {FOLDER} // {PAGE} AS page FROM documents)
SELECT 'd' || n AS dir_id, count(*) FILTER (CASE kind WHEN 1 THEN page = 0 WHEN 2 THEN page < 2 WHEN 3 THEN page = 0 OR page = 1 AND doc_id % {PAGE} < 2 ELSE kind = 0 END) AS n,
       CASE WHEN any_value(kind) = 4 THEN 'JSONDecodeError' END AS error FROM d GROUP BY n""",
    "files_changed": "SELECT 's' || doc_id % 7 || '/n' || doc_id || '.md' AS path, CASE WHEN doc_id % 10 = 3 THEN 2 ELSE 1 END AS times FROM documents WHERE doc_id % 11 <> 0",
    "dup_split": FILES + """, files AS (SELECT path, md5(text) AS hash, length(text) AS size, doc_id % 3 <> 0 AS linked FROM d)
SELECT hash, coalesce(string_agg(path, ',' ORDER BY path) FILTER (linked), '') AS linked, coalesce(string_agg(path, ',' ORDER BY path) FILTER (NOT linked), '') AS local FROM files GROUP BY hash, size HAVING count(*) > 1""",
    "dedup_run": DUP_ACTIONS + """, gone AS (SELECT path FROM acts WHERE remove)
SELECT true AS enabled, path, CASE WHEN path IN (SELECT path FROM gone) THEN 'goes' ELSE 'stays' END AS what FROM files UNION ALL SELECT false, path, 'stays' FROM files""",
    "directory_entries": f"""SELECT DISTINCT 'd' || doc_id // {FOLDER} AS id, 'folder ' || doc_id // {FOLDER} AS name, true AS is_dir, 0::BIGINT AS size, 7 AS mtime, 5 AS ctime FROM documents
UNION ALL SELECT 'f' || doc_id, 'n' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.note' ELSE '.md' END, false, 0, 7, 5 FROM documents WHERE doc_id // {FOLDER} = 4 AND doc_id % 9 <> 4""",
    "feed_followed": "SELECT user_id AS id, max(event_id) + 1 AS version, max_by(event_type, event_id) AS name, 1 AS reloads FROM events GROUP BY 1",
    "feed_gaps": "SELECT user_id AS id, max(event_id) + 1 AS version, max_by(event_type, event_id) AS name, 2 AS reloads FROM events GROUP BY 1",
    "watcher_runs": """WITH RECURSIVE e AS (SELECT 'u' || user_id AS root, epoch_us(ts) AS us, 'p' || event_id % 7 AS path FROM events WHERE event_type <> 'error' AND event_id % 5 <> 0),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY root ORDER BY us) < 1800000000 THEN 0 ELSE 1 END AS new FROM e),
b AS (SELECT *, sum(new) OVER (PARTITION BY root ORDER BY us) AS burst FROM g),
t AS (SELECT root, 'changes' AS kind, min(us) AS started, max(us) + 1800000000 AS ended, count(*) AS changes, count(DISTINCT path) AS paths FROM b GROUP BY root, burst
  UNION ALL SELECT 'u' || user_id, 'poll', epoch_us(ts), epoch_us(ts), 0, 0 FROM events WHERE event_type = 'error'),
o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY ended, kind) AS n FROM t),
r AS (SELECT root, n, true AS accepted, ended + 7200000000 AS until FROM o WHERE n = 1
  UNION ALL SELECT o.root, o.n, r.until <= o.ended, CASE WHEN r.until <= o.ended THEN o.ended + 7200000000 ELSE r.until END FROM r JOIN o ON o.root = r.root AND o.n = r.n + 1)
SELECT root, kind, started, ended, changes, paths, accepted FROM o JOIN r USING (root, n)""",
    "sync_committed": f"SELECT 'files' AS kind, path, file_id AS id, last_sync_at AS at FROM ({STORED['sync_recorded']}) UNION ALL SELECT 'log', path, cloud_id, timestamp FROM ({STORED['sync_recorded_log']})",
    "scan_committed": f"SELECT 'files' AS kind, path AS key, file_id AS value FROM ({STORED['scan_saved_files']}) UNION ALL SELECT 'dirs', path, dir_id FROM ({STORED['scan_saved_dirs']}) UNION ALL SELECT 'state', key, value FROM ({STORED['scan_saved_state']})",
    "gc_committed": f"""WITH gone AS ({STORED['gc_removed']}), held AS (SELECT 'files' AS kind, path AS key, 'file' AS rule FROM ({SNAPSHOTS} SELECT path FROM base)
  UNION ALL SELECT 'log', event_id::VARCHAR, 'log' FROM events UNION ALL SELECT 'refs', path, 'reference' FROM ({SNAPSHOTS} SELECT path FROM base))
SELECT kind, key FROM held WHERE (rule, key) NOT IN (SELECT (kind, key) FROM gone)""",
    "merkle_names": """WITH d AS (SELECT 'd' || (doc_id // 40) % 9 AS top, list_value('a', 'A', 'b', 'B c', 'a.md', 'a-b', 'é', 'Z')[doc_id % 8 + 1] AS stem, doc_id, md5(text) AS hash FROM documents),
low AS (SELECT top, stem AS name, md5(string_agg(doc_id || ':' || hash, '|' ORDER BY doc_id::VARCHAR COLLATE en, doc_id::VARCHAR)) AS hash FROM d WHERE doc_id % 3 = 0 GROUP BY ALL),
mid AS (SELECT top, name, hash FROM low UNION ALL SELECT top, stem || '.' || doc_id || ' x', hash FROM d WHERE doc_id % 3 <> 0),
tops AS (SELECT top, md5(string_agg(name || ':' || hash, '|' ORDER BY name COLLATE en, name)) AS hash FROM mid GROUP BY top)
SELECT top || '/' || name AS dir, hash AS tree_hash FROM low UNION ALL SELECT top, hash FROM tops
UNION ALL SELECT '', md5(string_agg(top || ':' || hash, '|' ORDER BY top COLLATE en, top)) FROM tops""",
    "deep_paths": """WITH d AS (SELECT doc_id AS id, doc_id // 100 AS chain, doc_id % 100 AS place FROM documents WHERE doc_id % 100 < 98)
SELECT id, string_agg('n' || place % 10, '/') OVER (PARTITION BY chain ORDER BY place) AS path, place::INTEGER AS depth FROM d""",
}
