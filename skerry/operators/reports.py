"""Counts and reports: timings, hash repairs, downloads, line differences, notes' tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import names
from skerry.functions.names import BLANKS, col
from skerry.functions.text import has_table
from skerry.operators.reconcile import usable


def timing_report(phases: DataFrame, wall: Column | str | None = None) -> DataFrame:
    """phase, ms, time, share of the wall clock (by default of all phases)."""
    total = phases.agg(F.sum("ms").alias("total"))  # one row
    rows = phases.groupBy("phase").agg(F.sum("ms").alias("ms")).crossJoin(F.broadcast(total))
    return rows.select("phase", "ms", names.milliseconds("ms").alias("time"), names.percent("ms", "total" if wall is None else wall).alias("share"))


def hash_repairs(base: DataFrame, local: DataFrame, prefix: str = "") -> DataFrame:
    """path, status (missing, mismatched, same) and the hash to store."""
    rows = base.where(F.col("path").startswith(prefix)).select("path", "content_hash").join(local.select("path", F.col("local_hash").alias("hash")), "path", "left")
    status = F.when(F.col("hash").isNull(), "missing").when(F.col("hash").eqNullSafe(F.col("content_hash")), "same").otherwise("mismatched")
    return rows.select("path", status.alias("status"), "hash")


def repair_counts(repairs: DataFrame, dry_run: bool = False) -> DataFrame:
    """One row: scanned, mismatched, fixed, missing."""
    differ = F.count_if(F.col("status") == "mismatched")
    return repairs.agg(F.count("*").alias("scanned"), differ.alias("mismatched"), (differ * F.lit(0 if dry_run else 1)).alias("fixed"), F.count_if(F.col("status") == "missing").alias("missing"))


def listing_summary(rows: DataFrame) -> DataFrame:
    """Folders and files of a listing, each with their number and size."""
    return rows.groupBy(F.when(F.col("is_dir"), "folder").otherwise("file").alias("type")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def task_counts(tasks: DataFrame) -> DataFrame:
    """One row: total, succeeded, failed of (ok)."""
    return tasks.agg(F.count("*").alias("total"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))


def action_counters(done: DataFrame) -> DataFrame:
    """One row: what the executed actions (action, ok) came to."""
    counted = {"downloaded": "download", "uploaded": "upload", "moved": "move", "conflicts": "conflict", "deleted_cloud": "deleteCloud", "deleted_local": "deleteLocal", "skipped": "skip"}
    ok = F.coalesce(F.col("ok"), F.lit(False))
    return done.agg(*(F.count_if((F.col("action") == a) & ok).alias(n) for n, a in counted.items()), F.count_if(~ok).alias("errors"))


def recovery_verdict(wanted: DataFrame, rows: DataFrame, versions: DataFrame) -> DataFrame:
    """name, verdict: whether another program's rows and kept versions can restore a file."""
    n = wanted.select("name").join(rows.groupBy("name").agg(F.count("*").alias("n")), "name", "left").join(versions.groupBy("name").agg(F.count("*").alias("v")), "name", "left")
    verdict = F.when(F.col("n").isNull(), "desktop_checked_no_matching_rows").when(F.col("v").isNull(), "desktop_rows_no_backup_versions").otherwise("backup_versions_exist")
    return n.select("name", verdict.alias("verdict"))


def line_differences(pairs: DataFrame, key: str, left: str, right: str, most: int = 8) -> DataFrame:
    """key, line, left, right: the first ``most`` lines that differ by position.

    The lines of a pair are compared within its row, so nothing is shuffled.
    """
    missing = F.lit("(missing)")
    lines = F.arrays_zip(F.split(left, "\n").alias("l"), F.split(right, "\n").alias("r"))
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), F.coalesce(x["l"], missing).alias("left"), F.coalesce(x["r"], missing).alias("right")))
    differ = F.slice(F.filter(numbered, lambda x: x["left"] != x["right"]), 1, most)
    return pairs.select(key, F.explode(differ).alias("d")).select(key, "d.line", "d.left", "d.right")


def first_difference(left: Column | str, right: Column | str) -> Column:
    """Place of the first character that differs; null for equal texts."""
    a, b = col(left), col(right)
    split = lambda x: F.split(x, "")
    same = F.zip_with(split(a), split(b), lambda x, y: x.eqNullSafe(y))
    return F.when(a != b, F.array_position(same, False).cast("int") - 1)


def content_anomaly(text: Column | str) -> Column:
    """JSON, XML or HTML where Markdown is expected, by the first 50 characters; else null."""
    start = F.ltrim(F.substring(col(text), 1, 50), F.lit(BLANKS))
    return F.when(start.startswith('{"'), "JSON").when(start.startswith("<?xml"), "XML").when(start.rlike(r"(?i)^<(!DOCTYPE\s+html|html)"), "HTML")


def checked_markdown(markdown: Column | str, ext: str = "md") -> Column:
    """The converted text; an error if it is still JSON or XML."""
    kind = content_anomaly(markdown)
    raw = kind.isin("JSON", "XML") & F.lit(ext == "md")
    return F.when(raw, F.raise_error(F.concat(F.lit("unconverted "), kind))).otherwise(col(markdown))


def skip_empty(files: DataFrame) -> DataFrame:
    """hash, skip: a group whose first path is empty or can't be read isn't touched."""
    return files.groupBy("hash").agg(F.min_by("size", "path").alias("size")).select("hash", (F.coalesce(F.col("size"), F.lit(0)) == 0).alias("skip"))


def table_candidates(base: DataFrame, local: DataFrame, prefix: str = "") -> DataFrame:
    """Linked notes with a Markdown table in their local text (path, text)."""
    notes = base.where((F.col("domain") == names.NOTE_DOMAIN) & usable(F.col("file_id")).isNotNull() & F.col("path").startswith(prefix))
    return notes.join(local.where(has_table("text")), "path", "left_semi").select("path", "file_id")


PARAGRAPHS = "array<struct<`5`:array<struct<`7`:array<struct<`8`:string>>>>>>"


def paragraph_texts(note: Column | str) -> Column:
    """Text of each paragraph of a rich note, by its JSON shape alone."""
    blocks = F.from_json(F.get_json_object(col(note), "$.5"), PARAGRAPHS)
    spans = lambda b: F.flatten(F.transform(F.coalesce(b["5"], F.array()), lambda c: F.transform(F.coalesce(c["7"], F.array()), lambda s: F.coalesce(s["8"], F.lit("")))))
    return F.transform(blocks, lambda b: F.array_join(spans(b), ""))


TABLES = "array<struct<`4`:struct<version:string,cw:array<double>,rh:array<double>>,`6`:string>>"


def missing_table_attributes(note: Column | str) -> Column:
    """Which of version, cw and rh the tables of a rich note lack, each once."""
    tables = F.filter(F.from_json(F.get_json_object(col(note), "$.5"), TABLES), lambda b: b["6"] == "t")
    lacks = lambda b: F.array_compact(F.array(*(F.when(b["4"][c].isNull(), c) for c in ("version", "cw", "rh"))))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(tables, lacks))))


def top_attributes_differ(left: Column | str, right: Column | str) -> Column:
    """Which top-level attributes of two rich notes differ."""
    keys = ("2", "4", "__compress__", "title")  # fixed values
    part = lambda x, k: F.get_json_object(col(x), f"$.{k}")
    return F.array_compact(F.array(*(F.when(~part(left, k).eqNullSafe(part(right, k)), k) for k in keys)))


def table_shape(note: Column | str) -> Column:
    """native-table, pipe-text or no-table, from the JSON of a rich note."""
    kinds = F.from_json(F.get_json_object(col(note), "$.5"), "array<struct<`6`:string>>")
    native = F.exists(F.coalesce(kinds, F.array().cast("array<struct<`6`:string>>")), lambda b: F.coalesce(b["6"] == "t", F.lit(False)))
    pipes = F.exists(F.coalesce(paragraph_texts(note), F.array().cast("array<string>")), lambda t: t.rlike(r"^\|.*\|$"))
    return F.when(native, "native-table").when(pipes, "pipe-text").otherwise("no-table")


def inspect_tables(targets: DataFrame, base: DataFrame, notes: DataFrame) -> DataFrame:
    """path, status (ok, miss, skip, error), shape: notes (file_id, json)."""
    rows = targets.select("path").join(base.select("path", "file_id", "domain"), "path", "left").join(notes, "file_id", "left")
    status = F.when(usable(F.col("file_id")).isNull(), "miss").when(F.col("domain") != names.NOTE_DOMAIN, "skip").when(F.get_json_object("json", "$.2").isNull(), "error").otherwise("ok")
    return rows.select("path", status.alias("status"), F.when(status == "ok", table_shape("json")).alias("shape"))


def verified_notes(inspected: DataFrame, planned: DataFrame) -> DataFrame:
    """path, verified: a native table and nothing left to push."""
    rows = inspected.join(planned.select("path", "state"), "path", "left")
    return rows.select("path", F.coalesce((F.col("shape") == "native-table") & F.col("state").isin("synced", "cloudModifiedMtimeOnly"), F.lit(False)).alias("verified"))


def compare_notes(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """key, same, shapes, differing attributes, first differing character."""
    return pairs.select(key, (F.col(left) == F.col(right)).alias("same"), F.concat_ws("/", table_shape(left), table_shape(right)).alias("shapes"), F.array_join(top_attributes_differ(left, right), ",").alias("attributes"), first_difference(left, right).alias("at"))


def extension_counts(rows: DataFrame, name: Column | str, most: int = 0) -> DataFrame:
    """ext, n by extension, most frequent first; 0 is no limit."""
    ext = names.extension(name)
    out = rows.groupBy(F.when(ext == "", "(no ext)").otherwise(ext).alias("ext")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "ext").limit(most) if most else out


def local_categories(files: DataFrame, path: Column | str, size: str = "size") -> DataFrame:
    """category (md, note, images, other), n, bytes: the first test that holds decides."""
    ext = names.extension(path)
    inside = col(path).contains("/images/") | col(path).contains("/attachments/")
    kind = F.when(ext == "md", "md").when(ext == "note", "note").when(inside, "images").otherwise("other")
    return files.groupBy(kind.alias("category")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))


def doubled_notes(files: DataFrame) -> DataFrame:
    """Stems (of name) that have both a Markdown and a note file."""
    ext = names.extension("name")
    both = files.groupBy(names.stem("name").alias("stem")).agg(F.bool_or(ext == "md").alias("md"), F.bool_or(ext == "note").alias("note"))
    return both.where("md AND note").select("stem")


def duplicate_summary(groups: DataFrame, most: int = 10) -> DataFrame:
    """The first groups (name, n, category) of each category, by size and name."""
    n = Window.partitionBy("category").orderBy(F.desc("n"), "name")
    return groups.withColumn("_n", F.row_number().over(n)).where(F.col("_n") <= most).drop("_n")


def dry_run_lines(planned: DataFrame) -> DataFrame:
    """Lines of a report: every path that isn't skipped, by phase, action and path.

    Sorted by ranges, so the report is as long as it has to be.
    """
    from skerry.operators.reconcile import phase

    rows = planned.where("action <> 'skip'").withColumn("phase", phase(F.col("action")))
    return rows.select("phase", "action", F.concat(F.lit("- "), "path", F.lit(" ("), "state", F.lit(")")).alias("line")).orderBy("phase", "action", "line")


def is_audio_note(text: Column | str) -> Column:
    """A voice note's JSON: its list of records is named in the first 120 characters."""
    return F.substring(col(text), 1, 120).contains('"recordList"') & F.get_json_object(col(text), "$.recordList").isNotNull()
