"""Rich notes as nested values: walked level by level, all notes at once.

A note is JSON of nested nodes.  It is parsed into a VARIANT, and every round
unfolds one level of all notes' values by expressions; the next level is written,
so neither the depth nor the number of notes is bounded by a plan or a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.names import col
from skerry.functions.variants import member, string, whole_json
from skerry.sources.staging import written

# The members of a node.
ATTRS, CHILDREN, KIND, SPANS, TEXT = "4", "5", "6", "7", "8"


def _members(node: Column) -> Column:
    """name, value of the members of an object (by name) or the elements of a list."""
    named = F.transform(F.map_entries(F.try_variant_get(node, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    listed = F.transform(F.try_variant_get(node, "$", "array<variant>"), lambda v: F.struct(F.lit(None).cast("string").alias("name"), v.alias("value")))
    return F.coalesce(named, listed)


def _walk(level: DataFrame, unfold: Column, keep: Column | None = None) -> DataFrame:
    """All levels of (key, place, name, value) below ``level``, each unfolded into the next."""
    level = written(level, "level")
    out = level
    while True:
        below = level.select("key", F.col("place").alias("_above"), F.posexplode(unfold).alias("_n", "_m"))
        below = below.select("key", F.concat("_above", F.array(F.col("_n"))).alias("place"), F.col("_m.name").alias("name"), F.col("_m.value").alias("value"))
        level = written(below if keep is None else below.where(keep), "level")
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def _roots(notes: DataFrame, key: str, note: str) -> DataFrame:
    parsed = whole_json(F.col(note))
    return notes.select(F.col(key).alias("key"), F.array().cast("array<int>").alias("place"), F.lit(None).cast("string").alias("name"), parsed.alias("value")).where("value IS NOT NULL")


def note_values(notes: DataFrame, key: str, note: str) -> DataFrame:
    """key, place, name, value: every value of each note at any depth.

    ``place`` is the way there, by position; sorted by it, a value comes before
    what is in it.  A note that isn't JSON has no values.
    """
    return _walk(_roots(notes, key, note), _members(F.col("value")))


def note_nodes(notes: DataFrame, key: str, note: str) -> DataFrame:
    """key, place, kind, value: each note's nodes, by their lists of children alone;
    a node without a kind has null.  Children that aren't objects are none."""
    children = F.transform(member("value", CHILDREN, "array<variant>"), lambda v: F.struct(F.lit(None).cast("string").alias("name"), v.alias("value")))
    is_object = F.try_variant_get("value", "$", "map<string,variant>").isNotNull()
    rows = _walk(_roots(notes, key, note), children, is_object).where(F.size("place") > 0)
    return rows.select("key", "place", string(member("value", KIND)).alias("kind"), "value")


def note_texts(notes: DataFrame, key: str, note: str) -> DataFrame:
    """key, texts: all texts of each note in order (members by name, a node's own
    text first); a note without one has an empty list."""
    text = F.when(F.col("name") == TEXT, string(F.col("value")))
    place = F.slice("place", 1, F.size("place") - 1)
    found = note_values(notes, key, note).select("key", F.struct(place.alias("place"), text.alias("text")).alias("t")).where("t.text <> ''")
    lists = found.groupBy("key").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["text"]).alias("texts"))
    return notes.select(F.col(key).alias("key")).join(lists, "key", "left").select("key", F.coalesce("texts", F.array().cast("array<string>")).alias("texts"))


def paragraph(node: Column) -> Column:
    """A paragraph node's text: the spans of its children."""
    none = F.array().cast("array<string>")
    spans = lambda c: F.array_compact(F.transform(F.coalesce(member(c, SPANS, "array<variant>"), F.array().cast("array<variant>")), lambda s: string(member(s, TEXT))))
    return F.array_join(F.coalesce(F.flatten(F.transform(member(node, CHILDREN, "array<variant>"), spans)), none), "")


def table_counts(notes: DataFrame, key: str, note: str) -> DataFrame:
    """key, tables and pipes (tables, and paragraphs typed as tables, at the top),
    rows and cells (at any depth), shape: for every note, zeros if it has none."""
    top, typed = F.size("place") == 1, F.trim(paragraph(F.col("value"))).startswith("|")
    untyped = member("value", KIND).isNull()
    nodes = note_nodes(notes, key, note)
    counts = nodes.groupBy("key").agg(F.count_if(top & (F.col("kind") == "t")).alias("tables"), F.count_if(top & untyped & typed).alias("pipes"), F.count_if(F.col("kind") == "tr").alias("rows"), F.count_if(F.col("kind") == "tc").alias("cells"))
    every = notes.select(F.col(key).alias("key")).join(counts, "key", "left").fillna(0, ["tables", "pipes", "rows", "cells"])
    return every.withColumn("shape", F.when(F.col("tables") > 0, "native-table").when(F.col("pipes") > 0, "pipe-text").otherwise("no-table"))


def push_error(answer: Column | str) -> Column:
    """(code, duplicate_id) of an error in a remote answer: the JSON object from its
    first brace on; null without an error.  A code is a string or a number."""
    raw = col(answer)
    parsed = whole_json(F.when(raw.contains("{"), F.substring(raw, F.instr(raw, "{"), F.length(raw))))
    error, other = member(parsed, "error"), member(parsed, "duplicateFileId")
    number = F.schema_of_variant(error).rlike("^(BIGINT|DECIMAL|DOUBLE)")
    code = F.nullif(F.coalesce(string(error), F.when(number, error.cast("string"))), F.lit(""))
    return F.when(code.isNotNull(), F.struct(code.alias("code"), F.nullif(string(other), F.lit("")).alias("duplicate_id")))
