"""Move detection: pair paths that went with paths that came, in stages.

Every stage is a join on its own key with at most one partner each way, in the
order of the paths.  What a stage pairs is written to the shared folder and
taken from both sides before the next one, so the plan of a stage never holds
the stages before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.names import basename, dirname, sanitize
from skerry.operators.reconcile import usable
from skerry.sources.staging import dropped, numbered, written

# Names too common to pair by.
GENERIC_NAMES = ("readme.md", "index.md", "index.html", "todo.md", "notes.md", "changelog.md", "license.md", "config.json", "package.json", ".gitignore", "makefile", "dockerfile")
MAX_CANDIDATES = 10
PAIRS = "old_path string, new_path string"


def primary_hash(local: Column, content: Column, cloud: Column) -> Column:
    """The first usable hash of the local file, the baseline and its remote side."""
    return F.coalesce(usable(local), usable(content), usable(cloud))


def deleted_hashes(primary: Column, content: Column, cloud: Column) -> Column:
    """Hashes that a deleted path may be found by: its primary one or, without
    it, the baseline's remote and local ones."""
    rest = F.array_distinct(F.array_compact(F.array(usable(cloud), usable(content))))
    return F.when(usable(primary).isNotNull(), F.array(primary)).otherwise(rest)


def _by_rank(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The nth old path of a key with its nth new one."""
    side = lambda df, name: numbered(df.select(F.col("path").alias(name), key), [key], [name])
    return side(old, "old_path").join(side(new, "new_path"), [key, "n"]).where("old_path <> new_path").select("old_path", "new_path")


def by_id(old: DataFrame, new: DataFrame) -> DataFrame:
    """old (path, file_id), new (path, file_id) -> old_path, new_path with the same id."""
    return _by_rank(old.where("file_id <> ''"), new.where("file_id <> ''"), "file_id")


def by_sibling_name(old: DataFrame, new: DataFrame) -> DataFrame:
    """Same directory, same sanitised name: a key's first old and last new path."""
    keyed = lambda df: df.groupBy(dirname("path").alias("d"), sanitize(basename("path")).alias("k"))
    pairs = keyed(old).agg(F.min("path").alias("old_path")).join(keyed(new).agg(F.max("path").alias("new_path")), ["d", "k"])
    return pairs.where("old_path <> new_path").select("old_path", "new_path")


def by_hash(old: DataFrame, new: DataFrame) -> DataFrame:
    """Equal usable hashes, the nth old path with the nth new one.

    An old side with a column ``hashes`` is paired by the first of them and, for
    what is left of both sides, by the second.
    """
    if "hashes" not in old.columns:
        return _by_rank(old.where("hash <> ''"), new.where("hash <> ''"), "hash")
    new = new.where("hash <> ''").select("path", "hash")
    take = lambda df, k: df.select("path", F.get("hashes", F.lit(k)).alias("hash")).where("hash <> ''")
    first = written(_by_rank(take(old, 0), new, "hash"), "pairs")
    rest = take(old.join(first.select(F.col("old_path").alias("path")), "path", "left_anti"), 1)
    return first.unionByName(_by_rank(rest, new.join(first.select(F.col("new_path").alias("path")), "path", "left_anti"), "hash"))


def _shared(a: Column, b: Column) -> Column:
    """How many leading folders two arrays have in common."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def _folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def by_name(old: DataFrame, new: DataFrame) -> DataFrame:
    """Same lower-cased sanitised name anywhere; the partner shares most folders.

    Generic names and names of more than ``MAX_CANDIDATES`` new paths don't pair,
    paths without a common folder only if one is at the root and one candidate
    is left, and paths with two different known hashes only if the old one has a
    file id.  Old paths choose in their order, each among what is left.

    How an old path chooses depends on nothing but the folders it shares with each
    candidate, whether its hash allows each, and whether it is at the root.  There
    are a few such kinds for a name, and a name's candidates can be won at most
    ``MAX_CANDIDATES`` times, so each kind's first paths are all that matter: a
    name with a million old paths is cut down to those before it is gathered.
    """
    key = F.lower(sanitize(basename("path")))
    known = F.coalesce(usable(F.col("hash")), F.lit(""))
    # one more than may pair tells a name with too many, however many there are
    some = new.select(key.alias("k"), "path", known.alias("hash")).withColumn("_n", F.row_number().over(Window.partitionBy("k").orderBy("path"))).where(F.col("_n") <= MAX_CANDIDATES + 1)
    few = some.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("path", "hash"))).alias("found")).where(F.size("found") <= MAX_CANDIDATES)
    few = written(few, "candidates")  # a plain shuffle, so that a very common name's join can be split
    linked = F.col("linked") if "linked" in old.columns else F.col("file_id") != ""
    rows = old.withColumn("k", key).where(~F.col("k").isin(*GENERIC_NAMES)).select("k", "path", known.alias("hash"), linked.alias("linked")).join(few, "k")
    here = _folders(F.col("path"))
    kind = F.transform("found", lambda x: F.struct(_shared(here, _folders(x["path"])).alias("depth"), (F.col("linked") | (F.col("hash") == "") | (x["hash"] == "") | (F.col("hash") == x["hash"])).alias("allowed"), (F.size(_folders(x["path"])) == 0).alias("root")))
    rows = rows.select("k", "path", (F.size(here) == 0).alias("root"), kind.alias("kind"), F.transform("found", lambda x: x["path"]).alias("found"))
    first = Window.partitionBy("k", "root", "kind").orderBy("path")
    rows = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= MAX_CANDIDATES).drop("_n")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, left = None, []
        for batch in batches:
            pairs = []
            for r in batch.to_pylist():
                if r["k"] != name:
                    name, left = r["k"], list(range(len(r["found"])))
                if not left:
                    continue
                best = max(left, key=lambda j: r["kind"][j]["depth"])  # the first of the deepest
                to = r["kind"][best]
                near = to["depth"] > 0 or (len(left) == 1 and (r["root"] or to["root"]))
                if near and to["allowed"]:
                    pairs.append((r["path"], r["found"][best]))
                    left.remove(best)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], ["old_path", "new_path"])

    return rows.repartition("k").sortWithinPartitions("k", "path").mapInArrow(choose, PAIRS)


STAGES = {"id": by_id, "sibling": by_sibling_name, "hash": by_hash, "name": by_name}


def run_stages(rows: DataFrame, steps: list[tuple[str, str, str]]) -> DataFrame:
    """old_path, new_path, stage of steps (stage, old state, new state), each
    over the rows (path, state, file_id, hash, and perhaps hashes) that are left.

    A step that lacks one side is skipped.
    """
    rows, found = written(rows, "sides"), None
    there = {r["state"] for r in rows.select("state").distinct().collect()}  # a handful of states
    for stage, old, new in steps:
        if old not in there or new not in there:
            continue
        pairs = written(STAGES[stage](*(rows.where(F.col("state") == s) for s in (old, new))).withColumn("stage", F.lit(stage)), "pairs")
        found = pairs if found is None else found.unionByName(pairs)
        if not pairs.isEmpty():  # what is left is written, so no stage takes away again what those before took
            left = written(rows.join(pairs.select(F.explode(F.array("old_path", "new_path")).alias("path")), "path", "left_anti"), "sides")
            dropped(rows)
            rows = left
    return found if found is not None else rows.select(F.col("path").alias("old_path"), F.col("path").alias("new_path"), F.col("path").alias("stage")).limit(0)


def cascade(old: DataFrame, new: DataFrame) -> DataFrame:
    """old_path, new_path, stage: all stages, each over what the ones before left.

    Both sides: path, file_id, hash.
    """
    side = lambda df, state: df.select("path", "file_id", "hash").withColumn("state", F.lit(state))
    return run_stages(side(old, "old").unionByName(side(new, "new")), [(stage, "old", "new") for stage in STAGES])


def apply_moves(classified: DataFrame, moves: DataFrame) -> DataFrame:
    """New paths become moved with their old path, old paths are gone."""
    ends = moves.select(F.col("new_path").alias("path"), F.col("old_path").alias("moved_from")).unionByName(moves.select(F.col("old_path").alias("path"), F.lit(None).cast("string").alias("moved_from")))
    out = classified.join(ends.withColumn("left_for", F.col("moved_from").isNull()), "path", "left")
    state = F.when(F.col("moved_from").isNotNull(), "moved").when(F.col("left_for"), "gone").otherwise(F.col("state"))
    return out.withColumn("state", state).withColumnRenamed("moved_from", "old_path").drop("left_for")
