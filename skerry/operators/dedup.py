"""Duplicate files: groups by content hash, which copy stays, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.names import basename, dirname, is_asset
from skerry.operators.reconcile import usable
from skerry.sources.staging import written


def groups(files: DataFrame) -> DataFrame:
    """hash, size and number of files for each (hash, size) with several files."""
    return files.where("hash <> ''").groupBy("hash", "size").agg(F.count("*").alias("n")).where("n > 1")


def all_but_newest(base: DataFrame) -> DataFrame:
    """path, hash of every file but the last synced one of its hash."""
    rows = base.where(usable(F.col("content_hash")).isNotNull()).select("path", "content_hash", "last_sync_at")
    kept = rows.groupBy("content_hash").agg(F.min(F.struct((-F.col("last_sync_at")).alias("age"), "path"))["path"].alias("_kept"))
    return rows.join(kept, "content_hash").where("path <> _kept").select("path", "content_hash")


def score(path: Column) -> list[Column]:
    """Ascending sort keys, best first: deeper, then shorter name."""
    return [-F.size(F.split(path, "/")), F.length(basename(path))]


def actions(files: DataFrame, referenced: DataFrame) -> DataFrame:
    """path, keep, remove, reason for each file of a duplicate group.

    files: path, hash, size, file_id, create_time.  A group with linked and
    unlinked files keeps its first linked one and drops unlinked copies, unless
    one is a referenced asset; a group of linked files keeps the best (for
    assets, all that are referenced); a group without any link stays.  Groups are
    aggregated and joined back, so that a very common hash can be split.
    """
    linked, ref = F.col("file_id") != "", F.coalesce(F.col("ref"), F.lit(False))
    rows = files.where("hash <> ''").join(referenced.select("path").distinct().withColumn("ref", F.lit(True)), "path", "left")
    rows = rows.where("size > 0 OR size IS NULL").withColumn("_size", F.coalesce("size", F.lit(-1)))
    keys = [(~linked).alias("a"), *(k.alias(n) for k, n in zip(score(F.col("path")), "bc", strict=True)), F.col("create_time").alias("d"), "path"]
    sums = rows.groupBy("hash", "_size").agg(F.count("*").alias("n"), F.count_if(linked).alias("n_linked"), F.count_if(ref & linked).alias("n_refs"), F.min(F.when(linked, F.col("path"))).alias("first"), F.min(F.struct(*keys))["path"].alias("best")).where("n > 1")
    rows, first, best = rows.join(sums, ["hash", "_size"]), F.col("first"), F.col("best")
    mixed = (F.col("n_linked") >= 1) & (F.col("n_linked") < F.col("n"))
    whole = F.col("n_linked") == F.col("n")
    asset = is_asset("path")
    remove = (
        F.when(mixed, ~linked & ~(ref & asset))
        .when(whole & asset & (F.col("n_refs") > 0), ~ref)
        .when(whole, F.col("path") != best)
        .otherwise(False)
    )
    reason = F.when(mixed, F.when(~linked & ref & asset, "referenced").otherwise("mixed")).when(whole & asset & (F.col("n_refs") > 0), "assets").when(whole, "best").otherwise("unlinked")
    return rows.select("path", F.when(mixed, first).when(whole, best).alias("keep"), remove.alias("remove"), reason.alias("reason"))


def categories(files: DataFrame) -> DataFrame:
    """name, n, category of files that share a base name: files (path, text)."""
    plain = F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n"))
    per = files.groupBy(basename("path").alias("name")).agg(F.count("*").alias("n"), F.count_distinct(F.md5("text")).alias("raw"), F.count_distinct(F.md5(plain)).alias("normal")).where("n > 1")
    category = F.when(F.col("raw") == 1, "identical").when(F.col("normal") == 1, "crlf_only").otherwise("real_diff")
    return per.select("name", "n", category.alias("category"))


def split(files: DataFrame) -> DataFrame:
    """hash, size, linked, local: the paths of each group that have a remote id, and
    those that don't, each in order."""
    paths = lambda which: F.array_sort(F.collect_list(F.when(which, F.col("path"))))
    linked = F.coalesce(usable(F.col("file_id")).isNotNull(), F.lit(False))
    return files.where("hash <> ''").groupBy("hash", "size").agg(paths(linked).alias("linked"), paths(~linked).alias("local")).where(F.size("linked") + F.size("local") > 1)


def run(files: DataFrame, referenced: DataFrame, enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files that stay, path and reason of those that go): what a sync does with
    duplicates before anything else; nothing goes unless it is ``enabled``."""
    gone = actions(files, referenced).where(F.col("remove") & F.lit(enabled)).select("path", "reason")
    return files.join(gone.select("path"), "path", "left_anti"), gone


def directory_links(files: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (class_a, class_b, shared) between classes of
    directories with ``least`` common hashes or more, a class with itself too;
    members (dir, class) of classes with ``least`` hashes.

    Directories with the same hashes are one class, so equal folders make one row
    however many they are.  A class is looked up by its rarest hashes only: of n
    hashes, the ``least`` - 1 most common can't make a pair without one of the
    others, which two similar classes share if their orders are the same.  What
    two classes share is counted on their whole sets, once for each pair.
    """
    own = files.where("hash <> ''").select(dirname("path").alias("dir"), "hash").distinct()
    sets = written(own.groupBy("dir").agg(F.sort_array(F.collect_set("hash")).alias("hashes")).where(F.size("hashes") >= least).withColumn("class", F.sha2(F.concat_ws("|", "hashes"), 256)), "sets")
    classes = written(sets.groupBy("class").agg(F.first("hashes").alias("hashes")), "classes")  # equal in a class
    listed = classes.select("class", F.size("hashes").alias("n"), F.explode("hashes").alias("hash"))
    rarity = listed.groupBy("hash").agg(F.count("*").alias("of"))
    place = Window.partitionBy("class").orderBy("of", "hash")  # a folder's hashes
    prefix = written(listed.join(rarity, "hash").withColumn("at", F.row_number().over(place)).where(F.col("at") <= F.col("n") - (least - 1)).select("class", "n", "hash", "at"), "prefixes")
    side = lambda x: prefix.select("hash", *(F.col(c).alias(f"{c}_{x}") for c in ("class", "n", "at")))
    # at their first common hash, what follows on both sides must still be enough
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + 1
    candidates = side("a").join(side("b"), "hash").where("class_a < class_b").groupBy("class_a", "class_b").agg(F.max(room).alias("room")).where(F.col("room") >= least)
    whole = lambda x: classes.select(F.col("class").alias(f"class_{x}"), F.col("hashes").alias(f"hashes_{x}"))
    shared = candidates.join(whole("a"), "class_a").join(whole("b"), "class_b").select("class_a", "class_b", F.size(F.array_intersect("hashes_a", "hashes_b")).cast("long").alias("shared"))
    itself = classes.select(F.col("class").alias("class_a"), F.col("class").alias("class_b"), F.size("hashes").cast("long").alias("shared"))
    return shared.where(F.col("shared") >= least).unionByName(itself), sets.select("dir", "class")


def directory_pairs(files: DataFrame, least: int = 3) -> DataFrame:
    """Pairs of directories with ``least`` common hashes or more, written out from
    the links of their classes."""
    links, members = directory_links(files, least)
    both = links.unionByName(links.where("class_a <> class_b").select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b"), "shared"))
    side = lambda x: members.select(F.col("dir").alias(f"dir_{x}"), F.col("class").alias(f"class_{x}"))
    return both.join(side("a"), "class_a").join(side("b"), "class_b").where("dir_a < dir_b").select("dir_a", "dir_b", "shared")


def orphans(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local-only files whose name and hash a file on both sides has."""
    key = lambda df: df.select("path", F.lower(basename("path")).alias("name"), F.col("local_hash").alias("hash")).where("hash <> ''")
    both = key(local.join(remote.select("path"), "path", "left_semi"))
    only = key(local.join(remote.select("path"), "path", "left_anti"))
    return only.join(both.select("name", "hash").distinct(), ["name", "hash"], "left_semi").select("path")


def references(docs: DataFrame) -> DataFrame:
    """source_path, ref_path: local targets of Markdown and HTML references, by
    the directory of the document (path, text)."""
    targets = F.concat(
        F.regexp_extract_all("text", F.lit(r"!?\[[^\]]*\]\(([^)\s]+)"), 1),
        F.regexp_extract_all("text", F.lit(r"""(?:src|href)=["']([^"']+)["']"""), 1),
    )
    rows = docs.select(F.col("path").alias("source_path"), dirname("path").alias("dir"), F.explode(F.array_distinct(targets)).alias("target"))
    rows = rows.where(~F.col("target").rlike(r"^([a-zA-Z][a-zA-Z0-9+.-]*:|/|#)"))
    clean = F.regexp_replace(F.col("target"), r"^\./|[?#].*$", "")
    return rows.select("source_path", F.concat_ws("/", F.nullif(F.col("dir"), F.lit("")), clean).alias("ref_path")).distinct()


def reference_lists(edges: DataFrame) -> DataFrame:
    """source_path, refs: the references of each document in order, each once."""
    return edges.groupBy("source_path").agg(F.array_sort(F.collect_set("ref_path")).alias("refs"))
