"""Reconciliation: join three snapshots by path, derive tri-state predicates,
classify by a decision table, refine by content, and plan actions.

The snapshots are joined once on ``path`` and everything after is a projection,
so the whole classification is one shuffle per snapshot and whole-stage code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICY = "1.0"
ANY = object()

# The decision table.  Columns: local exists, remote exists,
# previously synced, local hash changed, remote mtime changed, local mtime
# changed; ANY is not looked at, None matches only unknown.
RULES: tuple[tuple[tuple, str], ...] = (
    ((False, False, ANY, ANY, ANY, ANY), "gone"),
    ((True, False, False, ANY, ANY, ANY), "localNew"),
    ((True, False, True, ANY, ANY, True), "cloudDeletedLocalModified"),
    ((True, False, True, ANY, ANY, False), "cloudDeleted"),
    ((True, False, True, ANY, ANY, None), "cloudDeleted"),
    ((False, True, False, ANY, ANY, ANY), "cloudNew"),
    ((False, True, True, ANY, True, ANY), "localDeletedCloudModified"),
    ((False, True, True, ANY, False, ANY), "localDeleted"),
    ((False, True, True, ANY, None, ANY), "localDeleted"),
    ((True, True, ANY, False, False, ANY), "synced"),
    ((True, True, ANY, False, True, ANY), "cloudModifiedContent"),
    ((True, True, ANY, True, False, ANY), "localModified"),
    ((True, True, ANY, True, True, ANY), "conflict"),
    ((True, True, ANY, False, None, ANY), "synced"),
    ((True, True, ANY, True, None, ANY), "cloudModifiedContent"),
    ((True, True, ANY, None, False, ANY), "synced"),
    ((True, True, ANY, None, True, ANY), "cloudModifiedContent"),
    ((True, True, ANY, None, None, ANY), "synced"),
)
CONDITIONS = ("local_exists", "cloud_exists", "previously_synced", "local_hash_changed", "cloud_mtime_changed", "local_mtime_changed")

# The refinement table.  Columns: remote hash equals local hash,
# local hash changed, remote hash equals baseline's.
REFINE_RULES: tuple[tuple[tuple, str], ...] = (
    ((True, False, ANY), "cloudModifiedMtimeOnly"),
    ((True, True, ANY), "bothModifiedConverged"),
    ((False, False, ANY), "cloudModifiedContent"),
    ((False, True, True), "localModified"),
    ((False, True, False), "conflict"),
)

# The action of each state.
ACTIONS = {
    "synced": "skip", "cloudModifiedMtimeOnly": "skip", "bothModifiedConverged": "skip", "localDeleted": "skip", "cloudDeleted": "skip", "gone": "skip",
    "localNew": "upload", "localModified": "upload", "cloudDeletedLocalModified": "upload",
    "cloudNew": "download", "cloudModifiedContent": "download", "localDeletedCloudModified": "download",
    "conflict": "conflict", "moved": "move",
}
DELETES = {"localDeleted": "deleteCloud", "cloudDeleted": "deleteLocal"}
REFINABLE = ("cloudModifiedContent", "conflict")


def joined(remote: DataFrame, local: DataFrame, base: DataFrame) -> DataFrame:
    """One row for each path of any snapshot; structs ``r``, ``l``, ``b`` (null where absent)."""
    side = lambda df, name: df.select("path", F.struct(*df.columns).alias(name))
    return side(remote, "r").join(side(local, "l"), "path", "full").join(side(base, "b"), "path", "full")


def usable(x: Column) -> Column:
    """An empty id or hash counts as a missing one."""
    return F.nullif(x, F.lit(""))


def conditions(df: DataFrame) -> DataFrame:
    """Adds the six predicates of :data:`CONDITIONS`; three may be null."""
    r, l, b = F.col("r"), F.col("l"), F.col("b")  # noqa: E741
    known = b.isNotNull()
    synced = known & usable(b["file_id"]).isNotNull() & (b["last_sync_at"] > 0)
    remote_changed = F.when(b["cloud_mtime"] > 0, r["mtime"] > b["cloud_mtime"]).when(b["cloud_mtime"] == 0, True)
    local_changed = F.when(b["local_mtime"] > 0, l["mtime"] > b["local_mtime"]).otherwise(True)
    return df.withColumns(
        {
            "local_exists": l.isNotNull(),
            "cloud_exists": r.isNotNull(),
            "previously_synced": F.coalesce(synced, F.lit(False)),
            "local_hash_changed": usable(l["local_hash"]) != usable(b["content_hash"]),
            "cloud_mtime_changed": F.when(r.isNotNull() & known & (b["last_sync_at"] > 0), remote_changed),
            "local_mtime_changed": F.when(l.isNotNull() & known, local_changed),
        }
    )


def decide(rules: tuple[tuple[tuple, str], ...], columns: tuple[str, ...], value: Callable[[int, str], str]) -> Column:
    """CASE over a decision table: the first rule that matches null-safely.

    ``columns`` and ``value(i, state)``, the result of rule i, are SQL, so that a
    whole table is one expression to parse; no match is an error.
    """
    spell = {True: "true", False: "false", None: "NULL"}
    tests = (" AND ".join(f"({c}) <=> {spell[w]}" for c, w in zip(columns, when, strict=True) if w is not ANY) for when, _ in rules)
    cases = " ".join(f"WHEN {test} THEN {value(i, state)}" for i, (test, (_, state)) in enumerate(zip(tests, rules, strict=True)))
    return F.expr(f"CASE {cases} ELSE raise_error('no rule matches') END")


def matches(df: DataFrame) -> DataFrame:
    """Adds how many rules match a row's conditions; it should be one."""
    spell = {True: "true", False: "false", None: "NULL"}
    tests = (" AND ".join(f"{c} <=> {spell[w]}" for c, w in zip(CONDITIONS, when, strict=True) if w is not ANY) for when, _ in RULES)
    return df.withColumn("matches", F.expr(" + ".join(f"int({test})" for test in tests)))


def classify(df: DataFrame) -> DataFrame:
    """Adds state, decision_reason and policy_version to a table with the conditions."""
    both = decide(RULES, CONDITIONS, lambda i, s: f"named_struct('state', '{s}', 'decision_reason', 'rule_{i}_{s}')")
    return df.withColumn("_d", both).select(*df.columns, "_d.*", F.lit(POLICY).alias("policy_version"))


def classify_all(remote: DataFrame, local: DataFrame, base: DataFrame) -> DataFrame:
    return classify(conditions(joined(remote, local, base)))


def refine(df: DataFrame) -> DataFrame:
    """Second pass over contents, where both sides' hashes are known.

    A missing baseline hash counts as unchanged here, not as unknown.
    """
    here, there = "nullif(l.local_hash, '')", "nullif(r.cloud_hash, '')"
    columns = (f"{here} = {there}", f"coalesce({here} != b.content_hash, false)", f"coalesce({there} = b.cloud_content_hash, false)")
    again = F.col("state").isin(*REFINABLE) & F.expr(f"{here} IS NOT NULL AND {there} IS NOT NULL")
    refined = F.when(again, decide(REFINE_RULES, columns, lambda _, s: f"'{s}'")).otherwise(F.col("state"))
    return df.withColumn("state", refined)


def action_of(state: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))[state]


def filter_direction(state: Column, direction: str) -> Column:
    """``pull`` keeps downloads and conflicts, ``push`` uploads; what skips or moves always passes."""
    if direction == "both":
        return state
    kept = ("download", "conflict") if direction == "pull" else ("upload",)
    return F.when(action_of(state).isin("skip", "move", *kept), state).otherwise("gone")


def plan(df: DataFrame, direction: str = "both", propagate_deletes: bool = False) -> DataFrame:
    """path, state, action.  Delete overrides are taken after the direction filter."""
    out = df.withColumn("state", filter_direction(F.col("state"), direction))
    override = F.create_map(*(F.lit(x) for pair in DELETES.items() for x in pair))[F.col("state")] if propagate_deletes else F.lit(None).cast("string")
    return out.withColumn("action", F.coalesce(override, action_of(F.col("state"))))


def phase(action: Column, is_dir: Column | None = None) -> Column:
    """Order of execution: directories, downloads, uploads, then all else."""
    out = F.when(action == "download", 1).when(action == "upload", 2).otherwise(3)
    return out if is_dir is None else F.when(is_dir, 0).otherwise(out)


def dry_run_stats(planned: DataFrame) -> DataFrame:
    """One row: how many paths take each action, and all changes."""
    names = {"skip": "skipped", "upload": "uploads", "download": "downloads", "conflict": "conflicts", "move": "moves", "deleteCloud": "cloud_deletes", "deleteLocal": "local_deletes"}
    return planned.agg(*(F.count_if(F.col("action") == a).alias(n) for a, n in names.items()), F.count_if(F.col("action") != "skip").alias("changes"))


def grouped(planned: DataFrame) -> DataFrame:
    """action, n, digest: the number of its paths and the sum of 60 bits of their
    hashes, which doesn't depend on an order, so no group is gathered."""
    part = F.conv(F.substring(F.md5("path"), 1, 15), 16, 10).cast("decimal(20,0)")
    return planned.groupBy("action").agg(F.count("*").alias("n"), F.sum(part).cast("string").alias("digest"))


def guardrails(planned: DataFrame, remote: DataFrame, local: DataFrame, base: DataFrame, max_deletes: int = 5) -> DataFrame:
    """One row: counts and status.

    An empty remote beside local files aborts if more rows are linked than may
    be deleted; more pending deletes than that suspend.
    """
    one = lambda df, c, name: df.agg(c.alias(name))
    counts = one(remote, F.count("*"), "cloud_files").join(one(local, F.count("*"), "local_files")).join(one(base, F.count_if(F.col("file_id") != ""), "linked")).join(one(planned, F.count_if(F.col("action").isin("deleteCloud", "deleteLocal")), "pending_deletes"))
    status = F.when((F.col("cloud_files") == 0) & (F.col("local_files") > 0) & (F.col("linked") > max_deletes), "aborted").when(F.col("pending_deletes") > max_deletes, "suspended").otherwise("ok")
    return counts.withColumn("status", status)


def upload_warnings(df: DataFrame) -> DataFrame:
    """path and reasons of uploads that deserve a look."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("b").isNull(), "no baseline"),
            F.when(usable(F.col("l.local_hash")).isNull(), "no local hash"),
            F.when(usable(F.col("b.file_id")).isNull() & F.col("b").isNotNull(), "not linked"),
            F.when(F.col("l.local_hash") == F.col("b.content_hash"), "content unchanged"),
        )
    )
    return df.where(F.col("action") == "upload").select("path", F.array_join(reasons, "; ").alias("reasons"))


def exclude(df: DataFrame, allowed: Column) -> DataFrame:
    """Paths that a filter excludes are gone."""
    return df.withColumn("state", F.when(allowed, F.col("state")).otherwise("gone"))
