"""Whole reconciliations: the operators composed, from three snapshots to a plan."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.names import allowed, is_artifact_dir
from skerry.operators import dedup, moves, reconcile, state
from skerry.sources.staging import written


class Options(NamedTuple):
    """direction: both, pull or push; include and exclude are globs."""

    direction: str = "both"
    propagate_deletes: bool = False
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    max_deletes: int = 5
    detect_moves: bool = True


#: Stages of move detection in order, with the states of old and new paths.
MOVE_STEPS = [
    ("id", "localNew", "cloudNew"),
    ("id", "cloudDeleted", "localNew"),
    ("id", "cloudDeleted", "cloudNew"),
    ("sibling", "cloudDeleted", "cloudNew"),
    ("sibling", "localDeleted", "localNew"),
    ("hash", "cloudDeleted", "cloudNew"),
    ("name", "cloudDeleted", "cloudNew"),
    ("hash", "localDeleted", "localNew"),
    ("name", "localDeleted", "localNew"),
    ("hash", "cloudNew", "localNew"),
    ("name", "cloudNew", "localNew"),
]


def find_moves(classified: DataFrame) -> DataFrame:
    """old_path, new_path, stage: by id, by sibling names, then deletions with
    arrivals on the same side, then paths that are new on both sides."""
    content, cloud = F.col("b.content_hash"), F.col("b.cloud_content_hash")
    primary = F.coalesce(moves.primary_hash(F.col("l.local_hash"), content, cloud), reconcile.usable(F.col("r.cloud_hash")), F.lit(""))
    known = F.coalesce(reconcile.usable(F.col("r.id")), F.col("b.file_id"), F.lit(""))
    rows = classified.select("path", "state", known.alias("file_id"), primary.alias("hash"), moves.deleted_hashes(primary, content, cloud).alias("hashes"), F.coalesce(F.col("b.file_id") != "", F.lit(False)).alias("linked"))
    return moves.run_stages(rows.where(F.col("state").isin("localNew", "cloudNew", "localDeleted", "cloudDeleted")), MOVE_STEPS)


def reconcile_all(remote: DataFrame, local: DataFrame, base: DataFrame, options: Options = Options()) -> DataFrame:
    """path, state, action, old_path, phase, guardrail: every path of any snapshot.

    Classify, drop what a filter excludes, pair moves, drop local copies of
    synced files, refine by content, then direct and plan.
    """
    df = reconcile.classify_all(remote, local, base)
    if options.include or options.exclude:
        df = reconcile.exclude(df, allowed("path", list(options.include), list(options.exclude)))
    if options.detect_moves:
        df = written(df, "classified")
        df = moves.apply_moves(df, find_moves(df))
    else:
        df = df.withColumn("old_path", F.lit(None).cast("string"))
    loose = dedup.orphans(local, remote).withColumn("loose", F.lit(True))
    df = df.join(loose, "path", "left").withColumn("state", F.when(F.col("loose") & (F.col("state") == "localNew"), "gone").otherwise(F.col("state")))
    planned = reconcile.plan(reconcile.refine(df), options.direction, options.propagate_deletes)
    if options.detect_moves:
        planned = written(planned.select("path", "state", "action", "old_path"), "planned")
    checks = reconcile.guardrails(planned, remote, local, base, options.max_deletes).select(F.col("status").alias("guardrail"))
    return planned.select("path", "state", "action", "old_path", reconcile.phase(F.col("action")).alias("phase")).join(F.broadcast(checks))  # one row


def explain(remote: DataFrame, local: DataFrame, base: DataFrame, targets: Column) -> DataFrame:
    """What decided the given paths: conditions, rule, refined state and action."""
    df = reconcile.classify_all(remote, local, base).where(targets)
    first = df.select("path", *reconcile.CONDITIONS, "state", "decision_reason", "policy_version")
    after = reconcile.plan(reconcile.refine(df)).select("path", F.col("state").alias("refined"), "action")
    return first.join(after, "path")


def audit_rows(before: DataFrame, planned: DataFrame, timestamp: int) -> DataFrame:
    """Rows for the audit log, one for each path that isn't skipped."""
    reasons = before.select("path", "decision_reason", "policy_version")
    checks = F.to_json(F.struct(F.col("guardrail").alias("status")))
    return planned.where("action <> 'skip'").join(reasons, "path", "left").select(F.lit(timestamp).cast("long").alias("timestamp"), "path", "action", "decision_reason", "policy_version", checks.alias("guardrail_checks"))


def cleanup(base: DataFrame, remote: DataFrame, local: DataFrame, full_scan: bool, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, reason of baseline rows to delete: rows that can't be synced, rows
    that a filter excludes and, only after a full scan, inactive rows."""
    bad = F.when(is_artifact_dir("path") | F.col("path").rlike(r"\.(note|clip)$"), "not_syncable").when(~allowed("path", list(include), list(exclude)), "excluded")
    out = base.withColumn("reason", bad).where("reason IS NOT NULL").select("path", "reason")
    if full_scan:
        gone = state.not_active(base, remote, local).join(out, "path", "left_anti")
        out = out.unionByName(gone.withColumn("reason", F.lit("inactive")))
    return out
