"""Spark helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.sources.staging import dropped, shared_dir, written

__all__ = ["dropped", "fold", "fresh", "input_bytes", "shared_dir", "written"]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null ids: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def input_bytes(df: DataFrame) -> int:
    """About how many bytes ``df`` has: Spark's estimate from its files, or,
    where Spark has none, the bytes of its texts."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 50:
        text = "text" if "text" in df.columns else df.columns[0]
        size = df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    return size
