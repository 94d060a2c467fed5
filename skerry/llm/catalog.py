"""Queries and oracle SQL of the text operators, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skerry.llm import queries as q
from skerry.llm import sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(q, name) for name in dir(q) if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLE)
