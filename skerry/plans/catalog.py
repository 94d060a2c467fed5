"""Queries and oracle SQL of the reconciliation workload, for the entry module."""

from __future__ import annotations

from skerry.plans import stored  # noqa: F401, registers its queries
from skerry.plans.live import LIVE
from skerry.plans.oracle import ORACLE
from skerry.plans.queries import QUERIES, Query
from skerry.plans.stored_oracle import STORED


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return ORACLE | STORED | LIVE
