"""Registered queries: each runs an operator over the given tables, with SQL to check it."""

from snapfold.queries import (  # noqa: F401
    claim_queries,
    clean_queries,
    history_queries,
    lookup_queries,
    owner_queries,
    pivot_queries,
    plan_queries,
    scalar_queries,
    source_queries,
    store_queries,
    trend_queries,
)
from snapfold.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
