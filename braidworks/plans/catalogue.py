"""All queries of the engine's own operators."""

from __future__ import annotations

from . import iterative_queries, keyed_queries, latency_queries, placement_queries, reduce_queries, scalar_queries, social_queries, source_queries  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
