"""Operators for preparing language-model training data; their queries and SQL are in `queries`."""

from .queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
