"""Queries by name, each with its equivalent SQL."""

from rivaq.plans.queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
