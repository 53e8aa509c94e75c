"""Where queries and the SQL they must agree with are kept by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, queries: dict | None = None, oracles: dict | None = None):
    """Registers a query, and its SQL if it has one; here, or in a registry of the caller's."""
    q, o = QUERIES if queries is None else queries, ORACLES if oracles is None else oracles

    def add(f):
        q[name] = f
        if sql:
            o[name] = sql
        return f

    return add
