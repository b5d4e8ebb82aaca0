"""The registry of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query, and the SQL statement that gives the same rows."""

    def register(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def load() -> tuple[dict[str, Run], dict[str, str]]:
    """All queries and oracles, registered by importing the modules that hold them."""
    from recordloom.plans import (  # noqa: F401
        changing,
        conversion,
        exporting,
        importing,
        inferring,
        operating,
        relating,
        searching,
        shaping,
    )

    return QUERIES, ORACLES
