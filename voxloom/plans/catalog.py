"""Registration of queries with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register ``name``; the oracle is DuckDB SQL with the same column names, or None."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries on the library's own operators."""
    from voxloom.plans import q_functions, q_graphs, q_io, q_joins, q_points, q_solvers, q_streams  # noqa: F401

    return QUERIES, ORACLE
