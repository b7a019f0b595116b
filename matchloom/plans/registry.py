"""The registered queries of the library and the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, **types: str) -> Callable:
    """Register a query, with its SQL where SQL can express it; ``types`` names columns whose SQL type is to be cast: ``bigint="a b"``."""

    def put(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = function
        if sql:
            casts = ", ".join(f"{c}::{kind} AS {c}" for kind, columns in types.items() for c in columns.split())
            ORACLE_SQL[name] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql
        return function

    return put


from matchloom.plans import evaluation_queries, sampling_queries, text_queries  # noqa: E402, F401
