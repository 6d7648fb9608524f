"""All queries of the posting engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "recommendation_mart"


def query(sql: str | None = None):
    """Registers a function (spark, folder) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


from gleaner.plans import queries_board, queries_cases, queries_core, queries_domain, queries_flow, queries_marts, queries_more  # noqa: E402,F401
