"""Registry of runnable queries and of the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def sql(views: Sequence[str], body: str) -> str:
    """``body`` after the bridge views it reads; it starts with SELECT or with a comma and further CTEs."""
    from sigspark.plans.bridge import SQL_VIEWS

    return "WITH " + ",\n".join(f"{v} AS ({SQL_VIEWS[v]})" for v in views) + "\n" + body
