"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigspark.plans import (  # noqa: F401
    bag_queries,
    io_queries,
    metric_queries,
    run_queries,
    signal_queries,
    split_queries,
)
from sigspark.plans.registry import ORACLES, QUERIES, Query
from sigspark.session import ship_package


def _shipped(run: Query) -> Query:
    def with_package(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return run(spark, sf_dir)

    return with_package


def queries() -> dict[str, Query]:
    return {name: _shipped(run) for name, run in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
