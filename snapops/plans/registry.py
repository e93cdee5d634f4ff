"""The registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from snapops.plans.tables import forget_plans, with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, tables: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` gives the same columns over the named adapter tables."""

    def register(function: Query) -> Query:
        def fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
            forget_plans()
            return function(spark, sf_dir)

        QUERIES[name] = fresh
        if sql is not None:
            ORACLES[name] = with_tables(tables, sql)
        return function

    return register
