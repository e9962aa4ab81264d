"""The registry of core queries: name, plan over a folder of tables, SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a plan, and the SQL that gives the same rows."""

    def keep(plan: Query) -> Query:
        _QUERIES[name] = plan
        if sql is not None:
            _SQL[name] = sql
        return plan

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def queries() -> dict[str, Query]:
    from . import query_catalog  # noqa: F401  (registers on import)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
