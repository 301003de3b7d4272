"""Named queries and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function as query ``name``; ``oracle`` is DuckDB SQL for its rows."""

    def add(function: Query) -> Query:
        if name in _queries:
            raise ValueError(f"two queries are named {name}")
        _queries[name] = function
        if oracle:
            _oracles[name] = oracle
        return function

    return add


def sql_query(name: str, spark_sql: str, oracle: str | None = None) -> None:
    """Register Spark SQL over the tables as query ``name``; without ``oracle`` the same text is DuckDB's."""
    from .session import tables

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables(spark, sf_dir, spark_sql)
        return spark.sql(spark_sql)

    query(name, oracle or spark_sql)(run)


def _load() -> None:
    from . import plans

    for found in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"{plans.__name__}.{found.name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
