"""Registry of table queries and, where SQL can say the same, their SQL twin."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexweave.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HEAVY = {"documents", "pages", "conversations", "embeddings", "orders", "lineitem"}


def query(name: str, sql: str | None = None):
    """Register ``fn(load) -> DataFrame`` where ``load(table)`` reads one parquet table."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda table: read_table(spark, sf_dir, table, table in HEAVY))
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn
    return wrap
