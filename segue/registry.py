"""Registry of named queries and, where SQL can say the same, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from segue.session import spread, tune
from segue.sources.tables import Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, tables: str = "", oracle: str | None = None, recursive: bool = False):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            spread(spark, sf_dir)
            return fn(Tables(spark, sf_dir))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_tables(tables, oracle, recursive)
        return fn

    return wrap
