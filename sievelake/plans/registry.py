"""Registry of named queries: a function (spark, sf_dir) -> DataFrame and, where SQL can express it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The driver's tables by name: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    @property
    def spark(self) -> SparkSession:
        return self._spark

    def path(self, name: str) -> str:
        return f"{self._dir}/{name}.parquet"

    def of(self, spark: SparkSession) -> Tables:
        """The same tables in another session."""
        return Tables(spark, self._dir)

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(self.path(name))


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add
