"""The query book: Spark callables and, where SQL can say it, their oracle."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from boostlab.session import scratch

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Enter a query under ``name``, with the SQL that gives the same rows."""

    def enter(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return enter


def report(fn: Query) -> Query:
    """A query whose result is a model or a report, some rows whatever the data: they are
    taken at once, so every folder the work needed can go."""

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scratch(spark):
            made = fn(spark, sf_dir)
            rows = made.collect()
        return spark.createDataFrame(rows, made.schema)

    return run
