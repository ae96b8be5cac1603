"""The registry that bindings enter themselves in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def bound(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir); ``sql`` is what DuckDB runs over the same tables."""

    def enter(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return enter


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(name: str) -> Column:
    return F.col(name).cast("date")


def date(text: str) -> Column:
    return F.lit(text).cast("date")
