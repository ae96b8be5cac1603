"""The registered queries of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .plans.bound import ORACLES, QUERIES

MODULES = ("people", "registers", "books", "ledgers", "texts", "findings", "feeds", "imports", "desk", "coverage", "gating", "loglike", "links", "desk2", "desk3", "paperlike", "overviewlike")

for _name in MODULES:
    import_module(f"{__package__}.plans.{_name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per person: joints credited and examined, and whether the minimum is met."""
    return QUERIES["a1_credit_rollup"](spark, sf_dir).orderBy("book", "person")
