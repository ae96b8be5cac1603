"""The queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = {
    "op1_line_dedup": "line_dedup",
    "op2_decontamination": "decontamination",
    "op3_quality": "quality",
    "op4_winnowing": "winnowing",
    "op5_language_id": "language_id",
    "op6_secret_scan": "secret_scan",
    "op7_ppm": "ppm",
    "op8_pieces": "pieces",
    "op9_toxicity": "toxicity",
    "op10_jaccard_join": "jaccard_join",
    "op11_minhash": "minhash",
    "op12_periodic_runs": "periodic_runs",
    "op13_prefix_trie": "prefix_trie",
}


def _module(name: str):
    return import_module(f"{__package__}.{MODULES[name]}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _module(name).query for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in MODULES if (sql := getattr(_module(name), "ORACLE_SQL", None))}
