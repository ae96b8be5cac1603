"""The corpus pipeline: toxic documents go, shared lines go, one document of each near-duplicate group stays, contaminated
documents go, and what is left is encoded into pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. A
null text counts as empty in every stage and leaves none; rows without ``doc_id`` pass the filters by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punchlist.llm import decontamination, jaccard_join, line_dedup, pieces, toxicity
from punchlist.llm.common import table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.with_lines_dropped(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_shared_lines),
    ("near duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("pieces", encode),
]
#: A fitted model and merges by rank are no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
