"""Rollups per person, rule, tier, finding and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import percent


def credited(single: Column, passes: list[Column]) -> Column:
    """The one stamped, else the distinct people of the passes: each once, however many passes they held."""
    return F.when(single.isNotNull(), F.array(single)).otherwise(F.array_distinct(F.array_compact(F.array(*passes))))


def exam_credited(rule: Column, single: Column, passes: list[Column]) -> Column:
    """Who an examination counts for, by the book's rule: root_welder, cap_welder, or all who are credited."""
    only = lambda c: F.array_compact(F.array(c))
    return F.when(single.isNotNull(), F.array(single)).when(rule == "root_welder", only(passes[0])).when(rule == "cap_welder", only(passes[-1])).otherwise(credited(single, passes))


def credit_rollup(joints: DataFrame, book: list[str], people: Column, examined: Column, exam_people: Column, result: Column, day: Column, required_pct: float) -> DataFrame:
    """Per person: joints credited, examined, passed and failed, first and last day, share examined, below the minimum or not."""
    rows = joints.select(*book, F.explode(people).alias("person"), examined.alias("_x"), exam_people.alias("_xp"), result.alias("_r"), day.alias("_d"))
    x = F.col("_x") & F.array_contains("_xp", F.col("person"))
    out = rows.groupBy(*book, "person").agg(
        F.count(F.lit(1)).alias("joints"), F.count_if(x).alias("examined"), F.count_if(x & (F.col("_r") == "pass")).alias("passed"), F.count_if(x & (F.col("_r") == "fail")).alias("failed"),
        F.min("_d").alias("first_day"), F.max("_d").alias("last_day"),
    )
    pct = percent(F.col("examined"), F.col("joints"))
    return out.withColumn("examined_pct", F.round(pct, 2)).withColumn("below_minimum", pct < required_pct)


def credit_totals(joints: DataFrame, rollup: DataFrame, book: list[str]) -> DataFrame:
    """Credits against joints: how much counting people overstates counting joints."""
    a = joints.groupBy(*book).agg(F.count(F.lit(1)).alias("joints"))
    b = rollup.groupBy(*book).agg(F.sum("joints").alias("credits"), F.sum("examined").alias("exam_credits"))
    return a.join(b, book, "left").withColumn("overstated_pct", F.round((F.col("credits") / F.col("joints") - 1) * 100, 2))


def flat_rule(rollup: DataFrame, book: list[str], required_pct: float) -> DataFrame:
    """Whether everybody meets a flat requirement, and who has the least."""
    low = F.min_by(F.struct("person", "examined_pct"), F.struct("examined_pct", "person"))
    return rollup.groupBy(*book).agg(F.bool_and(F.col("examined_pct") >= required_pct).alias("all_meet"), low.alias("low")).select(*book, "all_meet", F.col("low.person").alias("lowest_person"), F.col("low.examined_pct").alias("lowest_pct"))


def inspection_totals(df: DataFrame, book: list[str], inspected: Column) -> DataFrame:
    out = df.groupBy(*book).agg(F.count(F.lit(1)).alias("n"), F.count_if(inspected).alias("inspected"))
    return out.withColumn("inspected_pct", F.round(percent(F.col("inspected"), F.col("n")), 2))


def tier_rollup(df: DataFrame, book: list[str], value: Column, limit: float, done: Column) -> DataFrame:
    """Computable or not, below or at the limit, the most, and the shortfall of what the upper tier requires."""
    upper = value >= limit
    out = df.groupBy(*book).agg(
        F.count(value).alias("computed"), F.count_if(value.isNull()).alias("uncomputable"), F.count_if(value < limit).alias("below"), F.count_if(upper).alias("required"),
        F.round(F.max(value), 4).alias("most"), F.count_if(upper & done).alias("met"),
    )
    return out.withColumn("shortfall", F.col("required") - F.col("met"))


def key_collisions(df: DataFrame, book: list[str], key: Column, spelling: Column) -> DataFrame:
    """Keys with more than one spelling."""
    grouped = df.select(*book, key.alias("key"), spelling.alias("s")).where(F.col("key").isNotNull()).distinct().groupBy(*book, "key")
    return grouped.agg(F.count(F.lit(1)).alias("n_spellings"), F.min("s").alias("one"), F.max("s").alias("another")).where("n_spellings > 1")


def duplicates(df: DataFrame, book: list[str], digest: Column, place: Column | None = None) -> DataFrame:
    """Contents that occur more than once, and in how many places."""
    where = place if place is not None else F.lit(1)
    return df.select(*book, digest.alias("digest"), where.alias("_p")).groupBy(*book, "digest").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_p").alias("n_places")).where("n > 1")


def aggregated_findings(findings: DataFrame, book: list[str], rule: str = "rule_id", severity: str = "severity", record: str = "record_id", most: int = 200) -> DataFrame:
    """One row per rule: occurrences, and the first ``most`` records (a report's limit) with whether there are more.

    Records past the limit are dropped by rank before anything is collected, and ranks are first taken within sixteenths of a
    rule, so that one rule with most of the findings is no single task's work.
    """
    salt = F.pmod(F.xxhash64(record), F.lit(16))
    counts = findings.groupBy(*book, rule).agg(F.count(F.lit(1)).alias("n"), F.min(severity).alias(severity))
    near = findings.withColumn("_r", F.row_number().over(Window.partitionBy(*book, rule, salt).orderBy(record))).where(F.col("_r") <= most)
    top = near.withColumn("_r", F.row_number().over(Window.partitionBy(*book, rule).orderBy(record))).where(F.col("_r") <= most)
    lists = top.groupBy(*book, rule).agg(F.array_sort(F.collect_list(record)).alias("records"))
    return counts.join(lists, [*book, rule]).withColumn("truncated", F.col("n") > most)


def severity_counts(aggregated: DataFrame, book: list[str], severities: list[str], n: str = "n") -> DataFrame:
    cols = [c for s in severities for c in (F.count_if(F.col("severity") == s).alias(f"{s}_findings"), F.coalesce(F.sum(F.when(F.col("severity") == s, F.col(n))), F.lit(0)).alias(f"{s}_records"))]
    return aggregated.groupBy(*book).agg(*cols)


#: What a finding of each class costs an audit.
DEDUCTIONS = {"critical": 25, "major": 10, "minor": 2}


def audit_scores(findings: DataFrame, audit: list[str], kind: str) -> DataFrame:
    """100 less deductions, never below 0; any critical finding fails the audit."""
    cost = sum((F.count_if(F.col(kind) == k) * v for k, v in DEDUCTIONS.items()), F.lit(0))
    out = findings.groupBy(*audit).agg(F.greatest(F.lit(0), 100 - cost).alias("score"), F.count_if(F.col(kind) == "critical").alias("n_critical"))
    return out.withColumn("failed", F.col("n_critical") > 0)


def latest(df: DataFrame, by: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The row of each group that comes last; an aggregation, so a large group needs no sort."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_l")).select(*by, "_l.*")


def by_division(books: DataFrame, divisions: DataFrame, key: str, fallback: str) -> DataFrame:
    """Books of each division, with divisions that have none."""
    counted = books.groupBy(F.coalesce(F.col(key), F.lit(fallback)).alias(key)).agg(F.count(F.lit(1)).alias("n"))
    return divisions.select(key).join(counted, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n_books"))


def batch_classes(batch: DataFrame, row_id: str, key: Column) -> DataFrame:
    """missing_key, duplicate_in_batch (all rows that share a key are blocked) or fileable."""
    keyed = batch.select(row_id, key.alias("_k"))
    n = keyed.where(F.col("_k").isNotNull()).groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    state = F.when(F.col("_k").isNull(), "missing_key").when(F.col("_n") > 1, "duplicate_in_batch").otherwise("fileable")
    return keyed.join(n, "_k", "left").select(row_id, state.alias("state"))
