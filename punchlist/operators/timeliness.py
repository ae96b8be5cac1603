"""How promptly records are entered, in business days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import add_business_days, business_days_between

ESCALATION_PCT = 90.0


def assessed(events: DataFrame, work: Column, entered: Column, source: Column, allowed: Column, week: str, standard_days: tuple[int, ...] = (0, 1, 2, 3, 5)) -> DataFrame:
    """Adds verdict, due_by and days_late. ``allowed``: days the standard gives (0: the same day), -1 a precondition, NULL none.

    Plain arithmetic on dates, row by row: no calendar is joined and nothing is shuffled.
    """
    due = F.when(F.lit(False), F.lit(None).cast("date"))
    for n in standard_days:
        due = due.when(allowed == n, add_business_days(work, n, week))
    untimed = allowed.isNull() | (source == "bulk_import") | entered.isNull() | source.isNull() | work.isNull()
    verdict = (
        F.when(allowed == -1, "precondition")
        .when(untimed, "unmeasurable")
        .when(entered < work, "entered_before_work")
        .when(entered <= F.col("_due"), "on_time")
        .otherwise("late")
    )
    timed = F.col("verdict").isin("on_time", "late")
    # In steps, so that the long date expressions stand in the plan once each.
    steps = events.select("*", due.alias("_due"), work.alias("_w"), entered.alias("_e")).select("*", verdict.alias("verdict"))
    late = F.when(F.col("verdict") == "late", business_days_between(F.col("_due"), F.col("_e"), week)).when(F.col("verdict") == "on_time", 0)
    return steps.select(*events.columns, "verdict", F.when(timed, F.col("_due")).alias("due_by"), late.alias("days_late"))


def rates(events: DataFrame, by: list[str]) -> DataFrame:
    """Counts of verdicts and the share on time of what could be timed; NULL if nothing could."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    out = events.groupBy(*by).agg(n("on_time").alias("on_time"), n("late").alias("late"), n("unmeasurable").alias("unmeasurable"), n("precondition").alias("precondition"), n("entered_before_work").alias("before_work"))
    timed = F.col("on_time") + F.col("late")
    return out.withColumn("rate_pct", F.when(timed > 0, F.round(F.col("on_time") / timed * 100, 2)))


def weekly(events: DataFrame, book: list[str], entered: str) -> DataFrame:
    """Rates per week of entry, Monday first; weeks without entries do not appear."""
    return rates(events.where(F.col(entered).isNotNull()).withColumn("week", F.date_trunc("week", F.col(entered)).cast("date")), [*book, "week"])


def escalations(weeks: DataFrame, book: list[str]) -> DataFrame:
    """Weeks under the limit whose last *measured* week was under it too; weeks without a rate do not break the run."""
    before = F.lag("rate_pct").over(Window.partitionBy(*book).orderBy("week"))
    measured = weeks.where(F.col("rate_pct").isNotNull()).withColumn("previous_pct", before)
    return measured.where((F.col("rate_pct") < ESCALATION_PCT) & (F.col("previous_pct") < ESCALATION_PCT)).select(*book, "week", "rate_pct", "previous_pct")


def self_audits_due(start: Column, as_of: Column, week: str) -> Column:
    """One for every ten business days since the start."""
    return F.greatest(F.lit(0), F.floor(business_days_between(start, as_of, week) / 10).cast("int"))
