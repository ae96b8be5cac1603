"""Sinks: stamped scores, the audit log, weekly rates, and the sheets of a turnover export."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.history import change_log
from .shared import exists, written


def stamp_scores(scored: DataFrame, path: str, at: Column) -> None:
    """Appends scores with the time they were computed; the latest stamp of a section is its cache."""
    scored.withColumn("computed_at", at).write.mode("append").parquet(path)


def latest_stamp(stamps: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return stamps.groupBy(*keys).agg(F.max_by(F.struct(*columns), "computed_at").alias("_s")).select(*keys, "_s.*")


def append_changes(old: DataFrame, new: DataFrame, key: list[str], columns: list[str], deleted: str, path: str, at: Column, run: str) -> None:
    """What a run changed, in the audit log under the run's own name: a run that is repeated after a failure is in it once."""
    change_log(old, new, key, columns, deleted).withColumn("changed_at", at).write.mode("overwrite").parquet(f"{path}/run={run}")


def write_rates(rates: DataFrame, path: str, week: str = "week", book: str = "job_book_id") -> None:
    """The weekly rates of books, one row for each (book, week): rows replace those of their key, all others stay.

    A key that comes twice fails the write, and so do counts that cannot be: below zero, or a rate where nothing was measured. Weeks are
    partitions; only those that ``rates`` has are read and replaced.
    """
    spark = rates.sparkSession
    alone = F.count(F.lit(1)).over(Window.partitionBy(book, week)) == 1
    measured = F.col("on_time") + F.col("late")
    sane = (F.col("on_time") >= 0) & (F.col("late") >= 0)
    if "rate" in rates.columns:
        sane &= (measured == 0) == F.col("rate").isNull()
    checked = rates.withColumn("on_time", F.when(~alone, F.raise_error(F.lit("a book has two rows of one week")).cast("bigint")).when(~F.coalesce(sane, F.lit(False)), F.raise_error(F.lit("counts that cannot be")).cast("bigint")).otherwise(F.col("on_time")))
    checked = written(spark, checked, "rates")
    if exists(spark, path):
        known = spark.read.parquet(path).withColumn(week, F.col(week).cast(rates.schema[week].dataType))
        others = known.join(checked.select(week).distinct(), week, "left_semi").join(checked.select(book, week), [book, week], "left_anti")
        checked = written(spark, checked.unionByName(others.select(*checked.columns)), "rates")
    checked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(week).parquet(path)


#: The headings of a turnover export's sheets, with what stands under them as SQL expressions of the records.
SHEETS = {
    "weld_log": {
        "Line": "line_code",
        "Weld #": "weld_number",
        "Date": "weld_date",
        "Welder": "coalesce(welder_stamp, welder_pass_assignment)",
        "Joint": "joint_type",
        "Component": "component_description",
        "Heat #s": "array_join(heat_numbers, ', ')",
        "CWI": "cwi_initials",
        "Visual": "cwi_visual_result",
        "Visual date": "visual_inspection_date",
        "NDT method": "ndt_method",
        "NDT result": "ndt_result",
        "X-ray #": "xray_number",
        "Status": "status",
    },
    "torque_log": {
        "ISO-Flange": "iso_flange_number",
        "ISO": "iso_number",
        "Size": "flange_pipe_size",
        "Bolt dia": "bolt_diameter",
        "Bolts": "bolt_count",
        "Required": "CASE WHEN required_torque_min_ft_lb IS NOT NULL AND required_torque_max_ft_lb IS NOT NULL THEN concat(cast(required_torque_min_ft_lb AS int), '-', cast(required_torque_max_ft_lb AS int)) ELSE cast(cast(required_torque_ft_lb AS int) AS string) END",
        "Actual": "actual_torque_ft_lb",
        "Wrench": "wrench_id_raw",
        "Torqued": "torque_date",
        "By": "employee_initials",
        "Inspected": "inspection_date",
        "Inspector": "inspector_initials",
    },
    "completeness": {"Section": "section_number", "Title": "title", "Weight": "weight", "Status": "status", "Approved %": "pct", "Collected %": "collected_pct"},
}


def sheet(records: DataFrame, name: str, book: str = "job_book_id") -> DataFrame:
    """A sheet's columns under its headings, as text, empty where nothing is recorded; columns that the records lack are empty."""
    have = records.columns
    known = records.select("*", *[F.lit(None).cast("string").alias(c) for c in _named(SHEETS[name].values()) if c not in have])
    return known.select(book, *[F.coalesce(F.expr(e).cast("string"), F.lit("")).alias(h) for h, e in SHEETS[name].items()])


def _named(expressions) -> set[str]:
    return {w for e in expressions for w in re.findall(r"(?<!['\w])[a-z][a-z0-9]*(?:_[a-z0-9]+)+(?![\w(])", e)}


def export_sheet(records: DataFrame, name: str, path: str, book: str = "job_book_id") -> None:
    """A sheet of all books as CSV with headings, a folder for each book."""
    sheet(records, name, book).write.mode("overwrite").partitionBy(book).options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def manifest(documents: DataFrame, inventory: DataFrame, section: str, name: str, path: str) -> DataFrame:
    """Every document with its path in the package, and whether its object is there."""
    there = inventory.select(F.col(path)).distinct().withColumn("available", F.lit(True))
    return documents.join(there, path, "left").withColumn("available", F.coalesce("available", F.lit(False))).withColumn("package_path", F.concat_ws("/", F.lpad(F.col(section).cast("string"), 2, "0"), F.col(name)))


def report_lines(scored: DataFrame, book: str, order: list[Column], label: str, pct: str) -> DataFrame:
    """A text report per book: one line for each section, in order."""
    line = F.concat(F.rpad(F.col(label), 16, " "), F.lpad(F.format_number(F.col(pct), 2), 8, " "))
    lines = scored.groupBy(book).agg(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line")))).alias("ls"))
    return lines.select(book, F.array_join(F.transform("ls", lambda x: x.line), "\n").alias("report"))
