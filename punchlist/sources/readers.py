"""Readers: book tables, cell dumps, file listings, hold sheets; and what they become."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import mime_of, section_of_folder


def live(df: DataFrame, alive: Column | None = None) -> DataFrame:
    """Rows that are not deleted: those for which ``alive`` holds, or without a date of deletion. On stored columns it reaches the scan."""
    if alive is None:
        alive = F.col("deleted_at").isNull() if "deleted_at" in df.columns else F.lit(True)
    return df.where(alive)


def live_documents(documents: DataFrame) -> DataFrame:
    """Live documents that no later one supersedes."""
    return live(documents, ~F.coalesce(F.col("is_superseded"), F.lit(False)) & (F.col("deleted_at").isNull() if "deleted_at" in documents.columns else F.lit(True)))


def book_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return live(spark.read.parquet(f"{folder}/{name}"))


def with_children(parents: DataFrame, children: DataFrame, key: str, columns: list[str], name: str, order: list[str]) -> DataFrame:
    """Each parent with the ordered array of its children, empty rather than NULL."""
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias(name))
    kind = lists.schema[name].dataType
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m[1].lower(), name)


def camel(name: str) -> str:
    return re.sub(r"_([a-z0-9])", lambda m: m[1].upper(), name)


def renamed(df: DataFrame, how, allowed: list[str] | None = None) -> DataFrame:
    """Columns under other names; with ``allowed``, unknown ones are dropped."""
    out = df.toDF(*[how(c) for c in df.columns])
    return out.select(*[c for c in out.columns if c in allowed]) if allowed is not None else out


#: How dumps of cells are written. A heading begins a sheet (its size may follow), a run stands for that many blank rows, and
#: a listing of formulas, which is no data, ends a sheet's rows. The second spelling of each is a short one.
SHEET_HEADS = [r"^##\s+Sheet:\s+(.+?)(?:\s+\(empty\))?(?:\s+[—-]\s+\d+\s+rows?\s*×.*)?\s*$", r"^# (?!#)(.*)$"]
BLANK_RUNS = [r"^\[(\d+)\s+empty\s+rows?\]\s*$", r"^~(\d+)\s*$"]
FORMULAS = r"(?i)^(Formulas:|## formulas)"


def cell_dump(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row_no, col_no, value) of text dumps. A large dump is read in many tasks: lines are in order by the block of the file
    they are in and by their place in it."""
    text = spark.read.option("recursiveFileLookup", True).text(path)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    return cells_of(lines, "block")


def cells_of(lines: DataFrame, block: str | None = None) -> DataFrame:
    """The same from (file, line_no, line), and the ``block`` of a file that a line is in, if files come in blocks.

    In two passes: what a line says of those behind it (its sheet, whether formulas follow, how many rows it stands for) is settled within
    each block, then handed on from block to block, of which a file has a few. So no task has to hold a whole file.
    """
    of = lambda patterns: F.coalesce(*[F.nullif(F.trim(F.regexp_extract("line", p, 1)), F.lit("")) for p in patterns])
    rows = lines.withColumn("_b", F.col(block) if block else F.lit(0))
    rows = rows.select("file", "_b", "line_no", "line", of(SHEET_HEADS).alias("_head"), of(BLANK_RUNS).try_cast("int").alias("_run"))
    rows = rows.withColumn("_skip", F.when(F.col("_head").isNotNull(), False).when(F.col("line").rlike(FORMULAS), True))
    inside = Window.partitionBy("file", "_b").orderBy("line_no")
    last = lambda c: F.last(c, ignorenulls=True)
    rows = rows.withColumns({"_sheet": last("_head").over(inside), "_skips": last("_skip").over(inside)})
    before = Window.partitionBy("file").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("file", "_b").agg(F.max_by("_sheet", "line_no").alias("_s"), F.max_by("_skips", "line_no").alias("_k"))
    ends = ends.select("file", "_b", last("_s").over(before).alias("_s"), last("_k").over(before).alias("_k"))
    rows = rows.join(ends, ["file", "_b"]).withColumns({"sheet": F.coalesce("_sheet", "_s"), "_skips": F.coalesce("_skips", "_k", F.lit(False))})
    body = rows.where(~F.col("_skips") & F.col("_head").isNull() & F.col("sheet").isNotNull() & (F.trim("line") != "") & ~F.col("line").rlike("^##? "))

    body = body.withColumn("_n", F.coalesce("_run", F.lit(1)))
    totals = body.groupBy("file", "sheet", "_b").agg(F.sum("_n").alias("_n"))
    offsets = totals.select("file", "sheet", "_b", F.coalesce(F.sum("_n").over(Window.partitionBy("file", "sheet").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    running = F.sum("_n").over(Window.partitionBy("file", "sheet", "_b").orderBy("line_no"))
    numbered = body.withColumn("_r", running).join(offsets, ["file", "sheet", "_b"]).where(F.col("_run").isNull())
    cells = numbered.select("file", "sheet", (F.col("_r") + F.col("_o") - 1).cast("int").alias("row_no"), F.posexplode(F.split("line", "\t", -1)).alias("col_no", "value"))
    return cells.withColumn("value", F.nullif(F.trim("value"), F.lit(""))).where(F.col("value").isNotNull())


def plain_listing(lines: DataFrame, root: str) -> DataFrame:
    """(path, bytes) of ``path<TAB>bytes`` lines, paths from ``root`` on."""
    parts = F.split("value", "\t")
    path = F.regexp_replace(F.replace(parts[0], F.lit("\\"), F.lit("/")), f"^.*?{re.escape(root)}/", "")
    return lines.where(F.size(parts) >= 2).select(path.alias("path"), F.trim(parts[1]).try_cast("long").alias("bytes"))


def listed_documents(listing: DataFrame, path: Column, size: Column, *keep: str) -> DataFrame:
    """Files as documents: section by the first folder, depth, name and type."""
    parts = F.split(path, "/")
    return listing.select(*keep, path.alias("path"), F.element_at(parts, -1).alias("filename"), section_of_folder(parts[0]).alias("section"), (F.size(parts) - 1).alias("depth"), size.alias("bytes"), mime_of(path).alias("mime"))


def section_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("section").agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes"), F.max("depth").alias("max_depth"))


def folder(spark: SparkSession, path: str) -> DataFrame:
    """A recursive listing, without reading any file's content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return listed_documents(files, F.regexp_replace("path", f"^.*?{re.escape(path.rstrip('/'))}/", ""), F.col("length"))


HOLD_SHEET = "test_identifier string, test_date string, start_pressure_psi double, end_pressure_psi double, duration_minutes double, ambient_temp_f double"


def hold_sheet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HOLD_SHEET).option("sep", "\t").option("comment", "#").csv(path)


def hold_outcome(start: Column, end: Column, tolerance: float = 0.0) -> Column:
    """held, dropped or rose; NULL without both readings; two zeros are a blank template row."""
    return F.when(start.isNull() | end.isNull() | ((start == 0) & (end == 0)), F.lit(None).cast("string")).when(end < start - tolerance, "dropped").when(end > start + tolerance, "rose").otherwise("held")
