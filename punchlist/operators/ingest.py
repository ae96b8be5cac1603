"""Log imports as Spark jobs: cells (file, sheet, row_no, col_no, value) become typed rows, issues and a plan.

No layout is fixed: the header is the row that knows most names, and a field is the first column that carries one of its
names. Everything is keyed by file and sheet, so any number of logs is read in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import loose_date
from ..functions.keys import header_key, number_of, pass_fail, split_list, weld_number_key
from ..sources.shared import written

SHEET = ["file", "sheet"]
#: What the columns of a weld log are called.
WELD_NAMES = {
    "weld_number": ["weld", "weld no", "weld number", "weld #", "joint"], "weld_date": ["date", "weld date", "date welded"], "welder": ["welder", "welder stamp", "stamp", "welder id"],
    "area": ["area", "construction area", "location"], "heats": ["heat", "heat no", "heat numbers", "heats"], "result": ["result", "visual", "accept reject"], "pressure": ["design pressure", "pressure psi"],
}
HEADER_ROWS = 60
#: A template is configuration of a few dozen rows; more than these are refused.
MAX_SECTIONS = 1000


def synonyms(spark: SparkSession, names: dict[str, list[str]], key=header_key) -> DataFrame:
    """(field, name_key): a row per name, a few dozen, so joins may broadcast it."""
    rows = [(f, n) for f, ns in names.items() for n in ns]
    return spark.createDataFrame(rows, "field string, name string").select("field", key(F.col("name")).alias("name_key")).distinct()


def located_headers(cells: DataFrame, names: DataFrame, rows: int = HEADER_ROWS, least: int = 2, key=header_key) -> DataFrame:
    """(file, sheet, header_row, fields: field -> column) of sheets whose best row knows ``least`` fields; the first of equals.

    A cell is made up from few stored bytes, so Spark takes cells for small and may broadcast them. The names are a few dozen, so they
    are broadcast; the headers are written, so their size is known wherever they meet the cells again, and they are found once.
    """
    hits = cells.where(F.col("row_no") < rows).withColumn("name_key", key(F.col("value"))).join(F.broadcast(names), "name_key")
    per_field = hits.groupBy(*SHEET, "row_no", "field").agg(F.min("col_no").alias("col_no"))
    per_row = per_field.groupBy(*SHEET, "row_no").agg(F.count(F.lit(1)).alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "col_no")))).alias("fields"))
    best = per_row.groupBy(*SHEET).agg(F.max_by(F.struct("row_no", "fields", "n"), F.struct("n", -F.col("row_no"))).alias("b"))
    found = best.where(F.col("b.n") >= least).select(*SHEET, F.col("b.row_no").alias("header_row"), F.col("b.fields").alias("fields"), F.col("b.n").alias("n_fields"))
    return written(cells.sparkSession, found, "headers")


def template(headers: DataFrame, signals: dict[str, list[str]]) -> DataFrame:
    """The template whose signal fields a header has most of, the first of equals, with the counts; unknown without any."""
    have = F.map_keys("fields")
    counts = {t: F.size(F.array_intersect(have, F.array(*[F.lit(f) for f in fs]))) for t, fs in signals.items()}
    most = F.greatest(*counts.values(), F.lit(0))
    chain = F.when(most == 0, "unknown")
    for t, n in counts.items():
        chain = chain.when(n == most, t)
    return headers.select(*SHEET, chain.alias("template"), *[n.alias(f"n_{t}") for t, n in counts.items()])


def typed_rows(cells: DataFrame, headers: DataFrame, fields: list[str]) -> DataFrame:
    """One row per sheet row below the header, a text column per field; rows without any known field are left out.

    Cells are put in order to be grouped, by the first column of the key before all others, so that is the one that tells most of them apart.
    """
    placed = headers.select(*SHEET, "header_row", F.explode("fields").alias("field", "col_no"))
    named = cells.join(placed, [*SHEET, "col_no"]).where(F.col("row_no") > F.col("header_row"))
    rows = named.groupBy("row_no", *SHEET).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
    return rows.select(*SHEET, "row_no", *fields)


def weld_rows(rows: DataFrame) -> DataFrame:
    """Text columns as a weld log's types, with ``problems``: why a row cannot be taken."""
    number, date = weld_number_key(F.col("weld_number")), loose_date(F.col("weld_date"))
    problems = F.array_compact(F.array(
        F.when(number.isNull(), "no weld number"),
        F.when(F.col("weld_date").isNotNull() & date.isNull(), "unreadable date"),
    ))
    return rows.select(
        *SHEET, "row_no", number.alias("weld_number"), date.alias("weld_date"), F.upper(F.trim("welder")).alias("welder"), F.upper(F.trim("area")).alias("area"),
        split_list(F.col("heats")).alias("heats"), pass_fail(F.col("result")).alias("result"), number_of(F.col("pressure")).alias("pressure"), problems.alias("problems"),
    )


def issues(rows: DataFrame) -> DataFrame:
    """(file, sheet, row_no, problem): every problem of every row, and numbers that a sheet has twice, at all of their rows."""
    own = rows.select(*SHEET, "row_no", F.explode("problems").alias("problem"))
    twice = rows.where(F.col("weld_number").isNotNull()).groupBy(*SHEET, "weld_number").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = rows.join(twice.select(*SHEET, "weld_number"), [*SHEET, "weld_number"]).select(*SHEET, "row_no", F.lit("duplicate weld number").alias("problem"))
    return own.unionByName(again)


def import_plan(rows: DataFrame, areas: DataFrame, people: DataFrame, existing: DataFrame) -> DataFrame:
    """Clean rows with area and welder resolved, and whether each creates or updates; what is unresolved stays NULL.

    ``areas`` (area, area_id), ``people`` (welder, welder_id) and ``existing`` (area_id, weld_number) have unique keys.
    """
    clean = rows.where(F.size("problems") == 0)
    there = existing.select("area_id", "weld_number", F.lit(True).alias("_e"))
    joined = clean.join(areas, "area", "left").join(people, "welder", "left").join(there, ["area_id", "weld_number"], "left")
    return joined.withColumn("plan", F.when(F.col("_e"), "update").otherwise("create")).drop("_e")


def unresolved(plan: DataFrame, name: str, resolved: str) -> DataFrame:
    return plan.where(F.col(resolved).isNull() & F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n_rows"))


def labelled_fields(lines: DataFrame, by: list[str], order: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """The first match of each pattern (its group 1) in a document's lines, and which fields were not found."""
    firsts = [F.min_by(F.when(F.regexp_extract(text, p, 1) != "", F.regexp_extract(text, p, 1)), F.when(F.regexp_extract(text, p, 1) != "", F.col(order))).alias(f) for f, p in patterns.items()]
    out = lines.groupBy(*by).agg(*firsts)
    return out.withColumn("missing", F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in patterns])))


def scaffold(books: DataFrame, template: DataFrame, book: str, kind: str, applies: str, section: str) -> DataFrame:
    """The sections of each book by its kind, with a reason where one does not apply; the template is a few dozen rows."""
    rows = template.select(section, applies).distinct().orderBy(section).limit(MAX_SECTIONS + 1).collect()
    if len(rows) > MAX_SECTIONS:
        raise ValueError(f"a template of more than {MAX_SECTIONS} sections")
    sections = F.array(*[F.struct(F.lit(r[0]).alias(section), F.lit(r[1]).alias(applies)) for r in rows])
    all_of = books.select(book, kind, F.explode(sections).alias("_t")).select(book, kind, f"_t.{section}", f"_t.{applies}")
    fits = (F.col(applies) == "all") | (F.col(applies) == F.col(kind))
    return all_of.select(book, section, F.when(fits, "open").otherwise("not_applicable").alias("status"), F.when(~fits, F.concat(F.lit("only for "), F.col(applies))).alias("na_reason"))
