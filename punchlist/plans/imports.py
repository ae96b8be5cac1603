"""Log imports: orders written out as the cells of weld logs, one sheet per region of keys, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest
from .bound import bound, day, read

HEADS = ["Weld No.", "Welder Stamp", "DATE", "Construction Area", "Heat Numbers", "Result", "Remarks"]


def cells(spark, sf_dir):
    """Sheet s<k>: a title row, a header row at k % 3 + 1, then one row per order."""
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").withColumn("sheet", F.concat(F.lit("s"), k % 20)).withColumn("start", (k % 20 % 3 + 2).cast("int"))
    values = [
        F.when(k % 40 == 7, "x").otherwise(F.concat(F.lit("W-0"), F.when(k % 50 == 11, F.lit(11)).otherwise(k))), F.concat(F.lit(" st"), F.col("o_custkey") % 30), F.when(k % 90 == 5, "soon").otherwise(F.date_format(day("o_orderdate"), "M/d/yyyy")),
        F.concat(F.lit("Area "), F.col("o_custkey") % 12), F.concat(F.lit("H"), k % 9, F.lit(", H"), k % 4), F.when(F.col("o_orderstatus") == "F", "Acc").otherwise("rej"), F.col("o_orderpriority"),
    ]
    row = (F.floor(k / 20) + F.col("start")).cast("int")
    body = o.select("sheet", row.alias("row_no"), F.posexplode(F.array(*[v.cast("string") for v in values])).alias("col_no", "value"))
    top = o.select("sheet", "start").distinct().select("sheet", (F.col("start") - 1).alias("row_no"), F.posexplode(F.array(*[F.lit(h) for h in HEADS])).alias("col_no", "value"))
    return body.unionByName(top).withColumn("file", F.lit("log")).where(F.col("value").isNotNull())


def headers(spark, sf_dir):
    return ingest.located_headers(cells(spark, sf_dir), ingest.synonyms(spark, ingest.WELD_NAMES))


@bound("i1_header_location", "SELECT DISTINCT 's' || (o_orderkey % 20) AS sheet, (o_orderkey % 20 % 3 + 1)::INTEGER AS header_row, 6 AS n_fields, 'area:3,heats:4,result:5,weld_date:2,weld_number:0,welder:1' AS fields FROM orders")
def header_location(spark, sf_dir):
    named = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat_ws(":", e.key, e.value)), ",")
    return headers(spark, sf_dir).select("sheet", "header_row", "n_fields", named.alias("fields"))


@bound("i2_template_detection", "SELECT DISTINCT 's' || (o_orderkey % 20) AS sheet, 'facility' AS template FROM orders")
def template_detection(spark, sf_dir):
    return ingest.template(headers(spark, sf_dir), {"flowline": ["root", "hot", "fill"], "facility": ["welder", "area"]}).select("sheet", "template")


def rows(spark, sf_dir):
    c = cells(spark, sf_dir)
    return ingest.weld_rows(ingest.typed_rows(c, headers(spark, sf_dir), list(ingest.WELD_NAMES)))


_ROWS = """r AS (SELECT 's' || (o_orderkey % 20) AS sheet, (o_orderkey // 20 + o_orderkey % 20 % 3 + 2)::INTEGER AS row_no, CASE WHEN o_orderkey % 40 = 7 THEN NULL WHEN o_orderkey % 50 = 11 THEN '11' ELSE o_orderkey::VARCHAR END AS weld_number,
 CASE WHEN o_orderkey % 90 <> 5 THEN o_orderdate::DATE END AS weld_date, 'ST' || (o_custkey % 30) AS welder, 'AREA ' || (o_custkey % 12) AS area, 'H' || (o_orderkey % 9) || CASE WHEN o_orderkey % 9 <> o_orderkey % 4 THEN '|H' || (o_orderkey % 4) ELSE '' END AS heats,
 CASE WHEN o_orderstatus = 'F' THEN 'pass' ELSE 'fail' END AS result, o_orderkey, o_custkey FROM orders)"""


@bound("i3_weld_log_rows", f"WITH {_ROWS} SELECT sheet, row_no, weld_number, weld_date, welder, area, heats, result FROM r")
def weld_log_rows(spark, sf_dir):
    return rows(spark, sf_dir).select("sheet", "row_no", "weld_number", "weld_date", "welder", "area", F.array_join("heats", "|").alias("heats"), "result")


@bound("i3_weld_log_issues", f"""WITH {_ROWS} SELECT sheet, row_no, 'no weld number' AS problem FROM r WHERE weld_number IS NULL UNION ALL SELECT sheet, row_no, 'unreadable date' FROM r WHERE weld_date IS NULL
UNION ALL SELECT sheet, row_no, 'duplicate weld number' FROM r WHERE weld_number IS NOT NULL QUALIFY count(*) OVER (PARTITION BY sheet, weld_number) > 1""")
def weld_log_issues(spark, sf_dir):
    return ingest.issues(rows(spark, sf_dir)).drop("file")


def plan(spark, sf_dir):
    c, s, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier"), read(spark, sf_dir, "orders")
    areas = c.select((F.col("c_custkey") % 9).alias("area_id")).distinct().withColumn("area", F.concat(F.lit("AREA "), "area_id"))
    people = s.select((F.col("s_suppkey") % 25).alias("welder_id")).distinct().withColumn("welder", F.concat(F.lit("ST"), "welder_id"))
    existing = o.where("o_orderkey % 3 = 0").select((F.col("o_custkey") % 12).alias("area_id"), F.col("o_orderkey").cast("string").alias("weld_number")).distinct()
    return ingest.import_plan(rows(spark, sf_dir), areas, people, existing)


# Areas and people are those that the tables have, whatever their number.
_REGISTERS = f"""{_ROWS}, areas AS (SELECT DISTINCT c_custkey % 9 AS area_id, 'AREA ' || (c_custkey % 9) AS area FROM customer), people AS (SELECT DISTINCT s_suppkey % 25 AS welder_id, 'ST' || (s_suppkey % 25) AS welder FROM supplier),
e AS (SELECT DISTINCT o_custkey % 12 AS area_id, o_orderkey::VARCHAR AS weld_number FROM orders WHERE o_orderkey % 3 = 0),
p AS (SELECT r.*, a.area_id, w.welder_id FROM r LEFT JOIN areas a USING (area) LEFT JOIN people w USING (welder) WHERE weld_number IS NOT NULL AND weld_date IS NOT NULL)"""


@bound("i8_import_plan", f"""WITH {_REGISTERS} SELECT p.area_id, welder_id, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.area_id = p.area_id AND e.weld_number = p.weld_number) THEN 'update' ELSE 'create' END AS plan, count(*) AS n FROM p GROUP BY ALL""")
def import_plan(spark, sf_dir):
    return plan(spark, sf_dir).groupBy("area_id", "welder_id", "plan").agg(F.count(F.lit(1)).alias("n"))


@bound("j26_unresolved_names", f"WITH {_REGISTERS} SELECT welder AS name, count(*) AS n_rows FROM p WHERE welder_id IS NULL AND welder IS NOT NULL GROUP BY welder")
def unresolved_names(spark, sf_dir):
    return ingest.unresolved(plan(spark, sf_dir), "welder", "welder_id")


@bound("i12_labelled_fields", r"""SELECT page_id, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang, nullif(regexp_extract(html, 'charset="([a-z0-9-]+)"', 1), '') AS charset FROM pages""")
def labelled_fields(spark, sf_dir):
    lines = read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "\n", -1)).alias("line_no", "line"))
    return ingest.labelled_fields(lines, ["page_id"], "line_no", "line", {"lang": '<html lang="([a-z]+)"', "charset": 'charset="([a-z0-9-]+)"'}).select("page_id", "lang", "charset")


@bound("i15_scaffold", """SELECT c_custkey, r_regionkey AS section, CASE WHEN r_regionkey % 3 = 0 OR seg = c_mktsegment THEN 'open' ELSE 'not_applicable' END AS status, CASE WHEN r_regionkey % 3 <> 0 AND seg <> c_mktsegment THEN 'only for ' || seg END AS na_reason
FROM customer, (SELECT r_regionkey, CASE r_regionkey % 3 WHEN 1 THEN 'BUILDING' ELSE 'MACHINERY' END AS seg FROM region)""")
def scaffold(spark, sf_dir):
    k = F.col("r_regionkey")
    template = read(spark, sf_dir, "region").select(k.alias("section"), F.when(k % 3 == 0, "all").when(k % 3 == 1, "BUILDING").otherwise("MACHINERY").alias("applies"))
    return ingest.scaffold(read(spark, sf_dir, "customer"), template, "c_custkey", "c_mktsegment", "applies", "section")
