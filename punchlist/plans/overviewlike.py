"""Customers written out as the overview sheets of weld logs, one per nation, and read back.

A sheet's tokens come in no order. Residues leave values out: a welder without a date, a dash, an inspector without documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import overview
from .bound import bound, read

#: Each customer as a welder of its nation's sheet: what its line says.
_WELDERS = """c AS (
  SELECT c_custkey AS k, c_nationkey AS nation, 'P' || c_nationkey AS sheet, 100 + c_custkey AS line_no,
    'HAND ' || chr(CAST(65 + c_custkey % 26 AS INT)) || chr(CAST(65 + c_custkey DIV 26 % 26 AS INT)) || chr(CAST(65 + c_custkey DIV 676 % 26 AS INT)) || ' X' AS name,
    CASE WHEN c_custkey % 17 = 3 THEN '' WHEN c_custkey % 13 = 5 THEN 'M' || c_custkey || ' & L' WHEN c_custkey % 13 = 6 THEN 'A' || c_custkey || ' B' ELSE 'S' || c_custkey END AS stamp,
    c_custkey % 6 <> 1 AND c_custkey % 17 <> 3 AS dated, DATE '1996-01-01' + CAST(c_custkey * 7 % 1000 AS INT) AS expires, c_custkey % 5 <> 2 AS submitted, 20 + c_custkey % 60 AS welds,
    CAST(60 + c_custkey % 41 AS DOUBLE) AS visual, CAST(5 + c_custkey % 30 AS DOUBLE) + 0.5 AS ndt, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 4 END AS failed_visuals, c_custkey % 7 AS failed_ndt
  FROM {customer}),
t AS (SELECT nation, sheet, sum(welds) AS welds FROM c GROUP BY nation, sheet)"""
#: What the form's own tables say: sheets whose accounts of the same welds do not agree, and one that has no such tables.
_TABLES = """j AS (
  SELECT sheet, nation, 20 AS line_no, 'joint_type' AS role, 'Butt Welds' AS label, welds - 11 AS n, CASE WHEN nation % 4 = 1 THEN 100.5 ELSE 100.0 END AS visual, 15.0 AS ndt, 2 AS failed_ndt FROM t WHERE nation <> 7
  UNION ALL SELECT sheet, nation, 21, 'joint_type', 'Socket Wlds', 11 + nation % 3, 100.0, 9.1, 0 FROM t WHERE nation <> 7
  UNION ALL SELECT sheet, nation, 30, 'total', 'Project Totals', welds + CASE nation % 5 WHEN 4 THEN 50 ELSE 0 END, 100.0, CASE WHEN nation % 6 = 2 THEN 110.0 ELSE 14.2 END, 2 FROM t WHERE nation <> 9)"""


def sql_of(text: str, dialect: str) -> str:
    return text.replace(" DIV ", " // " if dialect == "duck" else " DIV ").replace("{customer}", "customer" if dialect == "duck" else "{customer}")


def tables(spark, sf_dir):
    """(welders, tables) as the views that both dialects know."""
    customer = read(spark, sf_dir, "customer")
    of = lambda name: spark.sql(sql_of(f"WITH {_WELDERS}, {_TABLES} SELECT * FROM {name}", "spark"), customer=customer)
    return of("c"), of("j")


def runs(spark, sf_dir):
    """(sheet, line_no, x, text): the tokens of all sheets."""
    c, j = tables(spark, sf_dir)
    k, dash = F.col("k"), F.lit("-")
    token = lambda x, text: F.struct(F.lit(float(x)).alias("x"), text.cast("string").alias("text"))
    percent = lambda v: F.concat(F.format_string("%.1f", F.col(v).cast("double")), F.lit("%"))
    welder = F.array(
        token(400, F.col("failed_ndt")), token(10, F.col("name")), token(60, F.nullif("stamp", F.lit(""))), token(100, F.when(F.col("dated"), F.date_format("expires", "M/d/yyyy"))), token(140, F.when(F.col("submitted"), "Submitted")),
        token(200, F.col("welds")), token(240, percent("visual")), token(280, percent("ndt")), token(320, F.coalesce(F.col("failed_visuals").cast("string"), dash)),
        # An inspector on the same line, right of the tables.
        token(600, F.when(k % 9 == 4, F.concat(F.lit("Insp "), F.col("k")))), token(700, F.when(k % 9 == 4, F.when(k % 2 == 0, "CWI").otherwise("rt"))), token(800, F.when((k % 9 == 4) & (k % 4 != 0), "Submitted")),
    )
    own = c.select("sheet", "line_no", F.explode(welder).alias("t"))
    rollup = F.array(token(10, F.col("label")), token(200, F.format_number("n", 0)), token(240, percent("visual")), token(280, percent("ndt")), token(320, dash), token(400, F.col("failed_ndt")))
    rolled = j.select("sheet", "line_no", F.explode(rollup).alias("t"))
    n = F.col("nation")
    at = lambda line, x, text: F.struct(F.lit(line).alias("line_no"), token(x, text).alias("t"))
    brand = F.when(n % 3 != 0, "North Energy PIC:").otherwise("South Oil PIC:")
    form = F.array(
        at(1, 10, F.lit("Location Name:")), at(1, 90, F.concat(F.lit("PAD "), n)), at(1, 300, F.lit("Date:")), at(1, 340, F.when(n % 4 != 3, "3/4/1997")),
        at(2, 10, brand), at(2, 90, F.lit("Jo Doe")), at(2, 300, F.lit("Welding Company:")), at(2, 380, F.lit("Weldco")),
        at(3, 500, F.when(n % 8 != 5, "Requirement- 100%")), at(4, 10, F.lit("Inspection Summary")), at(5, 500, F.when(n % 8 != 5, "visual & 10% NDE")),
        at(9, 10, F.lit("Welder Name")), at(9, 200, F.lit("Welds")), at(9, 240, F.lit("Visuals")), at(9, 430, F.lit("Failed NDT")), at(90, 10, F.lit("Empty Row")),
    )
    heads = c.select("sheet", "nation").distinct().select("sheet", F.explode(form).alias("f")).select("sheet", "f.line_no", "f.t")
    return own.unionByName(rolled).unionByName(heads).select("sheet", "line_no", "t.x", "t.text").where("text is not null")


def books(spark, sf_dir):
    n = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(
        F.concat(F.lit("P"), n).alias("sheet"), F.when(n % 5 != 3, F.lit("1997-06-30").cast("date")).alias("construction_end"), F.when(n % 4 == 0, "north energy").when(n % 4 == 1, "East").when(n % 4 == 2, "South Oil Co").alias("recorded_operator")
    )


_DUCK = sql_of(f"{_WELDERS}, {_TABLES}", "duck")


@bound("i14_overview_rows", f"""WITH {_DUCK}
SELECT sheet, line_no, 'welder' AS role, name AS label, CASE WHEN dated OR submitted THEN CASE WHEN stamp = '' THEN name ELSE stamp END ELSE '' END AS stamp, CASE WHEN dated THEN expires END AS wpq_expires, submitted, NULL AS qualification,
  welds AS weld_count, visual AS visual_pct, ndt AS ndt_pct, failed_visuals, failed_ndt FROM c WHERE stamp <> ''
UNION ALL SELECT sheet, line_no, 'welder', name, '', CASE WHEN dated THEN expires END, submitted, NULL, welds, visual, ndt, failed_visuals, failed_ndt FROM c WHERE stamp = ''
UNION ALL SELECT sheet, line_no, role, label, NULL, NULL, NULL, NULL, n, visual, ndt, NULL, failed_ndt FROM j
UNION ALL SELECT sheet, line_no, 'inspector', 'Insp ' || k, NULL, NULL, k % 4 <> 0, CASE WHEN k % 2 = 0 THEN 'CWI' ELSE 'RT' END, NULL, NULL, NULL, NULL, NULL FROM c WHERE k % 9 = 4""")
def overview_rows(spark, sf_dir):
    return overview.overview_rows(runs(spark, sf_dir))


@bound("i14_overview_headers", """SELECT 'P' || n AS sheet, 'PAD ' || n AS location, CASE WHEN n % 4 <> 3 THEN DATE '1997-03-04' END AS sheet_date, 'Jo Doe' AS operator_pic, 'Weldco' AS welding_company, CASE WHEN n % 3 <> 0 THEN 'North Energy' ELSE 'South Oil' END AS operator_label,
CASE WHEN n % 8 <> 5 THEN 100.0 END::DOUBLE AS required_visual_pct, CASE WHEN n % 8 <> 5 THEN 10.0 END::DOUBLE AS required_nde_pct FROM (SELECT DISTINCT c_nationkey AS n FROM customer)""")
def overview_headers(spark, sf_dir):
    return overview.overview_headers(runs(spark, sf_dir)).select("sheet", "location", "sheet_date", "operator_pic", "welding_company", "operator_label", "required_visual_pct", "required_nde_pct")


@bound("a29_overview_checks", f"""WITH {_DUCK}, w AS (SELECT *, CASE WHEN stamp <> '' AND (dated OR submitted) THEN stamp ELSE '' END AS st FROM c),
s AS (SELECT t.nation, t.sheet, t.welds AS w, coalesce(sum(n) FILTER (role = 'joint_type'), 0) AS j, max(n) FILTER (role = 'total') AS total, CASE WHEN t.nation % 5 <> 3 THEN DATE '1997-06-30' END AS until, CASE WHEN t.nation % 8 <> 5 THEN 10.0 END AS owed FROM t LEFT JOIN j ON j.sheet = t.sheet GROUP BY ALL)
SELECT sheet, 'overview.rollups_disagree' AS rule_id, 'critical' AS severity, 'Project Totals' AS subject, j - w AS amount FROM s WHERE j > 0 AND j <> w
UNION ALL SELECT sheet, 'overview.total_matches_neither', 'critical', 'Project Totals', total FROM s WHERE total <> w AND total <> j
UNION ALL SELECT sheet, 'overview.coverage_above_100', 'critical', label, round(visual / 100 * n) - n FROM j WHERE visual > 100 UNION ALL SELECT sheet, 'overview.coverage_above_100', 'critical', label, round(ndt / 100 * n) - n FROM j WHERE ndt > 100
UNION ALL SELECT sheet, 'overview.welder_without_wpq_expiry', 'critical', name || ' (' || CASE st WHEN '' THEN 'no stamp' ELSE st END || ')', welds FROM w WHERE NOT dated
UNION ALL SELECT sheet, 'overview.combined_stamp', 'critical', name || ' (' || st || ')', welds FROM w WHERE st LIKE '% %'
UNION ALL SELECT w.sheet, 'overview.wpq_expires_in_window', 'warning', name || ' (' || CASE st WHEN '' THEN 'no stamp' ELSE st END || ')', welds FROM w JOIN s USING (sheet) WHERE dated AND expires < until
UNION ALL SELECT w.sheet, 'overview.nde_below_requirement', 'critical', name || ' (' || CASE st WHEN '' THEN 'no stamp' ELSE st END || ')', ceil(owed / 100 * welds) - round(ndt / 100 * welds) FROM w JOIN s USING (sheet) WHERE ndt < owed
UNION ALL SELECT j.sheet, 'overview.nde_below_requirement', 'critical', label, ceil(owed / 100 * n) - round(ndt / 100 * n) FROM j JOIN s USING (sheet) WHERE role = 'joint_type' AND ndt < owed
UNION ALL SELECT sheet, 'overview.operator_branding_stale', 'warning', CASE WHEN nation % 3 <> 0 THEN 'North Energy PIC' ELSE 'South Oil PIC' END, NULL FROM s WHERE nation % 4 = 1 OR nation % 4 = 0 AND nation % 3 = 0 OR nation % 4 = 2 AND nation % 3 <> 0
UNION ALL SELECT sheet, 'overview.inspector_documentation_missing', 'warning', 'Insp ' || k, NULL FROM c WHERE k % 9 = 4 AND k % 4 = 0""")
def overview_checks(spark, sf_dir):
    r = runs(spark, sf_dir)
    return overview.overview_findings(overview.overview_rows(r), overview.overview_headers(r), books(spark, sf_dir))


#: Rows of people by residue classes: each class of a book is one person under three stamps and two names in a chain; some are known.
_PEOPLE = """p AS (SELECT CAST(o_custkey % 25 AS STRING) AS book, 'r' || lpad(CAST(o_orderkey AS STRING), 9, '0') AS row_id, o_orderkey % 40 AS c, o_orderkey DIV 40 % 3 AS v,
  CASE WHEN o_orderkey % 40 = 39 THEN ' ' WHEN o_orderkey % 40 = 38 THEN 'A + B' ELSE ' s' || (o_orderkey % 40) || CASE o_orderkey DIV 40 % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a' ELSE 'b' END END AS stamp,
  'Name  ' || (o_orderkey % 40) || CASE o_orderkey DIV 40 % 3 WHEN 0 THEN 'x' ELSE 'y' END AS name, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS wpq_expires FROM {orders}),
g AS (SELECT CAST(n_nationkey AS STRING) AS book, 'known' || CAST(n AS STRING) AS person_id, CASE WHEN n % 3 = 0 THEN 'S' || n || 'A' ELSE 'Q' || n END AS initials, CASE WHEN n % 3 = 1 THEN 'name ' || n || 'Y' ELSE 'Other ' || n END AS full_name, CASE WHEN n % 3 = 2 THEN 'NAME ' || n || 'y' END AS alias
  FROM {nation} CROSS JOIN (SELECT EXPLODED AS n) WHERE n % 4 = 1)"""


def people(spark, sf_dir):
    sql = f"WITH {_PEOPLE.replace('EXPLODED', 'explode(sequence(0, 37))')} SELECT * FROM "
    tables = {"orders": read(spark, sf_dir, "orders"), "nation": read(spark, sf_dir, "nation")}
    rows, register = spark.sql(sql + "p", **tables), spark.sql(sql + "g", **tables)
    return rows.select("book", "row_id", "stamp", "name", "wpq_expires"), register.select("book", "person_id", "initials", "full_name", F.when(F.col("alias").isNotNull(), F.array("alias")).alias("name_aliases"))


_PLAN = _PEOPLE.replace("EXPLODED", "unnest(range(38))").replace(" DIV ", " // ").replace("{orders}", "orders").replace("{nation}", "nation") + """,
f AS (SELECT p.*, CASE WHEN c >= 38 THEN 0 WHEN c % 4 = 1 AND c % 3 = 0 AND v < 2 THEN 1 WHEN c % 4 = 1 AND c % 3 = 1 AND v > 0 THEN 2 WHEN c % 4 = 1 AND c % 3 = 2 AND v > 0 THEN 3 ELSE 9 END AS hit FROM p),
parts AS (SELECT *, CASE WHEN hit = 9 THEN count(*) FILTER (hit = 9 AND v = 1) OVER (PARTITION BY book, c) > 0 END AS bridged FROM f),
i AS (SELECT *, min(row_id) FILTER (hit = 9) OVER (PARTITION BY book, c, CASE WHEN bridged THEN 1 ELSE 10 + v END) AS first FROM parts)"""


@bound("j28_people_of_the_sheet", f"""WITH {_PLAN}
SELECT book, row_id, CASE WHEN hit = 0 THEN 'skip' WHEN hit < 9 OR first <> row_id THEN 'match' ELSE 'create' END AS action, CASE WHEN hit BETWEEN 1 AND 3 THEN ['stamp', 'name', 'alias'][hit] WHEN hit = 9 AND first <> row_id THEN 'batch' END AS matched_by,
  CASE WHEN hit BETWEEN 1 AND 3 THEN 'known' || c WHEN hit = 9 THEN first END AS person_id, CASE c WHEN 39 THEN 'no_stamp' WHEN 38 THEN 'combined_stamp' END AS skip_reason FROM i""")
def people_of_the_sheet(spark, sf_dir):
    return overview.people_plan(*people(spark, sf_dir)).select("book", "row_id", "action", "matched_by", "person_id", "skip_reason")


@bound("j28_second_import", f"""WITH {_PLAN} SELECT book, count(*) FILTER (hit = 0) AS skipped, count(*) FILTER (hit > 0) AS matched, 0 AS created FROM i GROUP BY book""")
def second_import(spark, sf_dir):
    """The same sheets once more, against the register with what the first import created: nothing is new."""
    rows, register = people(spark, sf_dir)
    created = overview.entries_of(overview.people_plan(rows, register))
    again = overview.people_plan(rows, register.unionByName(created))
    n = lambda a: F.count_if(F.col("action") == a)
    return again.groupBy("book").agg(n("skip").alias("skipped"), n("match").alias("matched"), n("create").alias("created"))
