"""Orders and line items written out as the cells of weld, torque and pressure logs, and read back by the log readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import plain_header_key
from ..operators import flowline, grids, ingest, logs
from ..sources.shared import written
from .bound import bound, date, day, read
from .records import ctes, records


def cells(rows: DataFrame, sheet: Column, key: Column, heads: dict[str, Column], above: dict[int, list[str]] | None = None) -> DataFrame:
    """One sheet per value of ``sheet``: rows of ``above``, the heads below them, then the rows by ``key`` (0, 1, ...)."""
    top = max(above or {}, default=-1) + 1
    body = rows.select(sheet.alias("sheet"), (key + top + 1).cast("int").alias("row_no"), F.posexplode(F.array(*[c.cast("string") for c in heads.values()])).alias("col_no", "value"))
    lines = [*(above or {}).items(), (top, list(heads))]
    head = F.array(*[F.struct(F.lit(r).alias("row_no"), F.lit(c).alias("col_no"), F.lit(v).alias("value")) for r, vs in lines for c, v in enumerate(vs) if v])
    fixed = rows.select(sheet.alias("sheet")).distinct().select("sheet", F.explode(head).alias("c")).select("sheet", "c.*")
    return body.unionByName(fixed).withColumn("file", F.lit("log")).where("value IS NOT NULL")


def _one_of(*values: str | None) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("o_orderkey") % len(values) + 1).cast("int"))


def facility(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    c = cells(o, F.concat(F.lit("F"), k % 8), F.floor(k / 8), {
        "Weld #": F.when(k % 33 == 32, " ").otherwise(F.concat(F.lit(" "), F.when(k % 50 == 11, F.lit(11)).otherwise(k))), "Date": F.when(k % 90 == 5, "soon").when(k % 17 != 0, F.date_format(day("o_orderdate"), "M/d/yyyy")), "Welder": F.when(k % 13 != 0, F.concat(F.lit("s"), F.col("o_custkey") % 70)), "Joint Type": _one_of("Butt", "sock", None, "O-Let"),
        "Pipe Size / Schedule": F.lit("not a name that is known"), "Size": _one_of('2" SCH.40 STD', "6 sch40 std", "9 sch 3"), "Grade": _one_of("X52", "Gr B"), "Design Pressure (psi)": F.concat(k % 7 * 500 + 100, F.lit(" psi")), "% SMYS": F.when(k % 6 == 0, F.format_string("%.4f %%", 100 * (k % 7 * 500 + 100) * 2.375 / 0.308 / 52000 + F.when(k % 12 == 0, 0.5).otherwise(0.0))),
        "CWI Visual": _one_of("Acc", "PENDING", "rej"), "NDT": _one_of("RT", None, "--", "Ut"), "Ticket": F.when(k % 5 != 0, F.concat(F.lit("T"), k)), "Required Inspection": F.when(k % 10 == 6, " low  stress ").when(k % 10 == 7, "High Stress"), "NDT Result": _one_of("yes", "Partial", None, "FAIL", "pass:"),
    })
    return c, ingest.located_headers(c, ingest.synonyms(spark, logs.FACILITY_WELD), least=logs.LEAST_FIELDS)


# What the workbook's columns say, read from the orders; stress by the formula with the two sizes and grades that are written.
_FACILITY = """o AS (SELECT *, o_orderkey AS k, 'F' || (o_orderkey % 8) AS sheet, (o_orderkey // 8 + 1)::INTEGER AS row_no FROM orders WHERE o_orderkey % 33 <> 32),
a AS (SELECT *, CASE WHEN k % 50 = 11 THEN '11' ELSE k::VARCHAR END AS num, CASE k % 3 WHEN 0 THEN 2.375 WHEN 1 THEN 6.625 END AS od, CASE k % 3 WHEN 0 THEN 0.154 WHEN 1 THEN 0.28 END AS wall, CASE k % 2 WHEN 0 THEN 52000 ELSE 35000 END AS smys, (k % 7 * 500 + 100)::DOUBLE AS p, CASE WHEN k % 6 = 0 THEN round(100 * (k % 7 * 500 + 100) * 2.375 / 0.308 / 52000 + CASE WHEN k % 12 = 0 THEN 0.5 ELSE 0 END, 4) / 100 END AS said,
  CASE k % 4 WHEN 0 THEN 'RT' WHEN 3 THEN 'UT' END AS method, CASE k % 5 WHEN 0 THEN 'pass' WHEN 3 THEN 'fail' WHEN 4 THEN 'pass' END AS result, CASE k % 3 WHEN 0 THEN 'pass' WHEN 2 THEN 'fail' END AS visual, CASE WHEN k % 13 <> 0 THEN 's' || (o_custkey % 70) END AS stamp, CASE WHEN k % 90 <> 5 AND k % 17 <> 0 THEN o_orderdate::DATE END AS d FROM o),
b AS (SELECT *, p * od / (2 * wall) / smys AS share, CASE WHEN row_number() OVER (PARTITION BY sheet, num ORDER BY row_no) > 1 THEN 'duplicate weld number' WHEN k % 90 = 5 THEN 'unreadable date' END AS rejected FROM a),
f AS (SELECT *, CASE WHEN rejected IS NOT NULL THEN 'error:' || rejected ELSE array_to_string(list_filter([CASE WHEN stamp IS NULL THEN 'warning:no welder stamp' END, CASE WHEN od IS NULL THEN 'warning:stress not computable' END, CASE WHEN abs(said - share) > 0.00005 THEN 'warning:stress differs' END,
  CASE WHEN method IS NOT NULL AND (k % 5 = 0 OR result IS NULL) THEN 'warning:examination incomplete' END], lambda x: x IS NOT NULL), ';') END AS issues FROM b)"""


@bound("i3_facility_welds", f"WITH {_FACILITY} SELECT sheet, row_no, num AS weld_number, d AS weld_date, stamp AS welder_stamp, CASE k % 4 WHEN 0 THEN 'Butt' WHEN 1 THEN 'Socket' WHEN 3 THEN 'O-let' END AS joint_type, p AS design_pressure_psi, visual AS cwi_visual_result, method AS ndt_method, result AS ndt_result, round(share, 8) AS pct_smys, CASE WHEN result IS NOT NULL THEN 'ndt_complete' WHEN visual IS NOT NULL THEN 'visual_complete' ELSE 'welded' END AS status, rejected, issues FROM f")
def facility_welds(spark, sf_dir):
    out = logs.facility_welds(*facility(spark, sf_dir))
    return out.select("sheet", "row_no", "weld_number", "weld_date", "welder_stamp", "joint_type", "design_pressure_psi", "cwi_visual_result", "ndt_method", "ndt_result", F.round("pct_smys", 8).alias("pct_smys"), "status", "rejected", F.array_join("issues", ";").alias("issues"))


@bound("i8_plan_findings", f"""WITH {_FACILITY}, {ctes('welder', 'welder_qualification')}, j AS (SELECT f.*, w.id AS who FROM f LEFT JOIN welder w ON upper(w.initials) = upper(f.stamp) WHERE rejected IS NULL),
v AS (SELECT DISTINCT who, d FROM j WHERE who IS NOT NULL AND d IS NOT NULL), u AS (SELECT who, d, CASE WHEN count(q.welder_id) = 0 THEN 'no' WHEN bool_or(qualification_date <= d AND (expiry_date IS NULL OR expiry_date >= d)) THEN 'ok' WHEN bool_and(coalesce(expiry_date < d, false)) THEN 'no' WHEN bool_or(qualification_date IS NULL) THEN 'unknown' ELSE 'no' END AS v FROM v LEFT JOIN welder_qualification q ON q.welder_id = who GROUP BY ALL),
x AS (SELECT j.*, u.v FROM j LEFT JOIN u USING (who, d)), c AS (SELECT sheet, 'weldlog.weld_without_stamp' AS rule_id, 'critical' AS severity, count(*) FILTER (stamp IS NULL) AS n FROM x GROUP BY 1 UNION ALL SELECT sheet, 'weldlog.stamp_not_in_register', 'critical', count(DISTINCT stamp) FILTER (who IS NULL) FROM x GROUP BY 1
  UNION ALL SELECT sheet, 'weldlog.weld_outside_qualification', 'critical', count(*) FILTER (v = 'no') FROM x GROUP BY 1 UNION ALL SELECT sheet, 'weldlog.qualification_currency_unverifiable', 'warning', count(DISTINCT stamp) FILTER (v = 'unknown') FROM x GROUP BY 1 UNION ALL SELECT sheet, 'weldlog.weld_dated_after_log', 'critical', count(*) FILTER (d > DATE '1997-06-01') FROM x GROUP BY 1
  UNION ALL SELECT sheet, 'weldlog.weld_before_construction', 'warning', count(*) FILTER (d < DATE '1992-03-01') FROM x GROUP BY 1 UNION ALL SELECT sheet, 'weldlog.tier_disagreement', 'warning', count(*) FILTER (k % 10 = 6 AND share >= 0.2 OR k % 10 = 7 AND share < 0.2) FROM x GROUP BY 1)
SELECT * FROM c WHERE n > 0""")
def plan_findings(spark, sf_dir):
    t = records(spark, sf_dir, "welder", "welder_qualification")
    rows = logs.facility_welds(*facility(spark, sf_dir), bands=[("Low Stress", 0.0, 0.2, 0.1), ("High Stress", 0.2, None, 1.0)])
    return logs.weld_plan_findings(rows, t["welder"], t["welder_qualification"], date("1997-06-01"), date("1992-03-01")).drop("file")


def flowline_rows(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    c = cells(o, F.concat(F.lit("L"), k % 6), F.floor(k / 6), {
        "Weld No": k, "Weld Date": F.when(k % 70 == 3, "n/a").otherwise(F.date_format(day("o_orderdate"), "MM-dd-yy")), "Welder Root/Hot/Fill/Cap": F.when(k % 3 == 0, "CT/CT/ /MR").when(k % 3 == 1, "CT/MR"), "Heat Number": F.concat(F.lit("H"), k % 9, F.when(k % 4 == 0, F.concat(F.lit(" | H"), k % 9 + 1)).when(k % 4 == 1, F.concat(F.lit(";H"), k % 9 + 1, F.lit(";"))).otherwise("")), "Length": F.concat(k % 40, F.lit(".5 ft")),
    })
    return logs.flowline_welds(c, ingest.located_headers(c, ingest.synonyms(spark, logs.FLOWLINE_WELD), least=logs.LEAST_FIELDS))


@bound("i4_flowline_welds", """SELECT 'L' || (k % 6) AS sheet, (k // 6 + 1)::INTEGER AS row_no, k::VARCHAR AS weld_number, CASE WHEN k % 70 <> 3 THEN o_orderdate::DATE END AS weld_date, CASE k % 3 WHEN 0 THEN 'CT' END AS root, CASE k % 3 WHEN 0 THEN 'MR' END AS cap, CASE WHEN k % 4 < 2 THEN 'H' || (k % 9) || '+H' || (k % 9 + 1) ELSE 'H' || (k % 9) END AS heats, (k % 40 + 0.5)::DOUBLE AS part_length,
CASE WHEN k % 70 = 3 THEN 'unreadable date' END AS rejected, CASE WHEN k % 70 = 3 THEN 'error:unreadable date' WHEN k % 3 = 1 THEN 'warning:passes are not four' ELSE '' END AS issues FROM (SELECT *, o_orderkey AS k FROM orders)""")
def flowline_welds(spark, sf_dir):
    out = flowline_rows(spark, sf_dir)
    return out.select("sheet", "row_no", "weld_number", "weld_date", "root", "cap", F.array_join("heat_numbers", "+").alias("heats"), "part_length", "rejected", F.array_join("issues", ";").alias("issues"))


_ABOVE = {0: ["1 02O1 (250)", "", "1/5/1996", "Y"], 1: ["2 0245", "6/1/1996"], 2: ["Torque log", "Total Flanges:", "", "120", "# of Flanges Inspected to date", "7"]}


def torque(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    c = cells(o, F.concat(F.lit("T"), k % 9), F.floor(k / 9), {
        "ISO Flange #": F.when(k % 80 == 79, " ").otherwise(F.concat(F.lit("f-"), k % 300)), "ISO #": F.concat(F.lit("iso"), k % 700), "Required Torque (ft-lbs)": F.when(k % 3 == 0, "100-140").when(k % 3 == 1, "120").otherwise("tight"), "Actual Torque": F.when(k % 11 != 0, F.concat(k % 60 + 90, F.lit(" ft lbs"))), "Wrench ID": F.when(k % 4 == 0, "2O1").when(k % 4 == 1, "245").when(k % 4 == 2, F.concat(F.lit("07"), k % 3, F.lit("1"))).when(k % 20 != 3, "0244"),
        "Torque Date": F.when(k % 60 == 7, "tbd").when(k % 6 != 5, F.date_format(day("o_orderdate"), "M.d.yyyy")), "Inspection Date": F.when(k % 5 == 0, F.date_format(day("o_orderdate"), "yyyy-MM-dd")).when(k % 5 == 1, "JB"), "Inspector Initials": F.when(k % 7 != 0, "QC"),
    }, _ABOVE)
    return c, ingest.located_headers(c, ingest.synonyms(spark, logs.FACILITY_TORQUE), least=logs.LEAST_FIELDS)


_TORQUE = """a AS (SELECT *, o_orderkey AS k, 'T' || (o_orderkey % 9) AS sheet, (o_orderkey // 9 + 4)::INTEGER AS row_no, CASE WHEN o_orderkey % 4 = 0 THEN '0201' WHEN o_orderkey % 4 = 1 THEN '0245' WHEN o_orderkey % 4 = 2 THEN '07' || (o_orderkey % 3) || '1' WHEN o_orderkey % 20 <> 3 THEN '0244' END AS w FROM orders WHERE o_orderkey % 80 <> 79),
b AS (SELECT *, CASE k % 3 WHEN 0 THEN 100.0 WHEN 1 THEN 120.0 END::DOUBLE AS lo, CASE k % 3 WHEN 0 THEN 140.0 WHEN 1 THEN 120.0 END::DOUBLE AS hi, CASE WHEN k % 11 <> 0 THEN (k % 60 + 90)::DOUBLE END AS act, CASE WHEN k % 60 = 7 THEN 'unreadable date' WHEN w IS NULL THEN 'no wrench' END AS rejected, CASE WHEN k % 5 = 0 THEN o_orderdate::DATE END AS insp, CASE WHEN k % 7 <> 0 THEN 'QC' END AS who FROM a),
f AS (SELECT *, CASE WHEN rejected IS NOT NULL THEN 'error:' || rejected ELSE array_to_string(list_filter([CASE WHEN lo IS NULL THEN 'warning:unreadable requirement' END, CASE WHEN act IS NULL THEN 'warning:no actual torque' END, CASE WHEN NOT act BETWEEN lo AND hi THEN 'warning:outside the range' END, CASE WHEN k % 5 = 1 THEN 'warning:unreadable inspection date' END, CASE WHEN insp IS NOT NULL AND who IS NULL THEN 'warning:inspection without inspector' END], lambda x: x IS NOT NULL), ';') END AS issues FROM b)"""


@bound("i5_torque_rows", f"WITH {_TORQUE} SELECT sheet, row_no, 'f-' || (k % 300) AS iso_flange_number, lo AS required_min, hi AS required_max, act AS actual, w AS wrench_id_raw, CASE WHEN k % 60 <> 7 AND k % 6 <> 5 THEN o_orderdate::DATE END AS torque_date, insp AS inspection_date, rejected, issues FROM f")
def torque_rows(spark, sf_dir):
    out = logs.torque_rows(*torque(spark, sf_dir), logs.FACILITY_TORQUE)
    return out.select("sheet", "row_no", "iso_flange_number", "required_min", "required_max", "actual", "wrench_id_raw", "torque_date", "inspection_date", "rejected", F.array_join("issues", ";").alias("issues"))


@bound("a30_torque_log_issues", f"""WITH {_TORQUE}, t AS (SELECT * FROM f WHERE rejected IS NULL), g AS (SELECT sheet, 'F-' || (k % 300) AS subject, count(*) AS n, count(DISTINCT k % 700) AS i FROM t GROUP BY ALL HAVING count(*) > 1), p AS (SELECT sheet, count(*) AS n, count(insp) AS d, count(*) FILTER (k % 5 = 1) AS u FROM t GROUP BY 1)
SELECT sheet, CASE WHEN i = n THEN 'warning:flange on several isometrics' ELSE 'error:flange entered twice' END AS issue, subject, n FROM g UNION ALL SELECT sheet, 'info:inspections without a date', NULL, u FROM p WHERE u > 0 UNION ALL SELECT sheet, 'info:inspected total is stale', NULL, 7 FROM p WHERE d <> 7 UNION ALL SELECT sheet, 'info:flange total differs', NULL, 120 FROM p WHERE n <> 120
UNION ALL SELECT sheet, 'warning:wrench not on the roster', w, count(*) FROM t WHERE w NOT IN ('0201', '0245') GROUP BY sheet, w""")
def torque_log_issues(spark, sf_dir):
    c, h = torque(spark, sf_dir)
    return logs.torque_log_issues(logs.torque_rows(c, h, logs.FACILITY_TORQUE), logs.roster(c, h), logs.header_totals(c, h)).drop("file")


@bound("i5_likely_wrenches", f"WITH {_TORQUE} SELECT DISTINCT w AS u, CASE WHEN w = '0244' THEN '0245' WHEN w = '0701' THEN '0201' END AS suggestion FROM f WHERE rejected IS NULL AND w NOT IN ('0201', '0245')")
def likely_wrenches(spark, sf_dir):
    c, h = torque(spark, sf_dir)
    r = logs.roster(c, h)
    absent = logs.torque_log_issues(logs.torque_rows(c, h, logs.FACILITY_TORQUE), r, logs.header_totals(c, h)).where("issue LIKE '%roster'")
    return logs.likely_wrenches(absent, r)


@bound("i6_flowline_torque", """SELECT 'Q' || (k % 5) AS sheet, (k // 5 + 1)::INTEGER AS row_no, 'F' || k AS iso_flange_number, 200.0::DOUBLE AS required_min, (200 + k % 3 * 10)::DOUBLE AS required_max, (k % 30 + 195)::DOUBLE AS actual, lpad((k % 900 + 1)::VARCHAR, 4, '0') AS wrench_id_raw, k % 2 = 0 AS cp_test_on_flange, CASE WHEN (k % 30 + 195) NOT BETWEEN 200 AND 200 + k % 3 * 10 THEN 'warning:outside the range' ELSE '' END AS issues FROM (SELECT o_orderkey AS k FROM orders)""")
def flowline_torque(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    c = cells(o, F.concat(F.lit("Q"), k % 5), F.floor(k / 5), {
        "ISO/Flange Number": F.concat(F.lit("F"), k), "Req Torque": F.concat(k % 3 * 10 + 200, F.lit(" — 200")), "Act Torque": k % 30 + 195, "Wrench": k % 900 + 1, "CP Test": F.when(k % 2 == 0, "y").otherwise("n"), "Date": F.date_format(day("o_orderdate"), "yyyy-MM-dd"),
    })
    out = logs.torque_rows(c, ingest.located_headers(c, ingest.synonyms(spark, logs.FLOWLINE_TORQUE), least=logs.LEAST_FIELDS), logs.FLOWLINE_TORQUE)
    return out.select("sheet", "row_no", "iso_flange_number", "required_min", "required_max", "actual", "wrench_id_raw", "cp_test_on_flange", F.array_join("issues", ";").alias("issues"))


def pressure(spark, sf_dir) -> DataFrame:
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    blank = k % 10 == 4
    c = cells(p, F.concat(F.lit("P"), k % 4), F.floor(k / 4), {
        "Test No.": F.when(k % 15 != 0, F.concat(F.lit("PT-"), k)), "Date Tested": F.when(blank, None).when(k % 8 == 3, "pending").otherwise(F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), (k % 900).cast("int")), "M/d/yy")), "Hold (Minutes)": F.when(blank, "0").otherwise("60 min"), "Start PSI": F.when(blank, "0").otherwise("1,200"), "End  psi": F.when(blank, "0").otherwise(F.concat(F.col("p_size") + 1170, F.lit(""))), "Temp (F)": F.lit("71"),
    })
    headers = ingest.located_headers(c, ingest.synonyms(spark, logs.PRESSURE_HOLD, plain_header_key), rows=40, least=logs.LEAST_FIELDS, key=plain_header_key)
    return logs.pressure_rows(c, headers)


_HOLD = "h AS (SELECT *, p_partkey AS k, 'P' || (p_partkey % 4) AS sheet, (p_partkey // 4 + 1)::INTEGER AS row_no, CASE WHEN p_partkey % 15 <> 0 THEN 'PT-' || p_partkey ELSE 'Row ' || (p_partkey // 4 + 2) END AS ident, CASE WHEN p_partkey % 10 <> 4 AND p_partkey % 8 <> 3 THEN (DATE '1995-01-01' + (p_partkey % 900)::INTEGER)::DATE END AS d, p_partkey % 10 = 4 AS blank FROM part)"


@bound("i7_pressure_rows", f"WITH {_HOLD} SELECT sheet, row_no, ident AS test_identifier, d AS test_date, CASE WHEN blank THEN 0 ELSE 60 END::DOUBLE AS duration_minutes, CASE WHEN blank THEN 0 ELSE 1200 END::DOUBLE AS start_pressure_psi, CASE WHEN blank THEN 0 ELSE 1170 + p_size END::DOUBLE AS end_pressure_psi, CASE WHEN NOT blank AND k % 8 = 3 THEN 'warning:unreadable date' ELSE '' END AS issues, blank AS empty FROM h")
def pressure_rows(spark, sf_dir):
    return pressure(spark, sf_dir).select("sheet", "row_no", "test_identifier", "test_date", "duration_minutes", "start_pressure_psi", "end_pressure_psi", F.array_join("issues", ";").alias("issues"), "empty")


@bound("a36_pressure_plan", f"WITH {_HOLD} SELECT sheet, count(*) FILTER (NOT blank AND NOT e) AS creates, count(*) FILTER (NOT blank AND e) AS updates, count(*) FILTER (NOT blank AND d IS NULL) AS undated, count(*) FILTER (NOT blank AND p_size < 30) AS dropped, count(*) FILTER (blank) AS blanks FROM (SELECT *, k % 3 = 0 AND k % 15 <> 0 AS e FROM h) GROUP BY sheet")
def pressure_plan(spark, sf_dir):
    known = read(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit(" pt-"), "p_partkey").alias("test_identifier"))
    return logs.pressure_plan(pressure(spark, sf_dir), known).drop("file")


# The accepted rows of the flowline logs, and registers by residues: lines of two spellings, welds, heats, welders by initials or alias.
_FLOWLINE = """r AS (SELECT k, 'L' || (k % 6) AS sheet, k % 3 AS m, CASE WHEN k % 4 < 2 THEN [k % 9, k % 9 + 1] ELSE [k % 9] END AS heats FROM (SELECT o_orderkey AS k FROM orders) WHERE k % 70 <> 3)"""


def flowline_plan(spark, sf_dir):
    """(rows, lines, welds, heats, welders) of one book."""
    rows = flowline_rows(spark, sf_dir).where("rejected is null").withColumns({"book": F.lit("B"), "not_used": F.col("weld_number").cast("int") % 20 == 4})
    k = F.col("o_orderkey")
    welds = read(spark, sf_dir, "orders").where((k % 5 == 0) & (k % 6 < 3)).select(F.lit("B").alias("book"), F.concat(F.lit("line"), k % 6).alias("line_id"), F.concat(F.lit(" "), k).alias("weld_number"))
    lines = spark.createDataFrame([("B", "line0", " l0 "), ("B", "line1", "L1"), ("B", "line9", "L9"), ("C", "other", "L2")], "book string, line_id string, line_code string")
    heats = spark.createDataFrame([("B", "h-3"), ("B", "H5 "), ("C", "H1")], "book string, heat_number string")
    welders = spark.createDataFrame([("B", "w1", "ct", "Cy Tee", None), ("C", "w2", "MR", "Mo Roe", None)], "book string, person_id string, initials string, full_name string, name_aliases array<string>")
    return rows, lines, welds, heats, welders


@bound("i9_flowline_lines", f"WITH {_FLOWLINE} SELECT sheet AS code, CASE WHEN sheet IN ('L0', 'L1') THEN 'match' ELSE 'create' END AS action, CASE WHEN sheet IN ('L0', 'L1') THEN 'line' || right(sheet, 1) END AS known, count(*) AS welds FROM r GROUP BY 1")
def flowline_lines(spark, sf_dir):
    rows, lines, *_ = flowline_plan(spark, sf_dir)
    out = flowline.planned_lines(rows, lines)
    return out.select("code", "action", F.when(F.col("action") == "match", F.col("line_id")).alias("known"), "welds")


@bound("i9_flowline_welds", f"WITH {_FLOWLINE} SELECT k::VARCHAR AS weld_number, CASE WHEN k % 5 = 0 AND k % 6 < 2 THEN 'update' ELSE 'create' END AS action FROM r")
def flowline_weld_plan(spark, sf_dir):
    """Welds of a line that is new are created, whatever number another line's register has."""
    rows, lines, welds, *_ = flowline_plan(spark, sf_dir)
    rows = written(spark, rows.select("book", "sheet", "weld_number"), "flowline-rows")
    return flowline.planned_welds(rows, flowline.planned_lines(rows, lines), welds).select("weld_number", "action")


@bound("i9_flowline_heats", f"WITH {_FLOWLINE} SELECT 'H' || h AS heat_number, CASE WHEN h IN (3, 5) THEN 'match' ELSE 'create' END AS action, count(*) AS welds FROM (SELECT k, unnest(heats) AS h FROM r) GROUP BY h")
def flowline_heats(spark, sf_dir):
    rows, _, _, heats, _ = flowline_plan(spark, sf_dir)
    return flowline.planned_heats(rows, heats).select("heat_number", "action", "welds")


@bound("i9_flowline_findings", f"""WITH {_FLOWLINE}, s AS (SELECT unnest(['CT', 'MR']) AS stamp, m FROM r WHERE m = 0) SELECT 'weldlog.weld_without_stamp' AS rule_id, 'critical' AS severity, count(*) AS n FROM r WHERE m = 2 AND k % 20 <> 4
UNION ALL SELECT 'weldlog.stamp_not_in_register', 'critical', count(DISTINCT stamp) FROM s WHERE stamp <> 'CT'""")
def flowline_findings(spark, sf_dir):
    rows, *_, welders = flowline_plan(spark, sf_dir)
    # Read twice below, so written: the log is read into rows once.
    rows = written(spark, rows.select("book", "not_used", "heat_numbers", "passes", *flowline.PASSES), "flowline-rows")
    return flowline.flowline_findings(rows, flowline.planned_stamps(rows, welders)).drop("book")


@bound("w11_page_grid", """WITH e AS (SELECT event_id, user_id % 8 AS page, event_id // 8 AS line_no, event_id % 5 AS c FROM events)
SELECT page, line_no, c AS col_no, string_agg('v' || event_id, ' ' ORDER BY event_id % 50) || CASE WHEN c = 2 THEN ' x' ELSE '' END AS value FROM e WHERE c <> 4 GROUP BY page, line_no, c""")
def page_grid(spark, sf_dir):
    """Tokens that begin up to five points apart, a second one in the cells of one column, and a margin at the left."""
    e = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 8).alias("page"), F.floor(F.col("event_id") / 8).alias("line_no"), (F.col("event_id") % 5).alias("c"))
    x = F.when(F.col("c") == 4, 3.0).otherwise(40.0 + F.col("c") * 60 + F.col("event_id") % 50 / 10)
    first = e.select("page", "line_no", x.alias("x"), F.concat(F.lit(" v"), "event_id").alias("text"))
    more = e.where("c = 2").select("page", "line_no", F.lit(165.5).alias("x"), F.lit("x").alias("text")).distinct()
    return grids.page_grid(first.unionByName(more), ["page"], least_x=10.0).select("page", F.col("row_no").alias("line_no"), F.col("col_no").cast("long"), "value")
