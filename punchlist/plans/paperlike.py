"""Orders written out as the lines of certificates and reports, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs, papers
from .bound import bound, day, read
from .loglike import _TORQUE, torque
from .records import ctes, records


def certificate_lines(spark, sf_dir):
    o, k, d = read(spark, sf_dir, "orders"), F.col("o_orderkey"), day("o_orderdate")
    text = [
        F.lit("  ACME  Calibration Laboratory"), F.when(k % 9 == 0, "").otherwise("Certificate No: C-17 "), F.concat(F.lit("SERIAL NO. # "), F.when(k % 7 == 0, "n/a").otherwise(F.concat(F.lit("QX"), k + 10_000))), F.when(k % 3 == 0, "DATE CALIBRATED:").when(k % 3 == 1, F.concat(F.lit("Date  Calibrated: "), F.date_format(d, "MMMM d, yyyy"))).otherwise("Date Calibrated - soon"),
        F.when(k % 6 == 0, F.date_format(d, "M/d/yyyy")).when(k % 6 == 3, "Model: X1").otherwise("Receipt Date: 1/1/2020"), F.when(k % 4 == 0, F.concat(F.lit("Calibration Due Date: "), F.date_format(F.date_add(d, 365), "yyyy-MM-dd"))).when(k % 4 == 1, "Calibration Due: TBD").otherwise("notes"), F.when(k % 5 == 0, "RANGE AND UNITS: 1,050 to 2,500 ft-lb").otherwise("Range: 250"), F.when(k % 2 == 0, "Final Calibration Status: PASSED").otherwise("STATUS: failed lab"),
    ]
    return o.select(F.concat(F.lit("c"), k).alias("file"), F.posexplode(F.array(*text)).alias("line_no", "text"))


@bound("i12_certificates", """SELECT 'c' || k AS file, CASE WHEN d IS NOT NULL THEN 'parsed' ELSE 'partial' END AS state, CASE WHEN k % 7 <> 0 THEN (k + 10000)::VARCHAR END AS serial, CASE WHEN k % 7 <> 0 THEN right((k + 10000)::VARCHAR, 4) END AS wrench_id, CASE WHEN k % 9 <> 0 THEN 'C-17' END AS certificate_number, CASE WHEN k % 6 = 3 THEN 'X1' END AS model,
CASE WHEN k % 5 = 0 THEN 1050.0 END::DOUBLE AS range_least, CASE WHEN k % 5 = 0 THEN 2500.0 END::DOUBLE AS range_most, d AS date_calibrated, CASE WHEN k % 4 = 0 THEN (o_orderdate::DATE + 365)::DATE END AS due, CASE WHEN k % 2 = 0 THEN 'pass' ELSE 'fail' END AS final_status, CASE WHEN k % 3 <> 0 THEN 'Receipt Date: 1/1/2020' ELSE '' END AS annotations,
array_to_string(list_filter([CASE WHEN k % 3 = 2 THEN 'calibration date is no date' END, CASE WHEN k % 4 = 1 THEN 'due date is no date' END, CASE WHEN k % 4 > 1 AND d IS NOT NULL THEN 'no due date' END], lambda x: x IS NOT NULL), ';') AS warnings
FROM (SELECT *, o_orderkey AS k, CASE WHEN o_orderkey % 6 IN (0, 1, 4) THEN o_orderdate::DATE END AS d FROM orders)""")
def certificates(spark, sf_dir):
    out = papers.certificates(certificate_lines(spark, sf_dir))
    return out.select("file", "state", "serial", "wrench_id", "certificate_number", "model", "range_least", "range_most", "date_calibrated", "due", "final_status", F.array_join("annotations", ";").alias("annotations"), F.array_join("warnings", ";").alias("warnings"))


def report_lines(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = [
        F.concat(F.lit("Rev. Date: 1/1/2001 | REPORT NUMBER: RT-"), k, F.lit(" | REVISION # 2")), F.concat(F.lit("JOB LOCATION: North | pad "), k % 5), F.when(k % 6 != 0, F.concat(F.lit("DATE: "), F.date_format(day("o_orderdate"), "M/d/yyyy"))).otherwise("Cal Date: 2/2/2002"),
        F.concat(F.lit(" 12 NP-"), k % 50, F.lit(" fw 7 W"), k % 9, F.lit("A pass | porosity at 3 | MR2")), F.when(k % 4 == 0, "3 nothing that names any joint here").otherwise("3 short"), F.concat(F.lit("  7 AB "), k % 30, F.lit(" ok CT ")), F.lit("Technician Name (Printed): Jo Doe  Technician Signature: x"),
        F.when(k % 6 == 0, "REV.  DATE 4/4/2004 and CALIBRATION DATE: 3/3/2003  DATE: 5/5/2005").when(k % 5 == 0, "North Sky Testing, Inc. 12 Road").otherwise("Cal Due Date: 7/7/2007"), F.when(k % 12 == 6, "DATE 6/6/2006"),
    ]
    return o.select(F.concat(F.lit("r"), k).alias("report_id"), F.posexplode(F.array(*text)).alias("line_no", "text")).where("text IS NOT NULL")


@bound("i11_report_fields", "SELECT 'r' || k AS report_id, CASE WHEN k % 5 = 0 AND k % 6 <> 0 THEN 'North Sky Testing, Inc.' END AS ndt_company, 'RT-' || k AS report_number, 'Jo Doe' AS technician_name, '2' AS revision, 'North' AS job_location, CASE WHEN k % 6 <> 0 THEN o_orderdate::DATE WHEN k % 12 = 6 THEN DATE '2006-06-06' END AS report_date, CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS unread_rows FROM (SELECT *, o_orderkey AS k FROM orders)")
def report_fields(spark, sf_dir):
    return papers.report_fields(report_lines(spark, sf_dir)).select("report_id", "ndt_company", "report_number", "technician_name", "revision", "job_location", "report_date", "unread_rows")


@bound("i11_report_rows", "SELECT 'r' || k AS report_id, 12 AS sequence, 'NP-' || (k % 50) || ',W-' || (k % 9) || 'A,MR-2' AS candidates, 'MR2' AS welder_stamp, 'porosity at 3' AS discontinuity FROM (SELECT o_orderkey AS k FROM orders) UNION ALL SELECT 'r' || k, 7, 'AB-' || (k % 30), 'CT', NULL FROM (SELECT o_orderkey AS k FROM orders)")
def report_rows(spark, sf_dir):
    return papers.report_rows(report_lines(spark, sf_dir)).select("report_id", "sequence", F.array_join("candidates", ",").alias("candidates"), "welder_stamp", "discontinuity")


@bound("i10_torque_plan", f"""WITH {_TORQUE}, {ctes('torque_wrench')}, t AS (SELECT f.*, CASE WHEN k % 60 <> 7 AND k % 6 <> 5 THEN o_orderdate::DATE END AS td FROM f WHERE rejected IS NULL), rg AS (SELECT lpad(substr(wrench_id, 2), 4, '0') AS code, min(id) AS id FROM torque_wrench GROUP BY 1), j AS (SELECT t.*, r.id AS wid, w.cert_on_file AS fl, w.last_calibration_date AS s, w.calibration_due_date AS e FROM t LEFT JOIN rg r ON r.code = t.w LEFT JOIN torque_wrench w ON w.id = r.id),
c AS (SELECT sheet, count(*) AS n, count(DISTINCT w) FILTER (wid IS NULL) AS unknown, count(DISTINCT w) FILTER (wid IS NOT NULL AND td IS NOT NULL AND NOT coalesce(fl AND s IS NOT NULL AND td >= s AND (e IS NULL OR td <= e), false)) AS lapsed, count(*) FILTER (act < lo OR act > hi) AS outside, count(*) FILTER (insp IS NULL OR who IS NULL) AS unins FROM j GROUP BY 1)
SELECT sheet, 'torque_import.connection_without_wrench' AS rule_id, 'critical' AS severity, count(*) AS n FROM f WHERE rejected = 'no wrench' GROUP BY 1 UNION ALL SELECT sheet, 'torque_import.wrench_not_in_register' AS rule_id, 'critical' AS severity, unknown AS n FROM c WHERE unknown > 0 UNION ALL SELECT sheet, 'torque_import.wrench_calibration_lapsed', 'critical', lapsed FROM c WHERE lapsed > 0 UNION ALL SELECT sheet, 'torque_import.torque_outside_required_range', 'critical', outside FROM c WHERE outside > 0
UNION ALL SELECT sheet, 'torque_import.not_inspected', CASE WHEN unins = n THEN 'critical' ELSE 'warning' END, unins FROM c WHERE unins > 0 UNION ALL SELECT sheet, 'torque_import.header_total_disagrees', 'warning', 120 FROM c WHERE n <> 120""")
def torque_plan(spark, sf_dir):
    cells, headers = torque(spark, sf_dir)
    w = records(spark, sf_dir, "torque_wrench")["torque_wrench"]
    # The log writes numbers of four digits, so the register's codes are told in that form.
    first = w.withColumn("wrench_id", F.lpad(F.substring("wrench_id", 2, 9), 4, "0")).groupBy("wrench_id").agg(F.min(F.struct("id", "cert_on_file", "last_calibration_date", "calibration_due_date")).alias("x")).select("wrench_id", "x.*")
    return papers.torque_plan_findings(logs.torque_rows(cells, headers, logs.FACILITY_TORQUE), logs.header_totals(cells, headers), first).drop("file")


#: Files of two to four pages by residues: a second report, a continuation sheet, a page without text, one that says nothing, pages that
#: are stated and not there, fields that are missing.
def document_pages(spark, sf_dir):
    """(lines, pages): the examination file of each order."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    number = lambda n: F.concat(F.lit("REPORT NUMBER: A"), k, F.lit(n))
    first = [F.when(k % 11 != 1, number("-1")), F.when(k % 7 != 2, "PROCEDURE # P-1 REVISION # 3 REV. DATE: 1/1/2001"), F.when(k % 5 != 3, "DATE: 2/3/2004"), F.when(k % 3 != 1, "Technician Name (Printed) Jo Customer Printed: X"), F.when(k % 4 != 1, "1 FW-1 ok KT"), F.when(k % 9 == 4, "2 plenty of content here and no joint at all"), F.when(k % 8 == 5, "Page 1 of 6")]
    second = [F.when(k % 6 == 0, number("-2")).when(k % 6 == 1, number("-1")).when(k % 6 == 2, "PROCEDURE # P-9").when(k % 6 == 3, "2 FW-2 ok"), F.when(k % 6 == 4, " 9  mm m L /- E- o -")]
    third = [F.when(k % 6 == 0, "PROCEDURE # P-2"), F.when(k % 6 < 3, "DATE 4/4/2004"), F.when(k % 6 < 3, "1 FW-9 ok"), F.when(k % 6 >= 3, "REVISION # 4")]
    page = lambda n, texts: F.transform(F.array(*texts), lambda t, i: F.struct(F.lit(n).alias("page"), i.alias("line_no"), t.alias("text")))
    lines = o.select(F.concat(F.lit("f"), k).alias("file"), F.explode(F.concat(page(1, first), page(2, second), page(3, third))).alias("l")).select("file", "l.*").where("text is not null")
    return lines.where("substr(file, 2) % 13 <> 7"), o.select(F.concat(F.lit("f"), k).alias("file"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("page"))


@bound("i11_document_gaps", """WITH f AS (SELECT 'f' || o_orderkey AS file, o_orderkey AS k, o_orderkey % 6 AS m, o_orderkey % 13 = 7 AS blank FROM orders), g AS (SELECT * FROM f WHERE NOT blank),
-- Whether the first page says anything: all its lines may be left out at once only for residues that do not meet.
p AS (SELECT *, k % 11 <> 1 AS num, k % 7 <> 2 AS proc, k % 5 <> 3 AS dt, k % 3 <> 1 AS tech, k % 4 <> 1 AS row1, (k % 11 <> 1 OR k % 7 <> 2 OR k % 3 <> 1 OR k % 4 <> 1) AS read1, m < 4 AS read2 FROM g),
-- The second page begins a report where it states another number or procedure than a first page that states one.
s AS (SELECT *, read1 AND CASE m WHEN 0 THEN num WHEN 2 THEN proc ELSE false END AS cut2 FROM p),
t AS (SELECT *, CASE WHEN m = 0 THEN CASE WHEN cut2 OR NOT read1 THEN false ELSE proc END ELSE false END AS cut3 FROM s),
-- r1: the report of the first page (or the first that is read), r2: the one that the second page begins, r3: that of the third.
r AS (SELECT k, file, 1 AS report, (read1 AND num) OR (NOT cut2 AND m < 2) AS num, (read1 AND proc) OR (NOT cut2 AND m = 2) OR (NOT cut2 AND NOT cut3 AND m = 0) AS proc, (read1 AND dt) OR (NOT cut2 AND NOT cut3 AND m < 3) AS dt, read1 AND tech AS tech,
        (read1 AND row1) OR m = 3 OR (NOT cut2 AND NOT cut3 AND m < 3) AS rows, read1 AND k % 9 = 4 AS unread FROM t
      UNION ALL SELECT k, file, 2, m = 0, CASE m WHEN 0 THEN true ELSE true END, true, false, true, false FROM t WHERE cut2
      UNION ALL SELECT k, file, 2, false, true, true, false, true, false FROM t WHERE cut3)
SELECT file, 'page_empty' AS kind, 'critical' AS severity, unnest([1, 2, 3])::INTEGER AS page, NULL::BIGINT AS report, NULL AS what FROM f WHERE blank UNION ALL SELECT file, 'page_empty', 'critical', 2, NULL, NULL FROM g WHERE m = 5
UNION ALL SELECT file, 'page_not_understood', 'critical', 2, NULL, NULL FROM g WHERE m = 4 UNION ALL SELECT file, CASE WHEN dt OR k % 9 = 4 OR k % 8 = 5 THEN 'page_not_understood' ELSE 'page_empty' END, 'critical', 1, NULL, NULL FROM p WHERE NOT read1
UNION ALL SELECT file, 'no_reports', 'critical', NULL, NULL, NULL FROM f WHERE blank UNION ALL SELECT file, 'pages_missing', 'critical', NULL, NULL, '3 of 6' FROM g WHERE k % 8 = 5
UNION ALL SELECT file, 'row_not_read', 'critical', NULL, report, '1 rows' FROM r WHERE unread UNION ALL SELECT file, 'row_not_read', 'critical', NULL, report, 'no rows' FROM r WHERE NOT rows
UNION ALL SELECT file, 'missing_field', 'critical', NULL, report, 'report_number' FROM r WHERE NOT num UNION ALL SELECT file, 'missing_field', 'critical', NULL, report, 'report_date' FROM r WHERE NOT dt
UNION ALL SELECT file, 'missing_field', 'warning', NULL, report, 'procedure_reference' FROM r WHERE NOT proc UNION ALL SELECT file, 'missing_field', 'warning', NULL, report, 'technician_name' FROM r WHERE NOT tech""")
def document_gaps(spark, sf_dir):
    return papers.document_gaps(*document_pages(spark, sf_dir))
