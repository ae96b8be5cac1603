"""The records of job books as views of the given tables, one definition for Spark and for DuckDB.

Nations stand for books, line items for welds, orders for torque connections and reports, customers for wrenches and sections,
parts for heats and pressure tests, documents for documents. Residues of keys leave fields out, so that every verdict occurs.
Definitions keep to what both dialects know; only how an array is written differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bound import read

AS_OF = "1999-01-01"

VIEWS: dict[str, tuple[str, str]] = {
    "job_book": ("nation", """
SELECT CAST(n_nationkey AS STRING) AS id, 'AB' || (100 + n_nationkey) AS job_number, CASE WHEN n_nationkey % 6 <> 5 THEN 'PAD ' || (n_nationkey % 4) END AS drill_pad_name,
  CASE WHEN n_nationkey % 7 <> 3 THEN DATE '1993-01-01' END AS construction_start, CASE WHEN n_nationkey % 7 <> 5 THEN DATE '1997-12-31' END AS construction_end,
  CASE WHEN n_nationkey % 4 = 0 THEN DATE '1998-06-01' END AS data_as_of_date, CASE n_nationkey % 3 WHEN 1 THEN 'flat' WHEN 2 THEN 'tiered' END AS rule_kind, 40.0 AS required_nde_pct, 100.0 AS required_visual_pct,
  33.0 AS required_xray_pct, 10.0 AS torque_tolerance_pct, 60.0 AS required_torque_inspect_pct, 30 AS cert_expiry_warning_days, CASE WHEN n_nationkey % 2 = 0 THEN 1000.0 END AS default_design_pressure_psi,
  CASE n_nationkey % 3 WHEN 0 THEN 'mon_fri' WHEN 1 THEN 'mon_sat' ELSE 'all_days' END AS work_week, CASE WHEN n_nationkey % 5 = 4 THEN 'flowline' ELSE 'facility' END AS book_type, n_regionkey AS region,
  CASE WHEN n_nationkey % 8 <> 1 THEN 'u' || n_nationkey END AS custodian_id, CASE n_nationkey % 5 WHEN 0 THEN 'JB-1' WHEN 1 THEN 'JB-2' WHEN 2 THEN 'JB-3' END AS custodian_competency, n_nationkey % 3 <> 2 AS has_references, n_nationkey % 4 <> 3 AS has_revisions, CASE WHEN n_nationkey % 5 <> 4 THEN DATE '1993-02-01' END AS governing_docs_confirmed_at,
  CASE WHEN n_nationkey % 6 <> 2 THEN DATE '1993-02-01' END AS planned_curve_agreed_at, CASE WHEN n_nationkey % 9 = 4 THEN DATE '1998-12-01' END AS completeness_certified_at, CASE WHEN n_nationkey % 10 = 7 THEN 'accepted' ELSE 'open' END AS status, CAST(n_nationkey * 17 % 120 AS DOUBLE) AS completion_pct,
  CASE WHEN n_nationkey % 7 <> 6 THEN 80.0 + n_nationkey % 20 END AS timeliness_pct, CASE WHEN n_nationkey % 6 <> 4 THEN n_nationkey % 5 END AS self_audits_due, n_nationkey % 4 AS self_audits, CASE WHEN n_nationkey % 5 <> 3 THEN 86.0 + n_nationkey % 12 END AS peer_score, CASE WHEN n_nationkey % 5 <> 3 THEN n_nationkey % 2 END AS peer_criticals, CASE WHEN n_nationkey % 4 = 2 THEN DATE '1998-11-01' END AS tier3_verified_at, n_nationkey % 11 <> 9 AS flags_loaded,
  CASE n_nationkey % 4 WHEN 1 THEN 6 WHEN 2 THEN 24 END AS calibration_interval_months, CASE WHEN n_nationkey % 10 = 5 THEN DATE '1998-03-31' END AS target_turnover_date,
  CASE n_nationkey % 5 WHEN 1 THEN ARRAY('construction_25', 'construction_50', 'submission') WHEN 3 THEN ARRAY('gate_0_passed', 'mechanical_completion') END AS curve_milestones,
  CASE n_nationkey % 5 WHEN 1 THEN ARRAY(5.0, 60.0, 100.0) WHEN 3 THEN ARRAY(1.0, 90.0) END AS curve_minimums,
  CASE n_nationkey % 3 WHEN 0 THEN ARRAY('AREA 1', 'AREA 2') WHEN 1 THEN ARRAY('AREA 3') END AS construction_areas
FROM nation"""),
    "coating_inspection": ("orders", "SELECT CAST(o_custkey % 25 AS STRING) AS job_book_id, 'k' || o_orderkey AS id, 'AREA ' || (o_orderkey % 3 + 1) AS construction_area FROM orders WHERE o_custkey % 25 % 4 <> o_orderkey % 3"),
    "weld": ("lineitem", """
SELECT CAST(l_suppkey % 25 AS STRING) AS job_book_id, 'w' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, CAST(l_orderkey % 400 AS STRING) || '.' || l_linenumber AS weld_number,
  CASE WHEN l_orderkey % 41 = 0 THEN 'not_used' ELSE 'ok' END AS status, CASE WHEN l_orderkey % 37 <> 0 THEN CAST(l_shipdate AS DATE) END AS weld_date,
  CASE WHEN l_linenumber % 2 = 1 AND l_partkey % 9 <> 0 THEN 's' || (l_partkey % 60) END AS welder_id,
  CASE WHEN l_linenumber % 2 = 0 THEN 's' || (l_partkey % 60) END AS root_welder_id, CASE WHEN l_linenumber % 2 = 0 AND l_partkey % 7 <> 0 THEN 's' || (l_suppkey % 60) END AS hot_welder_id,
  CASE WHEN l_linenumber % 4 = 0 THEN 's' || (l_partkey % 60) END AS fill_welder_id, CASE WHEN l_linenumber % 2 = 0 AND l_partkey % 5 <> 0 THEN 's' || (l_orderkey % 60) END AS cap_welder_id,
  CASE WHEN l_linenumber % 2 = 1 AND l_partkey % 18 = 0 THEN 'CREW' WHEN l_linenumber % 2 = 1 AND l_partkey % 27 = 0 THEN '' END AS welder_stamp,
  CASE WHEN l_partkey % 29 = 0 THEN ARRAY('H1', ' ') ELSE ARRAY('H' || (l_partkey % 97), ' H' || (l_suppkey % 31)) END AS heat_numbers,
  CASE WHEN l_returnflag = 'R' THEN 'RT' WHEN l_returnflag = 'A' AND l_linenumber = 2 THEN 'UT' END AS ndt_method, CASE WHEN l_returnflag = 'A' AND l_partkey % 5 = 0 THEN 'X-' || l_partkey WHEN l_returnflag = 'N' AND l_partkey % 5 = 1 THEN ' ' END AS xray_number,
  CASE WHEN l_returnflag <> 'N' AND l_linestatus = 'F' AND l_partkey % 3 <> 0 THEN 'Pass' WHEN l_returnflag = 'R' THEN 'Fail' END AS ndt_result, CASE WHEN l_returnflag = 'R' AND l_partkey % 2 = 0 THEN 'r' || l_orderkey END AS ndt_report_id,
  CASE WHEN l_returnflag = 'R' AND l_partkey % 4 <> 0 THEN 'T-0' || (l_orderkey % 300) END AS ndt_ticket_number,
  CASE WHEN l_linenumber % 2 = 1 AND l_partkey % 8 <> 0 THEN (l_partkey % 9 + 1) || '-GA-' || (100 + l_orderkey % 40) || '-ACM' END AS isometric_number,
  CASE l_partkey % 6 WHEN 0 THEN '2" - SCH. 40, STD' WHEN 1 THEN '6 SCH40,STD' WHEN 2 THEN '8" sch 60' WHEN 3 THEN '10"-SCH.160' WHEN 4 THEN '14" - SCH 20' END AS pipe_size_schedule,
  CASE l_suppkey % 5 WHEN 0 THEN 'Gr. B' WHEN 1 THEN 'grade b' WHEN 2 THEN 'X-42' WHEN 3 THEN 'X52' WHEN 4 THEN CASE WHEN l_partkey % 2 = 0 THEN 'X70' END END AS pipe_grade,
  CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_quantity AS DOUBLE) * 60 END AS design_pressure_psi,
  CASE WHEN l_partkey % 19 <> 0 THEN 'Butt' END AS joint_type, CASE WHEN l_partkey % 23 <> 0 THEN 'QA' ELSE ' ' END AS cwi_initials, CASE l_suppkey % 4 WHEN 0 THEN 'Pass' WHEN 1 THEN 'Fail' WHEN 2 THEN 'Pass' END AS cwi_visual_result,
  CASE WHEN l_partkey % 31 <> 0 THEN 'elbow' END AS component_description, CASE WHEN l_linenumber = 3 THEN 'AREA ' || (l_partkey % 6) END AS construction_area, CASE WHEN l_linenumber % 3 = 0 THEN ' ' || (l_orderkey % 90) END AS pressure_test_ref
FROM lineitem"""),
    "welder": ("supplier", "SELECT DISTINCT 's' || (s_suppkey % 60) AS id, 'S' || (s_suppkey % 60) AS initials, 'Welder ' || (s_suppkey % 60) AS full_name, CASE WHEN s_suppkey % 60 % 10 = 3 THEN 2 ELSE 0 END AS n_combined FROM supplier"),
    "welder_qualification": ("customer", """
SELECT 's' || (c_custkey % 56) AS welder_id, CASE WHEN c_custkey % 11 <> 0 THEN DATE '1992-01-01' + CAST(c_custkey % 1900 AS INT) END AS qualification_date,
  CASE WHEN c_custkey % 13 <> 0 THEN DATE '1992-01-01' + CAST(c_custkey % 1900 + 200 AS INT) END AS expiry_date FROM customer WHERE c_mktsegment <> 'BUILDING'"""),
    "torque_connection": ("orders", """
SELECT CAST(o_custkey % 25 AS STRING) AS job_book_id, 'c' || o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN 't' || o_custkey END AS wrench_id, CASE WHEN o_orderkey % 53 <> 0 AND o_orderkey % 8 <> 1 THEN 'B' || (o_orderkey % 170) END AS wrench_id_raw,
  CASE WHEN o_orderkey % 43 <> 0 THEN CAST(o_orderdate AS DATE) END AS torque_date, CASE WHEN o_custkey % 25 = 24 THEN 30.0 WHEN o_orderkey % 17 <> 0 THEN CAST(20 + o_orderkey % 30 AS DOUBLE) END AS actual_torque_ft_lb,
  CASE WHEN o_custkey % 25 = 24 OR o_orderkey % 6 <> 0 THEN 30.0 END AS required_torque_ft_lb, CASE WHEN o_orderkey % 5 = 2 AND o_custkey % 25 <> 24 THEN 25.0 END AS required_torque_min_ft_lb, CASE WHEN o_orderkey % 5 = 2 AND o_custkey % 25 <> 24 THEN 44.0 END AS required_torque_max_ft_lb,
  CASE WHEN o_custkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS inspection_date, CASE WHEN o_orderkey % 7 = 0 THEN ' ' WHEN o_orderkey % 9 <> 0 THEN 'QC' END AS inspector_initials, CASE WHEN o_orderkey % 29 <> 0 THEN 'EE' END AS employee_initials,
  o_orderkey % 10 = 3 AS cp_test_on_flange, CASE WHEN o_orderkey % 3 = 0 THEN ' ' || (o_custkey % 9 + 1) || '-ga-' || (100 + o_orderkey % 45) || '-acm' END AS iso_number FROM orders"""),
    "torque_wrench": ("customer", """
SELECT 't' || c_custkey AS id, 'B' || c_custkey AS wrench_id, CASE WHEN c_custkey % 13 <> 0 THEN DATE '1993-06-01' + CAST(c_custkey % 1500 AS INT) END AS last_calibration_date, CASE WHEN c_custkey % 13 <> 0 THEN DATE '1993-06-01' + CAST(c_custkey % 1500 + 700 AS INT) END AS calibration_due_date,
  CASE WHEN c_custkey % 4 = 0 THEN DATE '1993-06-02' + CAST(c_custkey % 1500 AS INT) WHEN c_custkey % 4 = 1 THEN DATE '1993-06-01' + CAST(c_custkey % 1500 AS INT) END AS roster_claimed_calibration_date, c_acctbal > 0 AS cert_on_file, c_custkey % 8 <> 1 AS on_roster,
  CASE WHEN c_custkey % 10 = 0 THEN 'fail' ELSE 'pass' END AS calibration_status FROM customer WHERE c_custkey % 3 <> 0"""),
    "nde_report": ("orders", """
SELECT CAST(o_custkey % 25 AS STRING) AS job_book_id, 'r' || o_orderkey AS id, 'RT-' || (o_orderkey % 300) AS report_number, CAST(o_orderdate AS DATE) AS report_date, CASE o_orderkey % 3 WHEN 0 THEN 'RT' WHEN 1 THEN 'UT' ELSE 'MT' END AS method, 'V' || (o_custkey % 2) AS ndt_company,
  CASE WHEN o_orderkey % 12 <> 5 THEN 'n' || (o_custkey % 40) END AS technician_id, 'Tech ' || (o_custkey % 40) AS technician_name, o_orderkey % 14 = 6 AS is_superseded, CASE WHEN o_orderkey % 3 <> 1 THEN 'd' || o_orderkey END AS document_id, CASE WHEN o_orderkey % 9 = 0 THEN 'AB' || (100 + o_custkey % 26) WHEN o_orderkey % 9 = 1 THEN 'Plant' END AS referenced_facility,
  CASE WHEN o_orderkey % 11 = 0 THEN 'pad ' || (o_custkey % 5) END AS referenced_pad, CASE WHEN o_orderkey % 16 = 0 THEN 'critical' WHEN o_orderkey % 16 = 1 THEN 'warning' END AS gap_severity, 'kind' || (o_orderkey % 3) AS gap_kind, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 7 AS INT) END AS gap_page
FROM orders WHERE o_orderstatus <> 'P'"""),
    "nde_report_line": ("lineitem", """
SELECT CAST(l_suppkey % 25 AS STRING) AS job_book_id, 'r' || l_orderkey AS nde_report_id, CASE WHEN l_partkey % 6 <> 0 THEN 'w' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey END AS weld_id, 'NP-0' || (l_orderkey % 400) || '.' || l_linenumber AS weld_number
FROM lineitem WHERE l_returnflag <> 'N' AND l_partkey % 4 <> 1"""),
    "certificate": ("customer", """
SELECT CAST(c_nationkey AS STRING) AS job_book_id, 'x' || c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'ndt_technician' WHEN 1 THEN 'welder' ELSE 'torque_wrench' END AS subject_type, CASE c_custkey % 3 WHEN 0 THEN 'n' || (c_custkey % 38) WHEN 1 THEN 's' || (c_custkey % 60) ELSE 't' || c_custkey END AS subject_id,
  CASE WHEN c_custkey % 2 = 0 THEN 'calibration' ELSE 'card' END AS cert_type, CASE c_custkey % 4 WHEN 0 THEN ARRAY('RT', 'UT') WHEN 1 THEN ARRAY('MT', 'RT') WHEN 2 THEN ARRAY('UT', 'PT') END AS ndt_methods, CASE WHEN c_custkey % 17 <> 0 THEN DATE '1992-06-01' + CAST(c_custkey % 1000 AS INT) END AS issue_date,
  CASE WHEN c_custkey % 19 <> 0 THEN DATE '1994-06-01' + CAST(c_custkey % 1700 AS INT) END AS expiry_date FROM customer"""),
    "material_heat": ("part", """
SELECT CAST(p_partkey % 25 AS STRING) AS job_book_id, 'm' || p_partkey AS id, 'H' || (p_partkey % 120) || CASE WHEN p_partkey >= 3000 THEN '-' || p_partkey ELSE '' END AS heat_number, CASE WHEN p_partkey % 7 <> 0 THEN 'd' || p_partkey END AS mtr_document_id,
  CASE p_partkey % 9 WHEN 0 THEN 'missing' WHEN 1 THEN 'illegible' WHEN 2 THEN 'unidentified' ELSE 'on_file' END AS mtr_status FROM part"""),
    "compliance_flag": ("orders", "SELECT CAST(o_custkey % 25 AS STRING) AS job_book_id, 'f' || o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'acknowledged' ELSE 'closed' END AS state, CASE o_orderkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 2 * 2000 AS INT) END AS due_at FROM orders WHERE o_custkey % 5 <> 1 AND o_orderpriority = '1-URGENT'"),
    "cp_test_point": ("orders", "SELECT CAST(o_custkey % 25 AS STRING) AS job_book_id, 'p' || o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 1 THEN 'c' || (o_orderkey - o_orderkey % 2) END AS torque_connection_id, CASE WHEN o_orderkey % 7 <> 0 THEN 0.9 END AS baseline_potential_v, CASE WHEN o_orderkey % 8 <> 3 THEN CAST(o_orderdate AS DATE) END AS reading_date FROM orders WHERE o_orderkey % 10 IN (2, 3, 5)"),
    "pressure_test": ("part", """
SELECT CAST(p_partkey % 25 AS STRING) AS job_book_id, 'q' || p_partkey AS id, CAST(p_partkey % 90 AS STRING) AS test_identifier, CASE WHEN p_size % 9 <> 0 THEN DATE '1993-06-01' + CAST(p_partkey * 7 % 1800 AS INT) END AS test_date, CASE WHEN p_size % 8 <> 0 THEN p_retailprice END AS test_pressure_psi,
  CASE WHEN p_size % 7 <> 0 THEN 60.0 END AS duration_minutes, CASE WHEN p_size % 10 <> 0 THEN 'Pass' END AS result, 'x' || (p_partkey % 1600) AS recorder_cert_id, 'x' || (p_partkey % 700 + 1) AS gauge_cert_id, CASE WHEN p_size % 4 <> 0 THEN 'x' || (p_partkey % 150 + 1) END AS psv_cert_id,
  CASE WHEN p_size % 3 = 0 THEN 'd' || p_partkey END AS chart_document_id, CASE WHEN p_size % 5 = 0 THEN 'd' || p_partkey END AS result_document_id, CASE WHEN p_size % 6 <> 0 THEN 100.0 END AS start_pressure_psi, CASE WHEN p_size % 11 <> 0 THEN 95.0 + p_size % 10 END AS end_pressure_psi, CASE WHEN p_size % 13 <> 0 THEN 70.0 END AS ambient_temp_f FROM part"""),
    "section_template": ("customer", """
SELECT DISTINCT CASE WHEN c_custkey % 25 = 0 THEN 'S1' ELSE CAST(c_custkey % 25 AS STRING) END AS section_number,
  CASE WHEN c_custkey % 25 IN (20, 21) THEN 'facility' WHEN c_custkey % 25 = 24 THEN 'flowline' ELSE 'both' END AS applies_to FROM customer"""),
    "job_book_section": ("customer", """
SELECT DISTINCT CAST(c_custkey % 25 AS STRING) AS job_book_id, 'b' || (c_custkey % 25) || '.' || (c_custkey % 24) AS id, CASE WHEN c_custkey % 24 = 0 THEN 'S1' ELSE CAST(c_custkey % 24 AS STRING) END AS section_number,
  CASE WHEN c_custkey % 25 * 7 % 11 = c_custkey % 24 % 11 THEN 'na' WHEN c_custkey % 24 % 3 = 0 THEN 'ready_for_review' ELSE 'in_progress' END AS status, CASE WHEN (c_custkey % 25 + c_custkey % 24) % 13 = 2 THEN 'not_imported' WHEN c_custkey % 24 % 2 = 0 THEN 'imported' END AS ingestion_status,
  c_custkey % 24 % 5 <> 1 AS is_required, CAST(CASE WHEN c_custkey % 24 = 0 THEN 0 ELSE c_custkey % 24 % 6 + 1 END AS DOUBLE) AS weight, CASE c_custkey % 24 WHEN 10 THEN 'nde_report' WHEN 12 THEN 'weld' WHEN 14 THEN 'torque_connection' WHEN 19 THEN 'ut_reading' WHEN 23 THEN 'coating_inspection' END AS linked_record_type,
  CASE c_custkey % 24 WHEN 0 THEN 'supplemental' WHEN 6 THEN 'welder' WHEN 8 THEN 'ndt_technician' WHEN 10 THEN 'nde_report' WHEN 11 THEN 'derived' WHEN 12 THEN 'weld' WHEN 13 THEN 'equipment' WHEN 14 THEN 'torque_connection' WHEN 15 THEN 'material_heat' WHEN 17 THEN 'pressure_test' WHEN 18 THEN 'cp_test_point'
  WHEN 21 THEN 'isometric' WHEN 22 THEN 'isometric' ELSE 'document' END AS scored_by, 1 + c_custkey % 24 % 2 AS min_documents, CASE WHEN c_custkey % 24 % 7 <> 3 THEN DATE '1996-01-01' END AS expected_by, CASE WHEN c_custkey % 25 % 4 = 0 OR (c_custkey % 25 + c_custkey % 24) % 3 = 1 THEN 'agreed' END AS na_reason, CAST((c_custkey % 25 * 5 + c_custkey % 24 * 3) % 101 AS DOUBLE) AS computed_pct,
  CASE WHEN c_custkey % 24 IN (20, 21) THEN 'As-Built drawings' ELSE 'Section ' || (c_custkey % 24) END AS title, CASE WHEN c_custkey % 24 % 4 = 1 THEN 40 WHEN c_custkey % 24 % 4 = 2 THEN 3 END AS expected_count FROM customer"""),
    "document": ("documents", """
SELECT CAST(doc_id % 25 AS STRING) AS job_book_id, 'd' || doc_id AS id, 'b' || (doc_id % 25) || '.' || (doc_id % 22) AS section_id, sha256(CAST(length(text) % 211 AS STRING)) AS sha256, doc_id % 31 = 9 AS is_deleted, doc_id % 12 = 4 AS is_superseded, CASE WHEN doc_id % 24 = 3 THEN 'd' || (doc_id + 1) END AS supersedes_document_id,
  doc_id % 5 <> 0 AS is_approved, CASE doc_id % 9 WHEN 0 THEN 'all ' || doc_id || '.ZIP' WHEN 1 THEN 'report ab' || (100 + doc_id % 26) || ' xz' || (100 + doc_id % 4) || '.pdf' WHEN 2 THEN '~$' || doc_id || '.docx' WHEN 3 THEN 'plan IFR ' || doc_id || '.pdf' WHEN 4 THEN (doc_id % 9 + 1) || '-ga-' || (100 + doc_id % 40) || '-acm_Rev 2.pdf' WHEN 5 THEN 'scan' || doc_id || '.pdf'
  ELSE '10-RPT-' || doc_id || '-20240101-R0.pdf' END AS original_filename, CASE WHEN doc_id % 9 IN (1, 6) THEN '10-RPT-' || doc_id || '-20240101-R0.pdf' END AS other_filename, CASE WHEN doc_id % 18 = 14 THEN 'isometric' END AS record_type, CASE WHEN doc_id % 18 = 14 THEN ' ' || (doc_id % 9 + 1) || '-ga-' || (100 + doc_id % 40) || '-acm' END AS record_id FROM documents"""),
}


def duck(name: str) -> str:
    """``name AS (...)`` for a WITH clause in DuckDB."""
    return f"{name} AS ({VIEWS[name][1].replace('ARRAY(', 'list_value(')})"


def ctes(*names: str) -> str:
    return ",\n".join(duck(n) for n in names)


def records(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    out = {}
    for name in names:
        source, sql = VIEWS[name]
        sql = sql.replace("sha256(", "sha2(").replace("% 211 AS STRING))", "% 211 AS STRING), 256)")
        out[name] = spark.sql(sql.replace(f"FROM {source}", "FROM {source}"), source=read(spark, sf_dir, source))
    return out
