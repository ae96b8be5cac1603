"""Isometrics, test packages, drawing names, file names, audits and entry rules over the shared record views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import naming
from ..operators import audits, evidence, rules, timeliness
from ..sources.shared import written
from .bound import bound, date, read
from .findings import _COUNTABLE, _DRAWINGS, _rows, tables
from .records import AS_OF, ctes


@bound("f19_drawing_names", """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN NULL ELSE (doc_id % 9 + 1) || CASE WHEN doc_id % 2 = 0 THEN '-1/2' ELSE '' END || '-GA-' || (100 + doc_id % 40) || CASE WHEN doc_id % 5 = 0 THEN '-ACMX' ELSE '-ACM' END END AS isometric,
CASE WHEN doc_id % 6 = 3 THEN (doc_id % 4)::VARCHAR END AS revision, CASE WHEN doc_id % 6 = 2 THEN 2 WHEN doc_id % 6 = 4 THEN 1 ELSE 0 END AS checks, doc_id % 6 = 5 AS stamped, doc_id % 6 = 3 AS completed, doc_id % 6 = 1 AS threaded, CASE WHEN doc_id % 6 = 4 THEN 'Miller' END AS signed_by FROM documents""")
def drawing_names(spark, sf_dir):
    k = F.col("doc_id")
    iso = F.concat(k % 9 + 1, F.when(k % 2 == 0, "-1/2").otherwise(""), F.lit("-ga-"), k % 40 + 100, F.when(k % 5 == 0, "-acmx").otherwise("-acm"))
    name = (
        F.when(k % 6 == 0, "overview.pdf").when(k % 6 == 1, F.concat(F.lit("FLG "), iso, F.lit("_Rev "), k % 4, F.lit(" (THRD)..pdf"))).when(k % 6 == 2, F.concat(F.lit("21/"), iso, F.lit(" ✔ ✔.pdf")))
        .when(k % 6 == 3, F.concat(F.lit("area completed/"), iso, F.lit(" rev"), k % 4, F.lit(" - Copy.pdf"))).when(k % 6 == 4, F.concat(iso, F.lit(" ✓ Miller.pdf"))).otherwise(F.concat(F.lit("22/Stamped/"), iso, F.lit("_UPDATED.pdf")))
    )
    d = read(spark, sf_dir, "documents").select("doc_id", name.alias("n"))
    return d.select("doc_id", evidence.isometric_number(F.regexp_replace("n", "^(21|22|area completed|Stamped)/", "")).alias("isometric"), evidence.revision(F.col("n")).alias("revision"), evidence.markup(F.col("n")).alias("m")).select("doc_id", "isometric", "revision", "m.checks", "m.stamped", "m.completed", "m.threaded", "m.signed_by")


def _drawings(spark, sf_dir):
    t = tables(spark, sf_dir, "weld", "torque_connection", "document", "job_book_section")
    sections = t["job_book_section"].where("section_number IN ('21', '22') AND status <> 'na' AND ingestion_status IS DISTINCT FROM 'not_imported'").select("job_book_id", F.col("id").alias("section_id"), F.col("section_number").alias("section"))
    own = evidence.attributed(t["document"].where("NOT is_deleted AND is_approved")).join(sections, ["job_book_id", "section_id"])
    own = own.withColumn("checks", F.when(F.col("sha256") < "8", 2).when(F.col("sha256") < "c", 1).otherwise(0))
    return evidence.drawings_against_logs(t["weld"], t["torque_connection"], own)


_MATCHED = _DRAWINGS.replace("SELECT d.job_book_id, section_number,", "SELECT d.job_book_id, section_number, CASE WHEN sha256 < '8' THEN 2 WHEN sha256 < 'c' THEN 1 ELSE 0 END AS checks,") + """,
both_ AS (SELECT r.job_book_id, s.section, r.iso FROM ref r, (SELECT unnest(['21', '22']) AS section) s UNION SELECT job_book_id, section_number, iso FROM dw WHERE iso IS NOT NULL),
mt AS (SELECT b.*, EXISTS (SELECT 1 FROM ref r WHERE r.job_book_id = b.job_book_id AND r.iso = b.iso AND src = 'w') AS w, EXISTS (SELECT 1 FROM ref r WHERE r.job_book_id = b.job_book_id AND r.iso = b.iso AND src = 't') AS t,
  (SELECT count(*) FROM dw WHERE dw.job_book_id = b.job_book_id AND dw.section_number = b.section AND dw.iso = b.iso) AS n, (SELECT count(*) FROM dw WHERE dw.job_book_id = b.job_book_id AND dw.section_number = b.section AND dw.iso = b.iso AND checks >= CASE b.section WHEN '21' THEN 1 ELSE 2 END) AS m FROM both_ b)"""


@bound("j11_isometric_coverage", f"""WITH {ctes('weld', 'torque_connection', 'document', 'job_book_section')}, {_MATCHED} SELECT job_book_id, section, count(*) FILTER (w OR t) AS referenced, count(*) FILTER (w) AS from_welds, count(*) FILTER (t) AS from_torque, count(*) FILTER ((w OR t) AND n > 0) AS covered, count(*) FILTER ((w OR t) AND n = 0) AS missing,
count(*) FILTER (NOT w AND NOT t) AS extraneous, bool_or(m > 0) AS marks_in_use, CASE WHEN bool_or(m > 0) THEN count(*) FILTER ((w OR t) AND n > 0 AND m = 0) ELSE 0 END AS awaiting_markup, CASE WHEN count(*) FILTER (w OR t) = 0 THEN 0 ELSE round(count(*) FILTER ((w OR t) AND n > 0) / count(*) FILTER (w OR t) * 100, 2) END AS covered_pct FROM mt GROUP BY job_book_id, section""")
def isometric_coverage(spark, sf_dir):
    return evidence.isometric_coverage(_drawings(spark, sf_dir))


@bound("j12_test_coverage", f"""WITH {ctes('weld', 'pressure_test')}, k AS (SELECT DISTINCT job_book_id, trim(pressure_test_ref) AS key, 'a' AS src FROM weld WHERE trim(coalesce(pressure_test_ref, '')) <> '' UNION SELECT job_book_id, trim(test_identifier), 'b' FROM pressure_test UNION SELECT job_book_id, trim(test_identifier), 'c' FROM pressure_test WHERE result_document_id IS NOT NULL)
SELECT job_book_id, key, bool_or(src = 'a') AS in_referenced, bool_or(src = 'b') AS in_disk, bool_or(src = 'c') AS in_result FROM k GROUP BY ALL""")
def test_coverage(spark, sf_dir):
    t = tables(spark, sf_dir, "weld", "pressure_test")
    return evidence.test_coverage(t["weld"], t["pressure_test"]).select("job_book_id", "key", "in_referenced", "in_disk", "in_result")


@bound("f21_conforming_names", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '05-PQR-NOID-valve-list-6.14-NODATE-R0.pdf' WHEN 1 THEN '12-WLG-NOID-' || p_partkey || '-weld-log-NODATE-R0.xlsx' WHEN 2 THEN 'S1-DFR-NOID-a-NODATE-R0.b_new' ELSE '19-22-MRK-NOID-AB100-NODATE-R0.pdf' END AS name,
CASE p_partkey % 4 WHEN 0 THEN 'spaces;status_word;no_section_prefix;unknown_type;date_not_iso;no_revision' WHEN 1 THEN 'spaces;forbidden_character;no_section_prefix;unknown_type;date_not_iso;no_revision' WHEN 2 THEN 'no_section_prefix;unknown_type;date_not_iso;no_revision' ELSE '' END AS issues FROM part""")
def conforming_names(spark, sf_dir):
    k = F.col("p_partkey")
    original = F.when(k % 4 == 0, "Section 5 - valve list FINAL 6.14.2024.PDF").when(k % 4 == 1, F.concat(k, F.lit(" weld & log (20240115).xlsx"))).when(k % 4 == 2, "a.b_new").otherwise("FINAL.pdf")
    section = F.when(k % 4 == 0, "5").when(k % 4 == 1, "12").when(k % 4 == 2, "s1").otherwise("19-22")
    checked = F.when(k % 4 == 0, "valve list FINAL.pdf").when(k % 4 == 1, "weld & log.xlsx").when(k % 4 == 2, "a_b").otherwise("10-RPT-12-x-20240115-R2.pdf")
    return read(spark, sf_dir, "part").select("p_partkey", naming.conforming_name(original, F.upper(section), F.lit("AB100")).alias("name"), F.array_join(naming.name_issues(checked), ";").alias("issues"))


@bound("j22_sample_plans", """SELECT c_custkey, lot, CASE WHEN lot = 0 THEN NULL WHEN lot <= 8 THEN 'A' WHEN lot <= 15 THEN 'B' WHEN lot <= 25 THEN 'C' WHEN lot <= 50 THEN 'D' WHEN lot <= 90 THEN 'E' WHEN lot <= 150 THEN 'F' WHEN lot <= 280 THEN 'G' WHEN lot <= 500 THEN 'H' WHEN lot <= 1200 THEN 'J' WHEN lot <= 3200 THEN 'K' WHEN lot <= 10000 THEN 'L' WHEN lot <= 35000 THEN 'M' WHEN lot <= 150000 THEN 'N' WHEN lot <= 500000 THEN 'P' ELSE 'Q' END AS letter,
least(lot, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END * CASE WHEN lot = 0 THEN 0 WHEN lot <= 8 THEN 2 WHEN lot <= 15 THEN 3 WHEN lot <= 25 THEN 5 WHEN lot <= 50 THEN 8 WHEN lot <= 90 THEN 13 WHEN lot <= 150 THEN 20 WHEN lot <= 280 THEN 32 WHEN lot <= 500 THEN 50 WHEN lot <= 1200 THEN 80 WHEN lot <= 3200 THEN 125 WHEN lot <= 10000 THEN 200 WHEN lot <= 35000 THEN 315 WHEN lot <= 150000 THEN 500 WHEN lot <= 500000 THEN 800 ELSE 1250 END)::BIGINT AS size
FROM (SELECT c_custkey, (c_custkey * c_custkey * c_custkey % 600011 // (c_custkey % 7 * 300 + 1))::BIGINT AS lot FROM customer)""")
def sample_plans(spark, sf_dir):
    k = F.col("c_custkey")
    lot = F.floor(k * k * k % 600011 / (k % 7 * 300 + 1))
    return read(spark, sf_dir, "customer").select("c_custkey", lot.alias("lot")).select("c_custkey", "lot", audits.sample_plan(F.col("lot"), F.col("c_custkey") % 2 == 0).alias("p")).select("c_custkey", "lot", "p.letter", "p.size")


@bound("a16_auditable_lots", f"WITH {ctes('weld', 'torque_connection', 'document', 'pressure_test', 'nde_report', 'material_heat', 'certificate')} SELECT job_book_id, count(*) AS lot FROM (SELECT job_book_id FROM weld UNION ALL SELECT job_book_id FROM torque_connection UNION ALL SELECT job_book_id FROM document WHERE NOT is_deleted AND NOT is_superseded UNION ALL SELECT job_book_id FROM pressure_test UNION ALL SELECT job_book_id FROM nde_report UNION ALL SELECT job_book_id FROM material_heat UNION ALL SELECT job_book_id FROM certificate) GROUP BY job_book_id")
def auditable_lots(spark, sf_dir):
    t = tables(spark, sf_dir, "weld", "torque_connection", "document", "pressure_test", "nde_report", "material_heat", "certificate")
    t["document"] = t["document"].where("NOT is_deleted AND NOT is_superseded")
    return audits.lot_sizes([t[n].select("job_book_id") for n in ("weld", "torque_connection", "document", "pressure_test", "nde_report", "material_heat", "certificate")])


_AUDITS = "au AS (SELECT o_orderkey AS id, o_custkey % 40 AS b, CASE o_orderkey % 3 WHEN 0 THEN 'tier_1_self' WHEN 1 THEN 'tier_2_peer' ELSE 'tier_3_manager' END AS tier, o_totalprice AS score, o_orderstatus, o_orderkey % 4 = 0 AS dbl, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS done_at FROM orders), dn AS (SELECT * FROM au WHERE o_orderstatus <> 'P' AND done_at IS NOT NULL)"


@bound("a16_audit_summaries", f"""WITH {_AUDITS}, pr AS (SELECT * FROM dn WHERE tier = 'tier_2_peer' QUALIFY row_number() OVER (PARTITION BY b ORDER BY done_at DESC, id DESC) = 1)
SELECT d.b AS job_book_id, count(*) FILTER (d.tier = 'tier_1_self') AS self_audits, count(*) FILTER (d.tier = 'tier_2_peer') AS peer_audits, any_value(pr.score) AS peer_score, any_value(CASE WHEN pr.id IS NOT NULL THEN (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = pr.id AND l_returnflag = 'R') END) AS peer_criticals, coalesce(any_value(pr.dbl), false) AS peer_doubled, max(d.done_at) FILTER (d.tier = 'tier_3_manager') AS verified_at FROM dn d LEFT JOIN pr ON pr.b = d.b GROUP BY d.b""")
def audit_summaries(spark, sf_dir):
    k = F.col("o_orderkey")
    a = read(spark, sf_dir, "orders").select(k.alias("id"), (F.col("o_custkey") % 40).alias("job_book_id"), F.when(k % 3 == 0, "tier_1_self").when(k % 3 == 1, "tier_2_peer").otherwise("tier_3_manager").alias("tier"), F.col("o_totalprice").alias("score"), F.when(F.col("o_orderstatus") == "P", "in_progress").otherwise("done").alias("outcome"), (k % 4 == 0).alias("double_sample"), F.when(k % 11 != 0, F.col("o_orderdate")).alias("completed_at"))
    f = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("audit_id"), F.when(F.col("l_returnflag") == "R", "critical").otherwise("minor").alias("classification"))
    return audits.audit_summary(a, f)


@bound("p26_peer_auditors", "SELECT c_custkey, CASE WHEN c_custkey % 5 = c_nationkey % 5 THEN 'custodian of the book' WHEN coalesce(c_mktsegment NOT IN ('BUILDING', 'MACHINERY'), true) THEN 'competency below JB-3' END AS refused FROM customer")
def peer_auditors(spark, sf_dir):
    level = F.when(F.col("c_mktsegment") == "BUILDING", "JB-3").when(F.col("c_mktsegment") == "MACHINERY", "JB-4").when(F.col("c_mktsegment") == "FURNITURE", "JB-2")
    return audits.may_audit(read(spark, sf_dir, "customer"), F.col("c_nationkey") % 5, F.col("c_custkey") % 5, level).select("c_custkey", "refused")


def assessed(spark, sf_dir) -> DataFrame:
    """Entries of two kinds of records, judged by their book's work week."""
    w = tables(spark, sf_dir, "torque_connection", "nde_report", "job_book")
    weeks = w["job_book"].select(F.col("id").alias("job_book_id"), "work_week")
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    kinds = [("torque", "14", w["torque_connection"].select("job_book_id", "id", F.col("torque_date").alias("work"))), ("nde", "10", w["nde_report"].select("job_book_id", "id", F.col("report_date").alias("work")))]
    rows = reduce(DataFrame.unionByName, [df.select("job_book_id", F.lit(k).alias("standard_id"), F.lit(sec).alias("section_number"), F.col("id").alias("record_id"), "work", F.when(number % 9 != 0, F.date_add("work", (number % 6 - F.when(number % 31 == 0, 8).otherwise(0)).cast("int"))).alias("entered_on"), F.when(number % 13 == 0, "bulk_import").otherwise("field_entry").alias("source")) for k, sec, df in kinds])
    rows = rows.join(weeks, "job_book_id")
    one = lambda week: timeliness.assessed(rows.where(F.col("work_week") == week), F.col("work"), F.col("entered_on"), F.col("source"), F.when(F.col("standard_id") == "nde", 2).otherwise(1), week)
    return reduce(DataFrame.unionByName, [one(week) for week in ("mon_fri", "mon_sat", "all_days")])


# Days of each work week counted on a calendar that is written out, so that nothing is shared with the arithmetic under test.
_ENTRIES = f"""{ctes('torque_connection', 'nde_report', 'job_book')}, cal AS (SELECT d::DATE AS d, wk, sum((isodow(d) <= n)::INTEGER) OVER (PARTITION BY wk ORDER BY d) AS i, isodow(d) <= n AS works FROM generate_series(DATE '1990-01-01', DATE '2005-12-31', INTERVAL 1 DAY) t(d), (VALUES ('mon_fri', 5), ('mon_sat', 6), ('all_days', 7)) v(wk, n)),
nx AS (SELECT wk, i, d FROM cal WHERE works), rw AS (SELECT job_book_id, 'torque' AS std, '14' AS sec, id, torque_date AS work, 1 AS n FROM torque_connection UNION ALL SELECT job_book_id, 'nde', '10', id, report_date, 2 FROM nde_report),
en AS (SELECT rw.*, substr(rw.id, 2)::BIGINT AS k, b.work_week FROM rw JOIN job_book b ON b.id = job_book_id), eo AS (SELECT *, CASE WHEN k % 9 <> 0 THEN work + (k % 6 - CASE WHEN k % 31 = 0 THEN 8 ELSE 0 END)::INTEGER END AS entered FROM en),
du AS (SELECT eo.*, x.d AS due FROM eo LEFT JOIN cal c ON c.d = work AND c.wk = work_week LEFT JOIN nx x ON x.wk = work_week AND x.i = c.i + n),
vd AS (SELECT *, CASE WHEN k % 13 = 0 OR entered IS NULL OR work IS NULL THEN 'unmeasurable' WHEN entered < work THEN 'entered_before_work' WHEN entered <= due THEN 'on_time' ELSE 'late' END AS verdict FROM du),
rt AS (SELECT job_book_id, count(*) FILTER (verdict = 'on_time') AS o, count(*) FILTER (verdict = 'late') AS l FROM vd GROUP BY 1),
wkr AS (SELECT job_book_id, date_trunc('week', entered) AS wkd, count(*) FILTER (verdict = 'on_time') / count(*) FILTER (verdict IN ('on_time', 'late')) * 100 AS r FROM vd WHERE entered IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (verdict IN ('on_time', 'late')) > 0),
esc AS (SELECT DISTINCT job_book_id FROM (SELECT *, lag(r) OVER (PARTITION BY job_book_id ORDER BY wkd) AS p FROM wkr) WHERE round(r, 2) < 90 AND round(p, 2) < 90)"""

bound("r_timeliness", f"WITH {_ENTRIES}\n" + "\nUNION ALL ".join([
    _rows("timeliness.late_entry", "info", "entry", "id", "(sec)", "std || '|' || id", "vd WHERE verdict = 'late'"),
    _rows("timeliness.entered_before_work", "critical", "entry", "id", "(sec)", "std || '|' || id", "vd WHERE verdict = 'entered_before_work'"),
    _rows("timeliness.below_target", "(CASE WHEN job_book_id IN (SELECT job_book_id FROM esc) THEN 'warning' ELSE 'info' END)", "job_book", "NULL", "12", "", "rt WHERE o / (o + l) * 100 < 95"),
]))(lambda spark, sf_dir: rules.findings({"assessed_entry": written(spark, assessed(spark, sf_dir), "assessed")}, rules.Settings(AS_OF)).select("job_book_id", "rule_id", "severity", "entity_type", "entity_id", "section", "fingerprint"))
