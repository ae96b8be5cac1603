"""Predicates, listings, hold sheets, grants and recorded decisions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access, completeness, evidence, gates, rules
from ..sources import readers
from ..sources.shared import fresh_path
from .bound import bound, date, day, read
from .findings import tables
from .records import ctes


@bound("p1_live_documents", f"WITH {ctes('document')} SELECT job_book_id, count(*) AS n FROM document WHERE NOT is_deleted AND NOT coalesce(is_superseded, false) GROUP BY 1")
def live_documents(spark, sf_dir):
    d = tables(spark, sf_dir, "document")["document"].withColumn("deleted_at", F.when(F.col("is_deleted"), date("1998-01-01")))
    return readers.live_documents(d).groupBy("job_book_id").agg(F.count(F.lit(1)).alias("n"))


@bound("p12_single_stamp_welds", f"WITH {ctes('weld')} SELECT id, welder_id IS NOT NULL OR (trim(coalesce(welder_stamp, '')) <> '' AND root_welder_id IS NULL) AS single FROM weld")
def single_stamp_welds(spark, sf_dir):
    """A weld's passes stand for their assignment: welds with passes name their welders there."""
    w = tables(spark, sf_dir, "weld")["weld"]
    return w.select("id", completeness.single_stamp(F.col("welder_id"), F.col("welder_stamp"), F.col("root_welder_id")).alias("single"))


@bound("p16_unexpired_grants", """SELECT c_custkey, person FROM (SELECT c_custkey, c_nationkey % 10 AS person FROM customer WHERE c_acctbal > 5000 UNION
SELECT o_custkey, o_orderkey % 10 FROM orders WHERE o_orderstatus = 'P' AND (o_orderkey % 4 = 0 OR o_orderdate::DATE + 30 > DATE '1995-06-01'))""")
def unexpired_grants(spark, sf_dir):
    """Grants end thirty days after their order, some never; those that have ended show nothing."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    person = lambda df, x: df.select("c_custkey", (F.col(x) % 10).cast("long").alias("person"))
    granted = o.where("o_orderstatus = 'P'").select(
        F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 10).cast("long").alias("person"), F.when(F.col("o_orderkey") % 4 != 0, F.date_add(day("o_orderdate"), 30)).alias("expires_at")
    )
    none = person(c.limit(0), "c_custkey")
    return access.visible(c.select("c_custkey"), "c_custkey", person(c.where("c_acctbal > 5000"), "c_nationkey"), none, access.unexpired(granted, date("1995-06-01")), "person")


_MARKED = f"""WITH {ctes('weld', 'nde_report', 'nde_report_line')}, e AS (SELECT DISTINCT l.job_book_id, l.weld_id FROM nde_report_line l JOIN nde_report r ON r.id = l.nde_report_id AND r.job_book_id = l.job_book_id WHERE l.weld_id IS NOT NULL AND NOT coalesce(is_superseded, false)),
u AS (SELECT w.job_book_id, w.id, w.weld_number FROM weld w LEFT JOIN e ON e.job_book_id = w.job_book_id AND e.weld_id = w.id WHERE w.status <> 'not_used' AND (ndt_method IS NOT NULL OR trim(coalesce(xray_number, '')) <> '') AND e.weld_id IS NULL)"""


@bound("o2_unevidenced_in_order", f"{_MARKED} SELECT job_book_id, id, (row_number() OVER (PARTITION BY job_book_id ORDER BY weld_number::DOUBLE, weld_number, id))::INTEGER AS place FROM u")
def unevidenced_in_order(spark, sf_dir):
    """Welds marked examined without a report, 2 before 10."""
    t = tables(spark, sf_dir, "weld", "nde_report", "nde_report_line")
    return evidence.unevidenced(evidence.marked_welds(t["weld"], t["nde_report"], t["nde_report_line"])).select("job_book_id", "id", "place")


@bound("s6_plain_listing", "SELECT 'lang ' || coalesce(lang, 'none') || '/' || doc_id || '.pdf' AS path, CASE WHEN doc_id % 10 <> 3 THEN n_chars END AS bytes FROM documents WHERE doc_id % 11 <> 5")
def plain_listing(spark, sf_dir):
    """A listing written as text and read: backslashes, blanks around sizes, sizes that are none, lines without one."""
    d, k = read(spark, sf_dir, "documents"), F.col("doc_id")
    name = F.concat(F.when(k % 2 == 0, "C:\\jobs\\root\\").otherwise("/srv/root/"), F.lit("lang "), F.coalesce("lang", F.lit("none")), F.when(k % 2 == 0, "\\").otherwise("/"), k, F.lit(".pdf"))
    size = F.when(k % 10 == 3, "n/a").otherwise(F.concat(F.lit(" "), F.col("n_chars"), F.lit(" ")))
    path = fresh_path(spark, "listing")
    d.select(F.when(k % 11 == 5, name).otherwise(F.concat(name, F.lit("\t"), size)).alias("value")).write.text(path)
    return readers.plain_listing(spark.read.text(path), "root")


@bound("s7_hold_sheet", """SELECT 'PT-' || p_partkey AS test_identifier, CASE WHEN p_partkey % 6 = 0 OR p_partkey % 4 = 1 THEN NULL WHEN p_size < 20 THEN 'dropped' WHEN p_size > 20 THEN 'rose' ELSE 'held' END AS outcome FROM part""")
def hold_sheet(spark, sf_dir):
    """Hold sheets with comments above them, written and read: readings that are missing, blank templates of zeros."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    zero = k % 6 == 0
    start = F.when(zero, "0").otherwise("100")
    end = F.when(zero, "0").when(k % 4 == 1, "").otherwise((F.col("p_size") + 80).cast("string"))
    row = F.concat_ws("\t", F.concat(F.lit("PT-"), k), F.lit("5/1/24"), start, end, F.lit("60"), F.lit("70"))
    path = fresh_path(spark, "hold-sheets")
    p.select(F.when(k % 50 == 0, F.concat(F.lit("# a comment\n"), row)).otherwise(row).alias("value")).write.text(path)
    return readers.hold_sheet(spark, path).select("test_identifier", readers.hold_outcome(F.col("start_pressure_psi"), F.col("end_pressure_psi")).alias("outcome"))


@bound("g7_decision_faults", """SELECT k AS review, unnest(list_filter([CASE WHEN k % 3 = 0 AND k % 4 > 0 AND k % 5 <> 0 THEN 'passed with unmet criteria and no note' END, CASE WHEN k % 3 <> 0 AND k % 7 = 0 THEN 'advanced without a pass' END,
CASE WHEN o_custkey % 9 = k % 9 THEN 'one person approved twice' END, CASE WHEN k % 8 = 0 AND k % 6 > 0 THEN 'certified with open findings' END], lambda x: x IS NOT NULL)) AS fault FROM (SELECT *, o_orderkey AS k FROM orders)""")
def decision_faults(spark, sf_dir):
    k = F.col("o_orderkey")
    reviews = read(spark, sf_dir, "orders").select(
        k.alias("review"), F.when(k % 3 == 0, "pass").when(k % 3 == 1, "conditional").otherwise("fail").alias("outcome"), (k % 4).alias("n_unmet"), F.when(k % 5 == 0, "agreed").alias("override_note"), (k % 7 == 0).alias("advanced"),
        (F.col("o_custkey") % 9).alias("approver_1"), (k % 9).alias("approver_2"), (k % 8 == 0).alias("certified"), (k % 6).alias("open_findings"),
    )
    return reviews.select("review", F.explode(gates.decision_faults(reviews)).alias("fault"))


@bound("r_ready_with_open", f"WITH {ctes('job_book_section', 'compliance_flag')}, n AS (SELECT job_book_id, ((substr(id, 2)::BIGINT % 23) + 1)::VARCHAR AS section, count(*) AS n FROM compliance_flag WHERE severity <> 'info' GROUP BY ALL) SELECT s.job_book_id, s.id AS entity_id, s.section_number AS section FROM job_book_section s JOIN n ON n.job_book_id = s.job_book_id AND n.section = s.section_number WHERE s.status = 'ready_for_review'")
def ready_with_open(spark, sf_dir):
    """Findings of a book, dealt to sections by their number, against sections that are marked ready."""
    t = tables(spark, sf_dir, "job_book_section", "compliance_flag")
    findings = t["compliance_flag"].select("job_book_id", "severity", ((F.substring("id", 2, 20).cast("long") % 23) + 1).cast("string").alias("section"))
    return rules.ready_with_open_findings(t["job_book_section"], findings).select("job_book_id", "entity_id", "section")
