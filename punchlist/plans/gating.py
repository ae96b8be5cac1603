"""Section scores by kind and the criteria of all gates over the shared record views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence, gates, scoring
from .bound import bound, date
from .findings import tables
from .people import _SPEC, _WELDS
from .records import AS_OF, ctes

_KINDS = ("weld", "torque_connection", "torque_wrench", "material_heat", "pressure_test", "certificate", "cp_test_point", "nde_report")

# Complete records of each kind, counted from what the reference asks of each; the lists of missing fields are those of p8 to p11.
_A8 = f"""WITH {_WELDS}, {_SPEC}, {ctes('torque_wrench', 'material_heat', 'pressure_test', 'certificate', 'cp_test_point', 'nde_report', 'document', 'job_book_section')},
cw AS (SELECT * FROM w WHERE status <> 'not_used'),
full_weld AS (SELECT job_book_id, weld_date IS NOT NULL AND joint_type IS NOT NULL AND trim(coalesce(cwi_initials, '')) <> '' AND cwi_visual_result IS NOT NULL
  AND CASE WHEN fac THEN (trim(coalesce(welder_stamp, '')) <> '' OR welder_id IS NOT NULL) AND isometric_number IS NOT NULL AND pipe_size_schedule IS NOT NULL AND pipe_grade IS NOT NULL AND design_pressure_psi IS NOT NULL
    ELSE root_welder_id IS NOT NULL AND hot_welder_id IS NOT NULL AND fill_welder_id IS NOT NULL AND cap_welder_id IS NOT NULL AND component_description IS NOT NULL AND len(heat_numbers) > 0 END
  AND (NOT seen OR (ndt_method IS NOT NULL AND ndt_result IS NOT NULL AND CASE WHEN fac THEN ndt_ticket_number IS NOT NULL ELSE ndt_report_id IS NOT NULL END)) AS ok FROM cw),
uh AS (SELECT DISTINCT job_book_id, trim(h) AS k FROM (SELECT job_book_id, unnest(heat_numbers) AS h FROM cw) WHERE trim(h) <> ''),
pw AS (SELECT DISTINCT job_book_id, unnest([root_welder_id, hot_welder_id, fill_welder_id, cap_welder_id]) AS who, weld_date AS d FROM cw WHERE weld_date IS NOT NULL),
wk AS (SELECT job_book_id, 'welder' AS kind, who, d FROM pw WHERE who IS NOT NULL UNION SELECT job_book_id, 'ndt_technician', technician_id, report_date FROM nde_report WHERE NOT is_superseded AND technician_id IS NOT NULL),
cv AS (SELECT job_book_id, kind, who, bool_and(EXISTS (SELECT 1 FROM certificate c WHERE c.job_book_id = wk.job_book_id AND subject_type = kind AND subject_id = who AND issue_date <= d AND (expiry_date IS NULL OR expiry_date >= d))) AS ok FROM wk GROUP BY ALL),
cd AS (SELECT DISTINCT job_book_id, coalesce(wrench_id_raw, (SELECT wrench_id FROM torque_wrench w WHERE w.id = c.wrench_id)) AS code FROM torque_connection c),
f AS (SELECT job_book_id, 'weld' AS kind, count(*) FILTER (ok) AS done, count(*) AS entered, 0 AS extra FROM full_weld GROUP BY 1
  UNION ALL SELECT job_book_id, 'torque_connection', count(*) FILTER (len(missing) = 0), count(*), 0 FROM spec GROUP BY 1
  UNION ALL SELECT job_book_id, 'equipment', count(*) FILTER (code IN (SELECT wrench_id FROM torque_wrench WHERE cert_on_file)), count(*), 0 FROM cd WHERE code IS NOT NULL GROUP BY 1
  UNION ALL SELECT u.job_book_id, 'material_heat', (SELECT count(*) FROM material_heat m WHERE m.job_book_id = u.job_book_id AND mtr_document_id IS NOT NULL AND mtr_status NOT IN ('illegible', 'unidentified') AND trim(heat_number) IN (SELECT k FROM uh x WHERE x.job_book_id = u.job_book_id)), count(*), 0 FROM uh u GROUP BY 1
  UNION ALL SELECT t.job_book_id, 'pressure_test', count(*) FILTER (test_date IS NOT NULL AND test_pressure_psi IS NOT NULL AND duration_minutes IS NOT NULL AND result IS NOT NULL AND chart_document_id IS NOT NULL AND c.id IS NOT NULL AND coalesce(test_date >= issue_date, true) AND coalesce(test_date <= expiry_date, true)), count(*), 0 FROM pressure_test t LEFT JOIN certificate c ON c.id = recorder_cert_id GROUP BY 1
  UNION ALL SELECT job_book_id, kind, count(*) FILTER (ok), count(*), 0 FROM cv GROUP BY ALL
  UNION ALL SELECT coalesce(a.job_book_id, p.job_book_id), 'cp_test_point', coalesce(p.d, 0), CASE WHEN coalesce(a.n, 0) > 0 THEN a.n ELSE coalesce(p.n, 0) END, 0 FROM (SELECT job_book_id, count(*) FILTER (cp_test_on_flange) AS n FROM torque_connection GROUP BY 1) a FULL JOIN (SELECT job_book_id, count(*) AS n, count(*) FILTER (baseline_potential_v IS NOT NULL AND reading_date IS NOT NULL) AS d FROM cp_test_point GROUP BY 1) p ON p.job_book_id = a.job_book_id
  UNION ALL SELECT coalesce(r.job_book_id, x.job_book_id), 'nde_report', coalesce(r.d, 0) + coalesce(x.l, 0), coalesce(r.n, 0), coalesce(x.n, 0) FROM (SELECT job_book_id, count(*) AS n, count(document_id) AS d FROM nde_report WHERE NOT is_superseded GROUP BY 1) r FULL JOIN (SELECT job_book_id, count(*) AS n, count(ndt_report_id) AS l FROM cw WHERE ndt_method IS NOT NULL GROUP BY 1) x ON x.job_book_id = r.job_book_id),
dn AS (SELECT job_book_id, section_id, count(*) AS n FROM document WHERE NOT is_deleted AND NOT is_superseded GROUP BY ALL),
sc AS (SELECT s.*, coalesce(dn.n, 0) AS docs, coalesce(f.done, 0) AS done, coalesce(f.entered, 0) AS entered, coalesce(f.extra, 0) AS extra FROM job_book_section s LEFT JOIN dn ON dn.section_id = s.id LEFT JOIN f ON f.job_book_id = s.job_book_id AND f.kind = s.scored_by),
a8 AS (SELECT job_book_id, section_number, weight, ingestion_status, CASE WHEN ingestion_status = 'not_imported' OR status = 'na' OR scored_by = 'derived' THEN 0 WHEN scored_by = 'supplemental' THEN CASE WHEN docs > 0 THEN 100 ELSE 0 END WHEN scored_by = 'document' THEN round(least(1, docs / greatest(1, coalesce(expected_count, min_documents))) * 100, 2)
  WHEN greatest(coalesce(expected_count, 0), entered) + extra = 0 THEN 0 ELSE round(least(1, done / (greatest(coalesce(expected_count, 0), entered) + extra)) * 100, 2) END::DOUBLE AS pct, ingestion_status IS NOT DISTINCT FROM 'not_imported' OR (status <> 'na' AND scored_by NOT IN ('supplemental', 'derived')) AS counts FROM sc WHERE scored_by <> 'isometric')"""


def scored(spark, sf_dir):
    t = tables(spark, sf_dir, *_KINDS, "document", "job_book_section")
    documents = t["document"].where("NOT is_deleted AND NOT is_superseded")
    return scoring.scored_sections(t["job_book_section"], scoring.record_facts(t), documents).where("scored_by <> 'isometric'")


@bound("a8_sections_by_kind", f"{_A8} SELECT job_book_id, section_number, pct, counts FROM a8")
def sections_by_kind(spark, sf_dir):
    return scored(spark, sf_dir).select("job_book_id", "section_number", "pct", "counts")


@bound("o6_missing_sections", f"{_A8} SELECT job_book_id, section_number, weight, (row_number() OVER (PARTITION BY job_book_id ORDER BY weight DESC, CASE WHEN section_number LIKE 'S%' THEN 9999 ELSE section_number::INTEGER END))::INTEGER AS place FROM a8 WHERE counts AND pct = 0 AND ingestion_status IS DISTINCT FROM 'not_imported'")
def missing_sections(spark, sf_dir):
    return scoring.missing_sections(scored(spark, sf_dir), ["job_book_id"]).select("job_book_id", "section_number", "weight", "place")


@bound("p14_applicable_sections", f"WITH {ctes('job_book_section', 'job_book')} SELECT s.job_book_id, s.section_number FROM job_book_section s JOIN job_book b ON b.id = s.job_book_id WHERE (title NOT LIKE 'As-Built%' OR book_type = 'facility') AND s.status <> 'na'")
def applicable_sections(spark, sf_dir):
    t = tables(spark, sf_dir, "job_book_section", "job_book")
    template = t["job_book_section"].select("section_number", F.when(F.col("title").startswith("As-Built"), "facility").otherwise("both").alias("applies_to")).distinct()
    return scoring.applicable_sections(t["job_book"], template, t["job_book_section"]).select("job_book_id", "section_number")


_UNSCAFFOLDED = """SELECT b.id AS job_book_id, d.section_number FROM job_book b JOIN section_template d ON d.applies_to IN ('both', b.book_type)
WHERE NOT EXISTS (SELECT 1 FROM job_book_section s WHERE s.job_book_id = b.id AND s.section_number = d.section_number)"""


@bound("j19_unscaffolded_sections", f"WITH {ctes('job_book', 'section_template', 'job_book_section')} {_UNSCAFFOLDED}")
def unscaffolded_sections(spark, sf_dir):
    t = tables(spark, sf_dir, "job_book", "section_template", "job_book_section")
    return scoring.unscaffolded(t["job_book"], t["section_template"], t["job_book_section"])


_GATE_TABLES = ("job_book", "job_book_section", "section_template", "document", "weld", "welder_qualification", "certificate", "torque_connection", "torque_wrench", "nde_report", "pressure_test", "material_heat", "compliance_flag", "coating_inspection")
_ROSTER = "SELECT DISTINCT job_book_id, 'welder' AS kind, welder_id AS subject_id FROM weld WHERE welder_id IS NOT NULL AND weld_date < DATE '1992-09-01' UNION SELECT job_book_id, 'ndt_technician', technician_id FROM nde_report WHERE technician_id IS NOT NULL AND report_date < DATE '1992-06-01' UNION SELECT c.job_book_id, 'torque_wrench', w.id FROM torque_connection c JOIN torque_wrench w ON w.id = c.wrench_id"
_EXPIRY = "CASE WHEN expiry_date IS NOT NULL THEN expiry_date WHEN subject_type = 'torque_wrench' THEN (issue_date + to_months(coalesce((SELECT calibration_interval_months FROM job_book o WHERE o.id = certificate.job_book_id), 12)::INTEGER))::DATE END"



def _planned(milestone: str, default: int) -> str:
    return f"CASE WHEN curve_milestones IS NULL THEN {default} ELSE curve_minimums[list_position(curve_milestones, '{milestone}')] END"


_FACTS = f"""WITH {ctes(*_GATE_TABLES)}, roster AS ({_ROSTER}), ct AS (SELECT *, {_EXPIRY} AS e FROM certificate), b AS (SELECT *, id AS job_book_id, coalesce(construction_start, DATE '{AS_OF}') AS st, coalesce(construction_end, target_turnover_date, DATE '{AS_OF}') AS en, coalesce(construction_end, target_turnover_date) AS window_end FROM job_book),
held AS (SELECT DISTINCT section_id FROM document WHERE NOT is_deleted AND NOT is_superseded),
hv AS (SELECT job_book_id, 'weld' AS t, count(*) AS n FROM weld GROUP BY 1 UNION ALL SELECT job_book_id, 'torque_connection', count(*) FROM torque_connection GROUP BY 1 UNION ALL SELECT job_book_id, 'nde_report', count(*) FROM nde_report GROUP BY 1),
sec AS (SELECT s.job_book_id, count(*) FILTER (s.status = 'na' AND na_reason IS NULL) AS na, count(*) FILTER (section_number IN ('3', '4', '5', '9') AND s.id NOT IN (SELECT section_id FROM held)) AS proc, count(*) FILTER (s.status <> 'na') AS app, count(*) FILTER (s.status <> 'na' AND expected_by IS NULL) AS und,
  count(*) FILTER (s.status <> 'na' AND (ingestion_status IS NULL OR ingestion_status = 'not_imported' OR computed_pct <= 0)) AS absent, count(*) FILTER (s.status <> 'na' AND linked_record_type IN ('weld', 'torque_connection', 'nde_report') AND expected_count > 0 AND coalesce(hv.n, 0) < expected_count) AS short, max(CASE WHEN section_number = '23' THEN CASE WHEN s.status = 'na' THEN 'na' ELSE 'on' END END) AS coat
  FROM job_book_section s LEFT JOIN hv ON hv.job_book_id = s.job_book_id AND hv.t = linked_record_type GROUP BY 1),
ro AS (SELECT r.job_book_id, count(*) FILTER (kind = 'welder') AS welders, count(*) FILTER (kind = 'welder' AND NOT EXISTS (SELECT 1 FROM welder_qualification q WHERE q.welder_id = subject_id AND (expiry_date IS NULL OR expiry_date >= en))) AS unq, count(*) FILTER (kind = 'ndt_technician') AS insp,
  count(*) FILTER (kind = 'ndt_technician' AND NOT EXISTS (SELECT 1 FROM ct WHERE ct.job_book_id = r.job_book_id AND subject_type = kind AND ct.subject_id = r.subject_id AND issue_date <= st AND (e IS NULL OR e >= st))) AS inspbad, count(*) FILTER (kind = 'torque_wrench') AS tools,
  count(*) FILTER (kind = 'torque_wrench' AND NOT (r.subject_id IN (SELECT id FROM torque_wrench WHERE cert_on_file) AND EXISTS (SELECT 1 FROM ct WHERE ct.job_book_id = r.job_book_id AND subject_type = kind AND ct.subject_id = r.subject_id AND issue_date <= st AND (e IS NULL OR e >= st)))) AS toolbad FROM roster r JOIN b USING (job_book_id) GROUP BY 1),
unreg AS (SELECT job_book_id, count(DISTINCT wrench_id) AS n FROM torque_connection WHERE wrench_id NOT IN (SELECT id FROM torque_wrench) GROUP BY 1),
uh AS (SELECT DISTINCT job_book_id, unnest(heat_numbers) AS h FROM weld), onf AS (SELECT DISTINCT job_book_id, heat_number AS h FROM material_heat WHERE mtr_status = 'on_file'),
he AS (SELECT b.job_book_id, (SELECT count(*) FROM uh WHERE uh.job_book_id = b.job_book_id) AS used, (SELECT count(*) FROM uh WHERE uh.job_book_id = b.job_book_id AND h NOT IN (SELECT h FROM onf WHERE onf.job_book_id = b.job_book_id)) AS nomtr, (SELECT count(*) FROM onf WHERE onf.job_book_id = b.job_book_id AND h NOT IN (SELECT h FROM uh WHERE uh.job_book_id = b.job_book_id)) AS orphan, (SELECT count(*) FROM material_heat m WHERE m.job_book_id = b.job_book_id) AS known FROM b),
nd AS (SELECT job_book_id, count(*) AS n, count(*) FILTER (ndt_report_id IS NULL) AS un FROM weld WHERE ndt_method IS NOT NULL GROUP BY 1),
pt AS (SELECT t.job_book_id, count(*) AS n, count(*) FILTER (result_document_id IS NULL OR result IS NULL) AS op, count(*) FILTER (result_document_id IS NULL OR result IS NULL OR start_pressure_psi IS NULL OR end_pressure_psi IS NULL OR duration_minutes IS NULL OR (SELECT count(*) FROM (SELECT unnest([gauge_cert_id, recorder_cert_id, psv_cert_id]) AS x) q JOIN ct ON ct.id = x AND ct.job_book_id = t.job_book_id WHERE issue_date <= test_date AND (e IS NULL OR e >= test_date)) < 3) AS inc FROM pressure_test t WHERE test_date IS NOT NULL GROUP BY 1),
ex AS (SELECT c.job_book_id, count(*) AS n FROM certificate c JOIN b ON b.job_book_id = c.job_book_id WHERE expiry_date >= DATE '{AS_OF}' AND expiry_date < window_end GROUP BY 1),
ms AS (SELECT job_book_id, count(*) AS missing FROM ({_UNSCAFFOLDED}) GROUP BY 1),
ar AS (SELECT job_book_id, count(*) AS areas, count(*) FILTER (a NOT IN (SELECT construction_area FROM coating_inspection k WHERE k.job_book_id = q.job_book_id)) AS uncoated FROM (SELECT job_book_id, unnest(construction_areas) AS a FROM b) q GROUP BY 1),
fl AS (SELECT job_book_id, count(*) AS n, count(*) FILTER (due_at IS NULL OR due_at < DATE '{AS_OF}') AS late FROM compliance_flag WHERE state IN ('open', 'acknowledged') AND severity IN ('critical', 'warning') GROUP BY 1),
ps AS (SELECT DISTINCT job_book_id, id, weld_date AS d, unnest([root_welder_id, hot_welder_id, fill_welder_id, cap_welder_id]) AS who FROM weld WHERE weld_date IS NOT NULL),
bad AS (SELECT job_book_id FROM ps WHERE who IS NOT NULL AND NOT EXISTS (SELECT 1 FROM welder_qualification q WHERE q.welder_id = who AND qualification_date <= d AND (expiry_date IS NULL OR expiry_date >= d))
  UNION ALL SELECT job_book_id FROM torque_connection c WHERE torque_date IS NOT NULL AND wrench_id IS NOT NULL AND NOT (wrench_id IN (SELECT id FROM torque_wrench) AND EXISTS (SELECT 1 FROM ct WHERE ct.job_book_id = c.job_book_id AND subject_type = 'torque_wrench' AND subject_id = wrench_id AND issue_date <= torque_date AND (e IS NULL OR e >= torque_date)))
  UNION ALL SELECT job_book_id FROM nde_report r WHERE technician_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ct WHERE ct.job_book_id = r.job_book_id AND subject_type = 'ndt_technician' AND subject_id = technician_id AND list_contains(ndt_methods, r.method) AND issue_date <= report_date AND (e IS NULL OR e >= report_date))),
bd AS (SELECT job_book_id, count(*) AS n FROM bad GROUP BY 1),
z AS (SELECT b.*, coalesce(sec.na, 0) AS na, coalesce(proc, 0) AS proc, coalesce(app, 0) AS app, coalesce(und, 0) AS und, coalesce(absent, 0) AS absent, coalesce(short, 0) AS short, coat, coalesce(welders, 0) AS welders, coalesce(unq, 0) AS unq, coalesce(insp, 0) AS insp, coalesce(inspbad, 0) AS inspbad, coalesce(tools, 0) AS tools, coalesce(toolbad, 0) AS toolbad, coalesce(unreg.n, 0) AS unreg, used, nomtr, orphan, known,
  coalesce(nd.n, 0) AS exam, coalesce(nd.un, 0) AS unlinked, coalesce(pt.n, 0) AS tested, coalesce(pt.op, 0) AS openp, coalesce(pt.inc, 0) AS inc, coalesce(ex.n, 0) AS expiring, coalesce(fl.n, 0) AS nopen, coalesce(fl.late, 0) AS nlate, coalesce(bd.n, 0) AS nbad, coalesce(areas, 0) AS areas, coalesce(uncoated, 0) AS uncoated, coalesce(missing, 0) AS missing,
  {_planned('construction_25', 25)} AS p1, {_planned('construction_50', 50)} AS p2
  FROM b LEFT JOIN sec USING (job_book_id) LEFT JOIN ro USING (job_book_id) LEFT JOIN unreg USING (job_book_id) LEFT JOIN he USING (job_book_id) LEFT JOIN nd USING (job_book_id) LEFT JOIN pt USING (job_book_id) LEFT JOIN ex USING (job_book_id) LEFT JOIN fl USING (job_book_id) LEFT JOIN bd USING (job_book_id) LEFT JOIN ar USING (job_book_id) LEFT JOIN ms USING (job_book_id))"""


def _yes(condition: str, unknown: str = "false") -> str:
    return f"CASE WHEN {unknown} THEN 'indeterminate' WHEN {condition} THEN 'met' ELSE 'not_met' END"


def _peer(least: int) -> str:
    return f"CASE WHEN peer_score IS NULL THEN 'indeterminate' WHEN coalesce(peer_criticals, 0) > 0 OR peer_score < {least} THEN 'not_met' ELSE 'met' END"


_STATES = {
    "g0.scaffolded": _yes("na = 0 AND missing = 0"), "g0.custodian": "CASE WHEN custodian_id IS NULL OR custodian_competency = 'JB-1' THEN 'not_met' WHEN custodian_competency IS NULL THEN 'indeterminate' ELSE 'met' END", "g0.governing_docs": _yes("has_references AND has_revisions AND governing_docs_confirmed_at IS NOT NULL"),
    "g0.procedures_loaded": _yes("proc = 0"), "g0.wpq": _yes("unq = 0", "welders = 0"), "g0.inspector_creds": _yes("inspbad = 0", "insp = 0"), "g0.wrench_calibration": _yes("toolbad = 0 AND unreg = 0", "tools = 0 AND unreg = 0"), "g0.expected_by": _yes("und = 0 AND app > 0"), "g0.planned_curve": _yes("planned_curve_agreed_at IS NOT NULL"),
    "g1.curve": _yes("completion_pct >= p1", "p1 IS NULL"), "g1.timeliness": _yes("timeliness_pct >= 95", "timeliness_pct IS NULL"), "g1.self_audit": _yes("self_audits >= self_audits_due", "self_audits_due IS NULL"), "g1.peer_audit": _peer(90), "g1.registers": _yes("welders > 0 AND tools > 0 AND known > 0"), "g1.heats": _yes("nomtr = 0", "used = 0"), "g1.ncr": _yes("nopen = 0 OR nlate = 0", "NOT flags_loaded"),
    "g2.curve": "CASE WHEN p2 IS NOT NULL THEN CASE WHEN completion_pct >= p2 THEN 'met' ELSE 'not_met' END END", "g2.iso_stage1": "'indeterminate'", "g2.pressure_closed": _yes("openp = 0", "tested = 0"), "g2.cert_forecast": "CASE WHEN window_end IS NULL OR expiring > 0 THEN 'indeterminate' ELSE 'met' END", "g2.peer_audit": _peer(90),
    "g3.records_entered": _yes("short = 0"), "g3.iso_stages": "'indeterminate'", "g3.nde": _yes("unlinked = 0", "exam = 0"), "g3.pressure": _yes("inc = 0", "tested = 0"), "g3.heats": _yes("nomtr = 0 AND orphan = 0", "used = 0"), "g3.coating": "CASE WHEN coat = 'on' THEN CASE WHEN areas = 0 THEN 'indeterminate' WHEN uncoated = 0 THEN 'met' ELSE 'not_met' END ELSE 'not_applicable' END", "g3.backlog": "'indeterminate'",
    "g4.complete": _yes("completion_pct >= 100"), "g4.presence": _yes("absent = 0"), "g4.certificates": _yes("nbad = 0"), "g4.peer_audit": _peer(95), "g4.tier3": _yes("true", "tier3_verified_at IS NULL"), "g4.findings": _yes("nopen = 0", "NOT flags_loaded"), "g4.export": "'indeterminate'", "g4.completeness_cert": _yes("true", "completeness_certified_at IS NULL"),
    "g5.acceptance": _yes("status = 'accepted'"), "g5.comments": "'indeterminate'", "g5.lessons": "'indeterminate'", "g5.metrics": "'indeterminate'", "g5.retention": "'indeterminate'",
}
_CRITERIA = f"""{_FACTS}, one AS ({' UNION ALL '.join(f"SELECT job_book_id, '{k[:2].upper()}' AS gate, '{k}' AS id, {v} AS state FROM z" for k, v in _STATES.items())}),
crit AS (SELECT * FROM one WHERE state IS NOT NULL UNION ALL SELECT job_book_id, 'G2', 'g2.gate1_sustained', CASE WHEN bool_or(state = 'not_met') THEN 'not_met' WHEN bool_or(state = 'indeterminate') THEN 'indeterminate' ELSE 'met' END FROM one WHERE gate = 'G1' GROUP BY 1)"""


def criteria(spark, sf_dir):
    t = tables(spark, sf_dir, *_GATE_TABLES)
    t["roster"] = spark.sql(_ROSTER.replace("FROM weld ", "FROM {weld} ").replace("FROM nde_report ", "FROM {nde_report} ").replace("FROM torque_connection c JOIN torque_wrench w", "FROM {torque_connection} c JOIN {torque_wrench} w"), **{k: t[k] for k in ("weld", "nde_report", "torque_connection", "torque_wrench")})
    return gates.all_criteria(gates.facts(t, date(AS_OF)))


@bound("g_all_criteria", f"{_CRITERIA} SELECT * FROM crit")
def all_criteria(spark, sf_dir):
    return criteria(spark, sf_dir)


@bound("g_evaluations", f"{_CRITERIA} SELECT job_book_id, gate, count(*) FILTER (state = 'met') AS met, count(*) FILTER (state = 'not_met') AS not_met, count(*) FILTER (state = 'indeterminate') AS indeterminate, count(*) FILTER (state = 'not_applicable') AS not_applicable, count(*) FILTER (state IN ('not_met', 'indeterminate')) = 0 AS would_pass FROM crit GROUP BY ALL")
def evaluations(spark, sf_dir):
    return gates.evaluated(criteria(spark, sf_dir), ["job_book_id"])
