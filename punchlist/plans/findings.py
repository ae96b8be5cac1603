"""The rules of whole books over the shared record views; SQL tells each rule from its wording, not from the code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules
from .bound import bound
from .records import AS_OF, ctes, records

BANDS = (("visual", 0.0, 0.2, 0.0), ("visual and examination", 0.2, None, 0.15))


def tables(spark, sf_dir, *names: str) -> dict[str, DataFrame]:
    t = records(spark, sf_dir, *names)
    if "document" in t:
        t["document"] = t["document"].withColumn("normalized_filename", F.coalesce("other_filename", "original_filename"))
    if "nde_report" in t:
        gaps = t["nde_report"].where("gap_severity IS NOT NULL")
        t["nde_report_gap"] = gaps.select("job_book_id", F.col("id").alias("nde_report_id"), F.col("gap_severity").alias("severity"), F.col("gap_kind").alias("kind"), F.col("gap_page").alias("page"))
    return t


def found(spark, sf_dir, ids: tuple[str, ...], *names: str) -> DataFrame:
    """The findings of the rules that start with one of ``ids``, each with its fingerprint."""
    chosen = [r for r in rules.RULES if any(i.startswith(ids) for i in r.ids)]
    out = rules.findings(tables(spark, sf_dir, *names), rules.Settings(AS_OF, BANDS), chosen)
    return out.where(" OR ".join(f"rule_id LIKE '{i}%'" for i in ids)).select("job_book_id", "rule_id", "severity", "entity_type", "entity_id", "section", "fingerprint")


def _rows(id: str, severity: str, kind: str, entity: str, section: str, parts: str, source: str) -> str:
    quoted = f"'{id}'" if not id.startswith("(") else id
    level = f"'{severity}'" if not severity.startswith("(") else severity
    place = section if section.startswith("(") or section == "NULL" else f"'{section}'"
    tail = f" || '|' || {parts}" if parts else ""
    return f"SELECT job_book_id, {quoted} AS rule_id, {level} AS severity, '{kind}' AS entity_type, {entity} AS entity_id, {place} AS section, {quoted}{tail} AS fingerprint FROM {source}"


def _family(name: str, ids: tuple[str, ...], needs: tuple[str, ...], helpers: str, rows: list[str]) -> None:
    sql = f"WITH {ctes(*needs)}{(', ' + helpers) if helpers else ''}\n" + "\nUNION ALL ".join(rows)
    bound(name, sql)(lambda spark, sf_dir: found(spark, sf_dir, ids, *needs))


# Sections that were never imported keep their rules silent.
def _read(number: str) -> str:
    return f"job_book_id NOT IN (SELECT job_book_id FROM job_book_section WHERE section_number = '{number}' AND ingestion_status = 'not_imported')"


_COUNTABLE = "cw AS (SELECT * FROM weld WHERE status IS DISTINCT FROM 'not_used')"
_CREDIT = f"""{_COUNTABLE}, cr AS (SELECT DISTINCT job_book_id, id, weld_date, unnest(CASE WHEN welder_id IS NOT NULL THEN [welder_id] ELSE [root_welder_id, hot_welder_id, fill_welder_id, cap_welder_id] END) AS who FROM cw),
credit AS (SELECT * FROM cr WHERE who IS NOT NULL)"""
_SEEN = "(ndt_method IS NOT NULL OR trim(coalesce(xray_number, '')) <> '')"

_family("r_qualifications", ("welder.not_qualified", "welder.qualification"), ("weld", "welder_qualification"), f"""{_CREDIT},
j AS (SELECT c.*, q.welder_id IS NOT NULL AS there, q.qualification_date AS s, q.expiry_date AS e FROM credit c LEFT JOIN welder_qualification q ON q.welder_id = c.who WHERE c.weld_date IS NOT NULL),
v AS (SELECT job_book_id, id, who, CASE WHEN NOT bool_or(there) THEN 'no_record' WHEN bool_or(s IS NOT NULL AND weld_date >= s AND (e IS NULL OR weld_date <= e)) THEN 'qualified'
  WHEN bool_and(coalesce(e < weld_date, false)) THEN 'expired' WHEN bool_or(s IS NULL) THEN 'unverifiable' WHEN bool_or(s > weld_date) THEN 'not_yet' ELSE 'expired' END AS verdict FROM j GROUP BY ALL)""", [
    _rows("welder.qualification_currency_unverifiable", "warning", "weld", "id", "6", "id || '|' || who", "v WHERE verdict = 'unverifiable'"),
    _rows("welder.not_qualified_on_weld_date", "critical", "weld", "id", "6", "id || '|' || who", "v WHERE verdict IN ('no_record', 'expired', 'not_yet')"),
])

_family("r_welders", ("weld.no_welder_stamp", "welder.combined", "welder.below"), ("weld", "welder", "job_book"), f"""{_CREDIT},
roll AS (SELECT c.job_book_id, who, count(*) AS n, count(*) FILTER (WHERE {_SEEN}) AS x FROM credit c JOIN cw USING (job_book_id, id) GROUP BY ALL),
low AS (SELECT roll.*, rule_kind, x / n * 100 AS pct, required_nde_pct AS nde, required_xray_pct AS xray FROM roll JOIN job_book b ON b.id = job_book_id)""", [
    _rows("weld.no_welder_stamp", "critical", "weld", "id", "12", "id", "cw WHERE welder_id IS NULL AND root_welder_id IS NULL AND hot_welder_id IS NULL AND fill_welder_id IS NULL AND cap_welder_id IS NULL AND coalesce(welder_stamp, '') = ''"),
    _rows("welder.combined_stamp", "info", "welder", "welder_id", "12", "welder_id", "(SELECT DISTINCT cw.job_book_id, cw.welder_id FROM cw JOIN welder w ON w.id = cw.welder_id WHERE w.n_combined > 0)"),
    _rows("welder.below_xray_minimum", "critical", "welder", "who", "11", "who", "low WHERE rule_kind IS NULL AND pct < xray"),
    _rows("welder.below_job_nde_requirement", "critical", "welder", "who", "12", "who", "low WHERE rule_kind = 'flat' AND pct < nde"),
])

# Yield strength and dimensions of the sizes that the view writes, by any spelling.
_STRESS = f"""{_COUNTABLE}, k AS (SELECT cw.*, b.rule_kind, coalesce(design_pressure_psi, default_design_pressure_psi) AS p, regexp_replace(upper(pipe_size_schedule), '[^A-Z0-9/]', '', 'g') AS size_key, regexp_replace(upper(pipe_grade), '[^A-Z0-9]', '', 'g') AS grade_key FROM cw JOIN job_book b ON b.id = job_book_id),
dim(size_key, od, wall) AS (VALUES ('2SCH40STD', 2.375, 0.154), ('6SCH40STD', 6.625, 0.28), ('8SCH60', 8.625, 0.406), ('10SCH160', 10.75, 1.125)),
st AS (SELECT k.*, od, wall, CASE WHEN grade_key IN ('GRB', 'GRADEB', 'B') THEN 35000 WHEN grade_key = 'X42' THEN 42000 WHEN grade_key = 'X52' THEN 52000 END AS smys FROM k LEFT JOIN dim USING (size_key)),
sm AS (SELECT *, p * od / (2 * wall) / smys AS share FROM st)"""

_family("r_stress", ("weld.tier", "weld.smys"), ("weld", "job_book"), _STRESS, [
    _rows("weld.tier_not_met", "critical", "weld", "id", "12", "id", "sm WHERE coalesce(rule_kind, 'tiered') = 'tiered' AND share >= 0.2 AND ndt_method IS NULL"),
    _rows("weld.smys_uncomputable", "critical", "weld", "id", "12", "id", "sm WHERE share IS NULL AND NOT (coalesce(pipe_size_schedule, '') = '' AND coalesce(pipe_grade, '') = '' AND design_pressure_psi IS NULL)"),
])


@bound("f11_hoop_stress", f"WITH {ctes('weld', 'job_book')}, {_STRESS} SELECT id, od AS od_in, wall AS wall_in, round(CASE WHEN smys IS NOT NULL THEN p * od / (2 * wall) END, 4) AS hoop_stress_psi, round(share, 8) AS pct_smys, CASE WHEN share < 0.2 THEN 'visual' WHEN share >= 0.2 THEN 'visual and examination' END AS tier, coalesce(share >= 0.2, false) AS owes, "
       "CASE WHEN od IS NULL THEN CASE WHEN pipe_size_schedule IS NULL THEN 'No pipe size or schedule recorded' ELSE 'No NPS dimension for \"' || pipe_size_schedule || '\"' END WHEN smys IS NULL THEN CASE WHEN pipe_grade IS NULL THEN 'No pipe grade recorded' ELSE 'Unknown pipe grade \"' || pipe_grade || '\"' END WHEN p IS NULL THEN 'No design pressure recorded' END AS reason FROM sm")
def hoop_stress(spark, sf_dir):
    from ..functions import engineering

    t = tables(spark, sf_dir, "weld", "job_book")
    w = t["weld"].where("status IS DISTINCT FROM 'not_used'").join(t["job_book"].select(F.col("id").alias("job_book_id"), "default_design_pressure_psi"), "job_book_id")
    out = engineering.with_stress(w, "pipe_size_schedule", "pipe_grade", F.coalesce("design_pressure_psi", "default_design_pressure_psi"), list(BANDS))
    return out.select("id", "od_in", "wall_in", F.round("hoop_stress_psi", 4).alias("hoop_stress_psi"), F.round("pct_smys", 8).alias("pct_smys"), "tier", engineering.requires_examination(F.col("required_fraction")).alias("owes"), F.col("uncomputable_reason").alias("reason"))


_CAL = """t AS (SELECT c.*, a.id AS ia, a.last_calibration_date AS sa, a.calibration_due_date AS ea, a.cert_on_file AS fa, r.id AS ir, r.last_calibration_date AS sr, r.calibration_due_date AS er, r.cert_on_file AS fr
  FROM torque_connection c LEFT JOIN torque_wrench a ON a.id = c.wrench_id LEFT JOIN torque_wrench r ON r.wrench_id = c.wrench_id_raw),
u AS (SELECT *, coalesce(ia, ir) AS w, CASE WHEN ia IS NOT NULL THEN sa ELSE sr END AS s, CASE WHEN ia IS NOT NULL THEN ea ELSE er END AS e, CASE WHEN ia IS NOT NULL THEN fa ELSE fr END AS f FROM t),
cal AS (SELECT *, CASE WHEN wrench_id IS NULL AND wrench_id_raw IS NULL THEN 'no_wrench_recorded' WHEN w IS NULL THEN 'unknown_wrench' WHEN NOT f THEN 'no_certificate' WHEN s IS NULL OR torque_date IS NULL THEN 'silent' WHEN torque_date < s THEN 'not_yet_issued' WHEN torque_date > e THEN 'expired' ELSE 'valid' END AS verdict FROM u),
used AS (SELECT DISTINCT c.job_book_id, w.* FROM torque_connection c JOIN torque_wrench w ON w.id = c.wrench_id OR w.wrench_id = c.wrench_id_raw),
codes AS (SELECT DISTINCT job_book_id, coalesce(wrench_id_raw, (SELECT wrench_id FROM torque_wrench w WHERE w.id = c.wrench_id)) AS code FROM torque_connection c),
ct AS (SELECT c.*, CASE WHEN actual_torque_ft_lb IS NULL THEN NULL WHEN coalesce(required_torque_max_ft_lb, required_torque_ft_lb) IS NULL OR coalesce(required_torque_min_ft_lb, required_torque_ft_lb) IS NULL THEN NULL
  WHEN coalesce(required_torque_max_ft_lb, required_torque_ft_lb) > coalesce(required_torque_min_ft_lb, required_torque_ft_lb) THEN actual_torque_ft_lb BETWEEN required_torque_min_ft_lb AND required_torque_max_ft_lb
  ELSE abs(actual_torque_ft_lb - required_torque_ft_lb) / required_torque_ft_lb * 100 <= torque_tolerance_pct END AS ok FROM torque_connection c JOIN job_book b ON b.id = c.job_book_id),
lg AS (SELECT job_book_id, count(*) AS n, count(*) FILTER (WHERE inspection_date IS NOT NULL AND trim(coalesce(inspector_initials, '')) <> '') AS i, count(*) FILTER (WHERE required_torque_ft_lb IS NOT NULL AND actual_torque_ft_lb IS NOT NULL) AS m,
  count(*) FILTER (WHERE required_torque_ft_lb = actual_torque_ft_lb) AS x FROM torque_connection GROUP BY job_book_id)"""

_family("r_torque_findings", ("torque.",), ("torque_connection", "torque_wrench", "job_book"), _CAL, [
    _rows("('torque.wrench_' || verdict)", "critical", "torque_connection", "id", "13", "id || '|' || coalesce(wrench_id_raw, 'unrecorded')", "cal WHERE verdict NOT IN ('silent', 'valid')"),
    _rows("torque.roster_contradicts_certificate", "warning", "torque_wrench", "id", "13", "id || '|' || roster_claimed_calibration_date || '|' || last_calibration_date", "used WHERE roster_claimed_calibration_date <> last_calibration_date"),
    _rows("torque.certificate_unread", "info", "torque_wrench", "id", "13", "id", "used WHERE cert_on_file AND last_calibration_date IS NULL"),
    _rows("torque.wrench_failed_calibration", "critical", "torque_wrench", "id", "13", "id", "used WHERE calibration_status = 'fail'"),
    _rows("torque.wrench_not_on_roster", "critical", "torque_wrench", "NULL", "13", "code", "codes WHERE code IS NOT NULL AND code NOT IN (SELECT wrench_id FROM torque_wrench WHERE on_roster)"),
    _rows("torque.out_of_tolerance", "warning", "torque_connection", "id", "14", "id", "ct WHERE NOT ok"),
    _rows("torque.inspection_below_minimum", "warning", "job_book", "NULL", "14", "", "lg JOIN job_book b ON b.id = job_book_id WHERE i / n * 100 < required_torque_inspect_pct"),
    _rows("torque.implausibly_exact", "warning", "job_book", "NULL", "14", "", "lg WHERE m >= 25 AND x = m"),
])

_EVIDENCE = f"""{_COUNTABLE}, lv AS (SELECT * FROM nde_report WHERE NOT is_superseded), ev AS (SELECT DISTINCT l.job_book_id, l.weld_id FROM nde_report_line l JOIN lv ON lv.id = l.nde_report_id AND lv.job_book_id = l.job_book_id WHERE weld_id IS NOT NULL),
mk AS (SELECT cw.*, {_SEEN} AS x, EXISTS (SELECT 1 FROM ev WHERE ev.job_book_id = cw.job_book_id AND ev.weld_id = cw.id) AS e FROM cw),
cov AS (SELECT job_book_id, count(*) AS n, count(*) FILTER (WHERE x) AS examined, count(*) FILTER (WHERE e) AS evidenced, count(*) FILTER (WHERE x AND NOT e) AS gap, count(*) FILTER (WHERE e AND NOT x) AS unlogged, CASE WHEN any_value(b.rule_kind) = 'flat' THEN ceil(count(*) * any_value(b.required_nde_pct) / 100) END AS required FROM mk JOIN job_book b ON b.id = job_book_id GROUP BY job_book_id)"""

_family("r_examinations", ("nde.examined", "weld.nde", "nde.import", "nde.technician_unknown", "nde.same", "nde.outside", "document.wrong_job"), ("weld", "nde_report", "nde_report_line", "job_book", "job_book_section"), _EVIDENCE, [
    _rows("nde.examined_not_evidenced", "(CASE WHEN evidenced < required THEN 'critical' ELSE 'warning' END)", "job_book", "job_book_id", "10", "job_book_id", f"cov WHERE gap > 0 AND {_read('10')}"),
    _rows("weld.nde_without_report", "warning", "weld", "id", "10", "id", f"cw WHERE ndt_method IS NOT NULL AND ndt_report_id IS NULL AND {_read('10')} AND {_read('12')}"),
    _rows("nde.import_gap", "critical", "nde_report", "id", "10", "id || ':' || gap_kind || ':' || CASE WHEN gap_page > 0 THEN gap_page::VARCHAR ELSE '' END", "lv WHERE gap_severity = 'critical'"),
    _rows("nde.technician_unknown", "critical", "nde_report", "id", "8", "id", "lv WHERE technician_id IS NULL"),
    _rows("nde.same_day_reports_unresolved", "warning", "nde_report", "min(id)", "10", "report_date || '|' || method || '|' || ndt_company", "lv GROUP BY job_book_id, report_date, method, ndt_company HAVING count(*) > 1"),
    _rows("nde.outside_construction_window", "warning", "nde_report", "r.id", "10", "r.id", "nde_report r JOIN job_book b ON b.id = job_book_id WHERE report_date < construction_start OR report_date > construction_end"),
    _rows("document.wrong_job", "critical", "nde_report", "r.id", "10", "r.id", "nde_report r JOIN job_book b ON b.id = job_book_id WHERE upper(referenced_pad) <> drill_pad_name OR (upper(referenced_facility) <> job_number AND regexp_matches(upper(referenced_facility), '^[A-Z][A-Z][0-9][0-9][0-9]$'))"),
])


@bound("j10_examination_coverage", f"WITH {ctes('weld', 'nde_report', 'nde_report_line', 'job_book')}, {_EVIDENCE} SELECT job_book_id, n AS countable, examined, evidenced, gap AS unevidenced, unlogged, required::BIGINT AS required, round(examined / n * 100, 2) AS examined_pct, round(evidenced / n * 100, 2) AS evidenced_pct, examined >= required AS meets_on_examined, evidenced >= required AS meets_on_evidenced FROM cov")
def examination_coverage(spark, sf_dir):
    from ..operators import evidence

    t = tables(spark, sf_dir, "weld", "nde_report", "nde_report_line", "job_book")
    return evidence.examination_coverage(evidence.marked_welds(t["weld"], t["nde_report"], t["nde_report_line"]), t["job_book"]).drop("required_pct")


@bound("j7_report_lines", f"WITH {ctes('weld', 'nde_report', 'nde_report_line', 'job_book')}, {_EVIDENCE} SELECT job_book_id, 'claim' AS gap, id, weld_number FROM mk WHERE x AND ndt_report_id IS NULL AND NOT e UNION ALL SELECT l.job_book_id, 'orphan', nde_report_id, weld_number FROM nde_report_line l JOIN lv ON lv.id = nde_report_id AND lv.job_book_id = l.job_book_id WHERE weld_id IS NULL")
def report_lines(spark, sf_dir):
    from ..operators import evidence

    t = tables(spark, sf_dir, "weld", "nde_report", "nde_report_line")
    claims = evidence.claims_without_report(evidence.marked_welds(t["weld"], t["nde_report"], t["nde_report_line"])).select("job_book_id", F.lit("claim").alias("gap"), "id", "weld_number")
    orphans = evidence.orphan_lines(t["nde_report"], t["nde_report_line"]).select("job_book_id", F.lit("orphan").alias("gap"), F.col("nde_report_id").alias("id"), "weld_number")
    return claims.unionByName(orphans)


@bound("j14_tickets", f"""WITH {ctes('weld', 'nde_report')}, k AS (SELECT job_book_id, id, CASE WHEN ndt_ticket_number = 'T-00' THEN '0' WHEN ndt_ticket_number IS NOT NULL THEN regexp_extract(ndt_ticket_number, '[1-9][0-9]*$') WHEN xray_number = 'X-0' THEN '0' WHEN xray_number LIKE 'X-%' THEN regexp_extract(xray_number, '[1-9][0-9]*$') END AS n FROM weld WHERE status <> 'not_used')
SELECT r.job_book_id, r.id AS report_id, k.id AS weld_id FROM nde_report r JOIN k ON k.job_book_id = r.job_book_id AND k.n = CASE WHEN r.report_number = 'RT-0' THEN '0' ELSE regexp_extract(r.report_number, '[1-9][0-9]*$') END""")
def tickets(spark, sf_dir):
    from ..operators import evidence

    t = tables(spark, sf_dir, "weld", "nde_report")
    return evidence.welds_of_tickets(t["weld"], t["nde_report"])


_family("r_technicians", ("nde.technician_not", "nde.technician_cert"), ("nde_report", "certificate"), """c AS (SELECT r.*, x.id IS NOT NULL AS there, ndt_methods FROM nde_report r LEFT JOIN certificate x ON x.subject_type = 'ndt_technician' AND x.subject_id = r.technician_id AND x.job_book_id = r.job_book_id AND x.issue_date <= r.report_date AND (x.expiry_date IS NULL OR x.expiry_date >= r.report_date)
  WHERE NOT is_superseded AND technician_id IS NOT NULL),
m AS (SELECT job_book_id, id, CASE WHEN bool_or(list_contains(ndt_methods, method)) THEN 'covered' WHEN bool_or(there AND ndt_methods IS NULL) THEN 'unrecorded' WHEN bool_or(there) THEN 'other' ELSE 'none' END AS v FROM c GROUP BY ALL)""", [
    _rows("nde.technician_not_certified_on_report_date", "critical", "nde_report", "id", "8", "id", "m WHERE v = 'none'"),
    _rows("nde.technician_cert_methods_unrecorded", "warning", "nde_report", "id", "8", "id", "m WHERE v = 'unrecorded'"),
    _rows("nde.technician_not_certified_for_method", "critical", "nde_report", "id", "8", "id", "m WHERE v = 'other'"),
])

_family("r_materials", ("material.", "cp."), ("weld", "material_heat", "torque_connection", "cp_test_point", "job_book_section"), f"""{_COUNTABLE}, h AS (SELECT DISTINCT job_book_id, trim(x) AS k FROM (SELECT job_book_id, unnest(heat_numbers) AS x FROM cw) WHERE trim(x) <> '')""", [
    _rows("material.heat_without_mtr", "critical", "material_heat", "NULL", "15", "k", f"h WHERE NOT EXISTS (SELECT 1 FROM material_heat m WHERE m.job_book_id = h.job_book_id AND trim(m.heat_number) = h.k AND mtr_document_id IS NOT NULL AND mtr_status = 'on_file') AND {_read('15')}"),
    _rows("material.mtr_not_referenced", "info", "material_heat", "min(id)", "15", "heat_number", f"material_heat m WHERE mtr_document_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h WHERE h.job_book_id = m.job_book_id AND h.k = trim(m.heat_number)) AND {_read('15')} GROUP BY job_book_id, heat_number"),
    _rows("cp.flange_without_test_point", "warning", "torque_connection", "id", "18", "id", f"torque_connection c WHERE cp_test_on_flange AND NOT EXISTS (SELECT 1 FROM cp_test_point p WHERE p.job_book_id = c.job_book_id AND p.torque_connection_id = c.id) AND {_read('18')}"),
])


@bound("j8_flange_points", f"WITH {ctes('torque_connection', 'cp_test_point')} SELECT job_book_id, 'awaiting' AS gap, id FROM torque_connection c WHERE cp_test_on_flange AND NOT EXISTS (SELECT 1 FROM cp_test_point p WHERE p.job_book_id = c.job_book_id AND torque_connection_id = c.id) UNION ALL SELECT job_book_id, 'orphan', id FROM cp_test_point p WHERE torque_connection_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM torque_connection c WHERE c.job_book_id = p.job_book_id AND c.id = torque_connection_id AND cp_test_on_flange)")
def flange_points(spark, sf_dir):
    from ..operators import evidence

    t = tables(spark, sf_dir, "torque_connection", "cp_test_point")
    return evidence.flange_points(t["torque_connection"], t["cp_test_point"])


_PRESSURE = """sl AS (SELECT t.job_book_id, t.id, t.test_date, unnest([gauge_cert_id, recorder_cert_id, psv_cert_id]) AS cert FROM pressure_test t),
bad AS (SELECT DISTINCT sl.job_book_id, sl.id FROM sl LEFT JOIN certificate c ON c.id = sl.cert AND c.job_book_id = sl.job_book_id WHERE c.id IS NULL OR c.issue_date IS NULL OR test_date IS NULL OR test_date < issue_date OR test_date > expiry_date)"""
_family("r_pressure", ("pressure.",), ("pressure_test", "certificate", "job_book_section"), _PRESSURE, [
    _rows("pressure.no_valid_instrument_cert", "critical", "pressure_test", "id", "17", "id", f"bad WHERE {_read('17')}"),
    _rows("pressure.no_result_document", "critical", "pressure_test", "id", "17", "id", f"pressure_test WHERE result_document_id IS NULL AND chart_document_id IS NULL AND {_read('17')}"),
    _rows("pressure.hold_data_incomplete", "warning", "pressure_test", "id", "17", "id", f"pressure_test WHERE (result_document_id IS NOT NULL OR chart_document_id IS NOT NULL) AND (start_pressure_psi IS NULL OR end_pressure_psi IS NULL OR duration_minutes IS NULL OR ambient_temp_f IS NULL) AND {_read('17')}"),
])

_DRAWINGS = f"""{_COUNTABLE}, ref AS (SELECT DISTINCT job_book_id, upper(trim(isometric_number)) AS iso, 'w' AS src FROM cw WHERE isometric_number IS NOT NULL UNION SELECT DISTINCT job_book_id, upper(trim(iso_number)), 't' FROM torque_connection WHERE iso_number IS NOT NULL),
sec AS (SELECT job_book_id, id AS section_id, section_number FROM job_book_section WHERE section_number IN ('21', '22') AND status <> 'na' AND ingestion_status IS DISTINCT FROM 'not_imported'),
dw AS (SELECT d.job_book_id, section_number, CASE WHEN record_type = 'isometric' THEN upper(trim(record_id)) WHEN original_filename LIKE '%-ga-%' THEN upper(regexp_extract(original_filename, '^[0-9]+-ga-[0-9]+-acm')) END AS iso FROM document d JOIN sec USING (job_book_id, section_id) WHERE NOT is_deleted AND is_approved),
miss AS (SELECT DISTINCT sec.job_book_id, section_number FROM sec JOIN ref USING (job_book_id) WHERE NOT EXISTS (SELECT 1 FROM dw WHERE dw.job_book_id = sec.job_book_id AND dw.section_number = sec.section_number AND dw.iso = ref.iso))"""
_family("r_drawings", ("isometric.",), ("weld", "torque_connection", "document", "job_book_section"), _DRAWINGS, [
    _rows("isometric.drawing_missing", "critical", "job_book", "job_book_id", "(section_number)", "job_book_id || '|' || section_number", "miss"),
    _rows("isometric.drawing_not_attributable", "warning", "job_book", "job_book_id", "(section_number)", "job_book_id || '|' || section_number", "(SELECT DISTINCT job_book_id, section_number FROM dw WHERE iso IS NULL)"),
])

_DOCS = """live AS (SELECT d.*, coalesce(other_filename, original_filename) AS normal, s.section_number, s.title FROM document d LEFT JOIN job_book_section s ON s.id = d.section_id AND s.job_book_id = d.job_book_id WHERE NOT is_deleted),
g AS (SELECT job_book_id, sha256, count(*) AS n, min(id) AS first, count(DISTINCT section_number) AS places, min(id) FILTER (WHERE section_number IS NOT NULL) AS fp, arg_min(section_number, id) FILTER (WHERE section_number IS NOT NULL) AS place FROM live GROUP BY ALL)"""
_family("r_document_findings", ("document.", "section."), ("document", "job_book", "job_book_section", "nde_report", "weld", "torque_connection"), _DOCS, [
    _rows("document.archive_uploaded", "info", "document", "id", "NULL", "id", "live WHERE original_filename LIKE '%.ZIP'"),
    _rows("document.filename_normalized", "info", "document", "id", "NULL", "id", "live WHERE normal <> original_filename"),
    _rows("document.wrong_job_filename", "critical", "document", "l.id", "NULL", "l.id", "live l JOIN job_book b ON b.id = job_book_id WHERE len(list_filter(regexp_extract_all(upper(original_filename || ' ' || normal), '\\b[A-Z][A-Z][0-9][0-9][0-9]\\b'), lambda j: j <> job_number)) > 0"),
    _rows("document.duplicate", "warning", "document", "first", "NULL", "sha256", "g WHERE n > 1"),
    _rows("document.same_file_in_two_sections", "warning", "document", "fp", "(place)", "sha256", "g WHERE places > 1"),
    _rows("document.superseded_without_successor", "warning", "document", "id", "NULL", "id", "live WHERE is_superseded AND NOT EXISTS (SELECT 1 FROM document x WHERE x.job_book_id = live.job_book_id AND x.supersedes_document_id = live.id)"),
    _rows("document.ifr_in_as_built", "warning", "document", "id", "(section_number)", "id", "live WHERE lower(title) LIKE '%as-built%' AND original_filename LIKE '% IFR %'"),
    _rows("document.only_lock_file", "warning", "job_book_section", "s.id", "(s.section_number)", "s.id", "job_book_section s WHERE weight > 0 AND EXISTS (SELECT 1 FROM live WHERE live.job_book_id = s.job_book_id AND section_id = s.id) AND NOT EXISTS (SELECT 1 FROM live WHERE live.job_book_id = s.job_book_id AND section_id = s.id AND NOT starts_with(original_filename, '~$'))"),
    _rows("document.wrong_job", "critical", "nde_report", "r.id", "10", "r.id", "nde_report r JOIN job_book b ON b.id = job_book_id WHERE upper(referenced_pad) <> drill_pad_name OR (upper(referenced_facility) <> job_number AND regexp_matches(upper(referenced_facility), '^[A-Z][A-Z][0-9][0-9][0-9]$'))"),
    _rows("section.empty_required", "critical", "job_book_section", "id", "(section_number)", "section_number", "job_book_section s WHERE is_required AND weight > 0 AND status <> 'na' AND ingestion_status IS DISTINCT FROM 'not_imported' AND NOT EXISTS (SELECT 1 FROM live WHERE live.job_book_id = s.job_book_id AND section_id = s.id) AND NOT coalesce((linked_record_type = 'nde_report' AND job_book_id IN (SELECT job_book_id FROM nde_report)) OR (linked_record_type = 'weld' AND job_book_id IN (SELECT job_book_id FROM weld)) OR (linked_record_type = 'torque_connection' AND job_book_id IN (SELECT job_book_id FROM torque_connection)), false)"),
])

_DATED = """hz AS (SELECT id AS job_book_id, least(DATE '1999-01-01', coalesce(data_as_of_date, DATE '1999-01-01')) AS h FROM job_book),
dt AS (SELECT job_book_id, 'weld' AS kind, id, weld_date AS d, 'weld date' AS label, '12' AS sec FROM weld UNION ALL SELECT job_book_id, 'torque_connection', id, torque_date, 'torque date', '14' FROM torque_connection UNION ALL SELECT job_book_id, 'nde_report', id, report_date, 'report date', '10' FROM nde_report
  UNION ALL SELECT DISTINCT c.job_book_id, 'torque_wrench', w.id, last_calibration_date, 'calibration date', '13' FROM torque_connection c JOIN torque_wrench w ON w.id = c.wrench_id)"""
bound("r_future_dates", f"WITH {ctes('job_book', 'weld', 'torque_connection', 'nde_report', 'torque_wrench')}, {_DATED} SELECT job_book_id, 'record.future_dated' AS rule_id, 'critical' AS severity, kind AS entity_type, id AS entity_id, sec AS section, 'record.future_dated|' || kind || '|' || id || '|' || label AS fingerprint FROM dt JOIN hz USING (job_book_id) WHERE d > h")(
    lambda spark, sf_dir: found(spark, sf_dir, ("record.",), "job_book", "weld", "torque_connection", "nde_report", "torque_wrench")
)

_LAPSE = f"""{_CREDIT}, work AS (SELECT job_book_id, 'welder' AS st, who AS sid, weld_date AS d FROM credit UNION ALL SELECT job_book_id, 'ndt_technician', technician_id, report_date FROM nde_report
  UNION ALL SELECT c.job_book_id, 'torque_wrench', w.id, torque_date FROM torque_connection c JOIN torque_wrench w ON w.id = c.wrench_id OR w.wrench_id = c.wrench_id_raw),
lp AS (SELECT c.*, EXISTS (SELECT 1 FROM work w WHERE w.job_book_id = c.job_book_id AND st = subject_type AND sid = subject_id AND d > expiry_date) AS later FROM certificate c JOIN job_book b ON b.id = job_book_id WHERE expiry_date < construction_end AND (construction_start IS NULL OR expiry_date >= construction_start))"""
_family("r_certificates", ("certificate.",), ("certificate", "job_book", "weld", "nde_report", "torque_connection", "torque_wrench"), _LAPSE, [
    _rows("certificate.expiring_soon", "warning", "certificate", "c.id", "NULL", "c.id", "certificate c JOIN job_book b ON b.id = job_book_id WHERE expiry_date BETWEEN DATE '1999-01-01' AND DATE '1999-01-01' + cert_expiry_warning_days"),
    _rows("certificate.expires_during_job", "(CASE WHEN later THEN 'critical' ELSE 'warning' END)", "certificate", "id", "(CASE subject_type WHEN 'welder' THEN '6' WHEN 'ndt_technician' THEN '8' ELSE '13' END)", "id", "lp"),
])
