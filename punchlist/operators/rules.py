"""Data-quality rules: each a function from the tables of all books to findings; all of them one union.

``tables`` maps names to DataFrames that carry ``job_book_id``; a rule whose tables were not loaded is left out, never judged
as clean. Thresholds are columns of ``job_book``. A rule that several ids share gives each row its id and severity in one pass.
Findings have one shape: job_book_id, rule_id, severity, entity_type, entity_id, section, fingerprint, detail.

Rules of a section that was never imported stay silent: the table ``job_book_section`` says which, where it is loaded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import engineering
from ..functions.dates import is_after, is_before, is_within
from ..functions.keys import fingerprint
from ..sources.shared import written
from . import completeness, evidence, history, reconcile, rollup, validity

Tables = dict[str, DataFrame]
BOOK = "job_book_id"
#: So many measured connections make a log whose readings all equal the requirement implausible.
IMPLAUSIBLE_FROM = 25
#: Fixed value: the share of entries on time that a book aims at.
TARGET_PCT = 95.0


@dataclass(frozen=True)
class Settings:
    """``bands``: (tier, least, most, fraction) of the share of yield strength, for books on a tiered rule."""

    as_of: str
    bands: tuple[tuple[str, float, float | None, float], ...] = ()

    @property
    def today(self) -> Column:
        return F.lit(self.as_of).cast("date")


@dataclass(frozen=True)
class Rule:
    ids: tuple[str, ...]
    needs: tuple[str, ...]
    run: Callable[[Tables, Settings], DataFrame]


RULES: list[Rule] = []


def rule(ids: str | tuple[str, ...], *needs: str):
    """Registers a function of (tables, settings) that returns ``found(...)`` rows."""

    def enter(f):
        RULES.append(Rule((ids,) if isinstance(ids, str) else ids, needs, f))
        return f

    return enter


def _column(value: Column | str | None) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("string")


def found(df: DataFrame, id: Column | str, severity: Column | str, kind: str, entity: Column | str | None, section: Column | str | None = None, parts: tuple[Column | str, ...] = (), detail: Column | None = None) -> DataFrame:
    """Rows as findings. ``entity`` names a column; the fingerprint joins the rule's id and ``parts``, the entity if there are none."""
    entity = F.col(entity) if isinstance(entity, str) else _column(entity)
    own = [F.col(p) if isinstance(p, str) else p for p in parts] or [entity]
    return df.select(BOOK, _column(id).alias("rule_id"), _column(severity).alias("severity"), F.lit(kind).alias("entity_type"), entity.cast("string").alias("entity_id"), _column(section).alias("section"), fingerprint(_column(id), *own).alias("fingerprint"), _column(detail).alias("detail"))


def declared(id: str, severity: str, table: str, predicate: str, kind: str, entity: str = "id", section: str | None = None) -> Rule:
    """A rule that is one predicate over one table, as a row of configuration can state it."""
    return Rule((id,), (table,), lambda t, s: found(_read(t[table].where(F.expr(predicate)), t, section), id, severity, kind, entity, section))


def findings(tables: Tables, settings: Settings, rules: list[Rule] | None = None) -> DataFrame:
    """All findings of the rules whose tables are there, each fingerprint of a book once, in the order of the rules."""
    parts = [r.run(tables, settings).withColumn("rule_order", F.lit(i)) for i, r in enumerate(rules if rules is not None else RULES) if all(n in tables for n in r.needs)]
    if not parts:
        raise ValueError("no rule has the tables that it needs")
    return history.first_by_fingerprint(reduce(DataFrame.unionByName, parts), [BOOK, "fingerprint"], ["rule_order", "entity_id", "detail"]).drop("rule_order")


def ready_with_open_findings(sections: DataFrame, all_findings: DataFrame) -> DataFrame:
    """The second pass: sections marked ready that still have findings above info."""
    n = all_findings.where("section IS NOT NULL AND severity <> 'info'").groupBy(BOOK, "section").agg(F.count(F.lit(1)).alias("n"))
    ready = sections.where(F.col("status") == "ready_for_review").withColumn("section", F.col("section_number")).join(n, [BOOK, "section"])
    return found(ready, "section.ready_with_open_flags", "info", "job_book_section", "id", F.col("section"), (), F.col("n"))


def _read(df: DataFrame, t: Tables, *sections: str | None) -> DataFrame:
    """Rows of books whose sections were imported, as far as that is known."""
    named = [s for s in sections if s]
    if "job_book_section" not in t or not named:
        return df
    unread = t["job_book_section"].where(F.col("section_number").isin(named) & (F.col("ingestion_status") == "not_imported"))
    return df.join(unread.select(BOOK).distinct(), BOOK, "left_anti")


def _book(t: Tables, *columns: str) -> DataFrame:
    return t["job_book"].select(F.col("id").alias(BOOK), *columns)


# People and qualifications


def _people() -> Column:
    return rollup.credited(F.col("welder_id"), [F.col(c) for c in ("root_welder_id", "hot_welder_id", "fill_welder_id", "cap_welder_id")])


def _credits(t: Tables) -> DataFrame:
    return evidence.countable(t["weld"]).select(BOOK, F.col("id").alias("weld_id"), F.explode(_people()).alias("who"), "weld_date")


@rule(("welder.not_qualified_on_weld_date", "welder.qualification_currency_unverifiable"), "weld", "welder_qualification")
def not_qualified(t, s):
    c = _credits(t).where("weld_date IS NOT NULL")
    # Verdicts are per person and day: many welds of one day ask the same question.
    days = c.select("who", "weld_date").distinct().withColumn("event", F.concat_ws("|", "who", "weld_date"))
    v = validity.qualification_verdicts(days, t["welder_qualification"].withColumnRenamed("welder_id", "who"), ["who"], "event", "weld_date", "qualification_date", "expiry_date")
    # Written, so that their size is known: there are people times days at most, and welds need not be shuffled to meet them.
    v = written(c.sparkSession, v.where("verdict <> 'qualified'").select("who", "weld_date", "verdict"), "verdicts")
    bad = c.join(v, ["who", "weld_date"])
    open_ = F.col("verdict") == "unverifiable"
    id = F.when(open_, "welder.qualification_currency_unverifiable").otherwise("welder.not_qualified_on_weld_date")
    return found(bad, id, F.when(open_, "warning").otherwise("critical"), "weld", "weld_id", "6", ("weld_id", "who"), F.col("verdict"))


@rule("weld.no_welder_stamp", "weld")
def no_stamp(t, s):
    none = (F.size(_people()) == 0) & (F.coalesce(F.col("welder_stamp"), F.lit("")) == "")
    return found(evidence.countable(t["weld"]).where(none), "weld.no_welder_stamp", "critical", "weld", "id", "12")


@rule("welder.combined_stamp", "weld", "welder")
def combined(t, s):
    crew = t["welder"].where("n_combined > 0").select(F.col("id").alias("welder_id"))
    n = evidence.countable(t["weld"]).join(crew, "welder_id").groupBy(BOOK, "welder_id").agg(F.count(F.lit(1)).alias("n"))
    return found(n, "welder.combined_stamp", "info", "welder", "welder_id", "12", (), F.col("n"))


@rule(("welder.below_xray_minimum", "welder.below_job_nde_requirement"), "weld", "job_book")
def below_minimum(t, s):
    """Books without a rule of their own: the job's minimum; books on a flat rule: what that states."""
    people, seen = _people(), completeness.examined(F.col("ndt_method"), F.col("xray_number"))
    r = rollup.credit_rollup(evidence.countable(t["weld"]), [BOOK], people, seen, people, F.col("ndt_result"), F.col("weld_date"), 0.0)
    r = r.join(_book(t, "rule_kind", "required_xray_pct", "required_nde_pct"), BOOK).where("rule_kind IS NULL OR rule_kind = 'flat'")
    flat, share = F.col("rule_kind").isNotNull(), F.col("examined") / F.col("joints") * 100
    id = F.when(flat, "welder.below_job_nde_requirement").otherwise("welder.below_xray_minimum")
    low = r.where(share < F.when(flat, F.col("required_nde_pct")).otherwise(F.col("required_xray_pct")))
    return found(low, id, "critical", "welder", "person", F.when(flat, "12").otherwise("11"), (), F.col("examined_pct"))


@rule(("weld.tier_not_met", "weld.smys_uncomputable"), "weld", "job_book")
def stress(t, s):
    """One pass over welds with the pipe's stress: a tier that asks for an examination, and stresses that cannot be said.

    Tiers are those of the bands supplied; books on another rule have none.
    """
    welds = evidence.countable(t["weld"]).join(_book(t, "rule_kind", "default_design_pressure_psi"), BOOK)
    pressure = F.coalesce("design_pressure_psi", "default_design_pressure_psi")
    out = engineering.with_stress(welds, "pipe_size_schedule", "pipe_grade", pressure, list(s.bands))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    empty = blank("pipe_size_schedule") & blank("pipe_grade") & F.col("design_pressure_psi").isNull()
    unknown = F.col("uncomputable_reason").isNotNull() & ~empty
    tiered = F.col("rule_kind").isNull() | (F.col("rule_kind") == "tiered")
    unmet = tiered & engineering.requires_examination(F.col("required_fraction")) & F.col("ndt_method").isNull()
    id = F.when(unmet, "weld.tier_not_met").when(unknown, "weld.smys_uncomputable")
    # Unfolded, not filtered: a filter would be pushed below the stress and work all of it out anew, for every use that it makes of it.
    hit = out.select(BOOK, "id", F.explode(F.when(id.isNotNull(), F.array(F.struct(id.alias("rule"), F.coalesce("tier", "uncomputable_reason").alias("detail"))))).alias("f"))
    return found(hit, F.col("f.rule"), "critical", "weld", "id", "12", (), F.col("f.detail"))


# Torque


@rule(tuple(f"torque.wrench_{v}" for v in ("not_yet_issued", "expired", "unknown_wrench", "no_certificate", "no_wrench_recorded")), "torque_connection", "torque_wrench")
def calibrations(t, s):
    c = t["torque_connection"].select(BOOK, "id", "wrench_id", F.col("wrench_id_raw").alias("raw"), "torque_date").withColumn("event", F.concat_ws("|", BOOK, "id"))
    v = validity.calibration_verdicts(c, t["torque_wrench"].withColumnRenamed("wrench_id", "code"), "event", "wrench_id", "raw", "torque_date", "id", "code", "last_calibration_date", "calibration_due_date", "cert_on_file", keep=(BOOK, "id", "raw"))
    bad = v.where(F.col("verdict").isin("not_yet_issued", "expired", "unknown_wrench", "no_certificate", "no_wrench_recorded"))
    return found(bad, F.concat(F.lit("torque.wrench_"), "verdict"), "critical", "torque_connection", "id", "13", ("id", F.coalesce("raw", F.lit("unrecorded"))))


def _used_codes(t: Tables) -> DataFrame:
    """(job_book_id, code, n): what connections say they used, by the code as written, else by that of the wrench's id."""
    codes = t["torque_wrench"].select("id", F.col("wrench_id").alias("own"))
    c = t["torque_connection"].select(BOOK, F.col("wrench_id").alias("id"), "wrench_id_raw").join(codes, "id", "left")
    return c.select(BOOK, F.coalesce("wrench_id_raw", "own").alias("code")).where("code IS NOT NULL").groupBy(BOOK, "code").agg(F.count(F.lit(1)).alias("n"))


@rule(("torque.roster_contradicts_certificate", "torque.certificate_unread", "torque.wrench_failed_calibration"), "torque_connection", "torque_wrench")
def used_wrenches(t, s):
    """What is wrong with each wrench that a book used, all in one pass over (book, wrench)."""
    c = t["torque_connection"]
    by_id = c.where("wrench_id IS NOT NULL").select(BOOK, F.col("wrench_id").alias("id")).distinct()
    by_code = c.where("wrench_id_raw IS NOT NULL").select(BOOK, F.col("wrench_id_raw").alias("wrench_id")).distinct()
    w = t["torque_wrench"]
    used = by_id.join(w, "id").select(BOOK, *w.columns).unionByName(by_code.join(w, "wrench_id").select(BOOK, *w.columns)).dropDuplicates([BOOK, "id"])
    dates = [F.col("roster_claimed_calibration_date"), F.col("last_calibration_date")]
    entry = lambda id, sev, *parts: F.struct(F.lit(id).alias("rule"), F.lit(sev).alias("sev"), F.concat_ws("|", *parts).alias("parts"))
    faults = F.array_compact(F.array(
        F.when(dates[0] != dates[1], entry("torque.roster_contradicts_certificate", "warning", "id", *dates)),
        F.when(F.col("cert_on_file") & dates[1].isNull(), entry("torque.certificate_unread", "info", "id")),
        F.when(F.col("calibration_status") == "fail", entry("torque.wrench_failed_calibration", "critical", "id")),
    ))
    return found(used.select(BOOK, "id", F.explode(faults).alias("f")), F.col("f.rule"), F.col("f.sev"), "torque_wrench", "id", "13", (F.col("f.parts"),))


@rule("torque.wrench_not_on_roster", "torque_connection", "torque_wrench")
def not_on_roster(t, s):
    rostered = t["torque_wrench"].where("on_roster").select(F.col("wrench_id").alias("code"))
    return found(_used_codes(t).join(rostered, "code", "left_anti"), "torque.wrench_not_on_roster", "critical", "torque_wrench", None, "13", ("code",), F.col("n"))


@rule("torque.out_of_tolerance", "torque_connection", "job_book")
def out_of_tolerance(t, s):
    c = t["torque_connection"].join(_book(t, "torque_tolerance_pct"), BOOK)
    ok = completeness.within_tolerance(*[F.col(x) for x in ("actual_torque_ft_lb", "required_torque_ft_lb", "required_torque_min_ft_lb", "required_torque_max_ft_lb", "torque_tolerance_pct")])
    return found(c.where(~ok), "torque.out_of_tolerance", "warning", "torque_connection", "id", "14", (), F.col("actual_torque_ft_lb"))


@rule(("torque.implausibly_exact", "torque.inspection_below_minimum"), "torque_connection", "job_book")
def whole_logs(t, s):
    """Both rules on a whole torque log, from one aggregation."""
    measured = F.col("required_torque_ft_lb").isNotNull() & F.col("actual_torque_ft_lb").isNotNull()
    n = t["torque_connection"].groupBy(BOOK).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(measured).alias("measured"), F.count_if(measured & (F.col("actual_torque_ft_lb") == F.col("required_torque_ft_lb"))).alias("exact"),
        F.count_if(completeness.inspected(F.col("inspection_date"), F.col("inspector_initials"))).alias("inspected"),
    ).join(_book(t, "required_torque_inspect_pct"), BOOK)
    faults = F.array_compact(F.array(
        F.when((F.col("measured") >= IMPLAUSIBLE_FROM) & (F.col("exact") == F.col("measured")), F.lit("torque.implausibly_exact")),
        F.when(F.col("inspected") / F.col("n") * 100 < F.col("required_torque_inspect_pct"), F.lit("torque.inspection_below_minimum")),
    ))
    return found(n.select("*", F.explode(faults).alias("f")), F.col("f"), "warning", "job_book", None, "14", (F.lit(None).cast("string"),), F.col("n"))


# Examination


@rule("nde.technician_unknown", "nde_report")
def technician_unknown(t, s):
    return found(evidence.live_reports(t["nde_report"]).where("technician_id IS NULL"), "nde.technician_unknown", "critical", "nde_report", "id", "8", (), F.col("technician_name"))


@rule(("nde.technician_not_certified_on_report_date", "nde.technician_cert_methods_unrecorded", "nde.technician_not_certified_for_method"), "nde_report", "certificate")
def technician_methods(t, s):
    r = evidence.live_reports(t["nde_report"]).where("technician_id IS NOT NULL")
    asked = r.select(BOOK, "technician_id", "report_date", "method").distinct().withColumn("event", F.concat_ws("|", BOOK, "technician_id", "report_date", "method"))
    certs = t["certificate"].where("subject_type = 'ndt_technician'").select(BOOK, F.col("subject_id").alias("technician_id"), "ndt_methods", "issue_date", "expiry_date")
    v = validity.method_coverage(asked, certs, [BOOK, "technician_id"], "event", "report_date", "method", "issue_date", "expiry_date", "ndt_methods").where("verdict <> 'covered'")
    v = written(r.sparkSession, v, "verdicts")
    bad = r.withColumn("event", F.concat_ws("|", BOOK, "technician_id", "report_date", "method")).join(v, "event")
    names = {"no_cert": "nde.technician_not_certified_on_report_date", "methods_unrecorded": "nde.technician_cert_methods_unrecorded", "method_not_covered": "nde.technician_not_certified_for_method"}
    id = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("verdict")]
    return found(bad, id, F.when(F.col("verdict") == "methods_unrecorded", "warning").otherwise("critical"), "nde_report", "id", "8", (), F.array_join("covers", ", "))


@rule("nde.import_gap", "nde_report_gap", "nde_report")
def import_gap(t, s):
    live = evidence.live_reports(t["nde_report"]).select(BOOK, F.col("id").alias("nde_report_id"))
    gaps = t["nde_report_gap"].where("severity = 'critical'").join(live, [BOOK, "nde_report_id"])
    return found(gaps, "nde.import_gap", "critical", "nde_report", "nde_report_id", "10", (F.concat(F.col("nde_report_id"), F.lit(":"), F.col("kind"), F.lit(":"), F.coalesce(F.nullif(F.col("page"), F.lit(0)).cast("string"), F.lit(""))),))


@rule("nde.examined_not_evidenced", "weld", "nde_report", "nde_report_line", "job_book")
def not_evidenced(t, s):
    c = evidence.examination_coverage(evidence.marked_welds(t["weld"], t["nde_report"], t["nde_report_line"]), t["job_book"])
    short = F.when(F.col("meets_on_evidenced") == F.lit(False), "critical").otherwise("warning")
    return found(_read(c.where("unevidenced > 0"), t, "10"), "nde.examined_not_evidenced", short, "job_book", BOOK, "10", (), F.col("unevidenced"))


@rule("weld.nde_without_report", "weld")
def without_report(t, s):
    w = _read(evidence.countable(t["weld"]).where("ndt_method IS NOT NULL AND ndt_report_id IS NULL"), t, "10", "12")
    return found(w, "weld.nde_without_report", "warning", "weld", "id", "10", (), F.col("weld_number"))


@rule("nde.same_day_reports_unresolved", "nde_report")
def same_day(t, s):
    key = F.concat(F.coalesce(F.col("report_date").cast("string"), F.lit("null")), F.lit("|"), F.col("method"), F.lit("|"), F.coalesce("ndt_company", F.lit("")))
    n = evidence.live_reports(t["nde_report"]).groupBy(BOOK, key.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1")
    return found(n, "nde.same_day_reports_unresolved", "warning", "nde_report", "first", "10", ("day",), F.col("n"))


@rule("nde.outside_construction_window", "nde_report", "job_book")
def outside_window(t, s):
    r = t["nde_report"].where("report_date IS NOT NULL").join(_book(t, "construction_start", "construction_end"), BOOK)
    return found(r.where(~is_within(F.col("report_date"), F.col("construction_start"), F.col("construction_end"))), "nde.outside_construction_window", "warning", "nde_report", "id", "10", (), F.col("report_date"))


@rule("document.wrong_job", "nde_report", "job_book")
def wrong_job_report(t, s):
    r = t["nde_report"].join(_book(t, "drill_pad_name", "job_number"), BOOK)
    name = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    pad = name("referenced_pad") != name("drill_pad_name")
    place = (name("referenced_facility") != name("job_number")) & name("referenced_facility").rlike("^[A-Z]{2}[0-9]{3}$")
    return found(r.where(F.coalesce(pad, F.lit(False)) | F.coalesce(place, F.lit(False))), "document.wrong_job", "critical", "nde_report", "id", "10")


# Materials, pressure, drawings, cathodic protection


def _heats(t: Tables) -> DataFrame:
    used = evidence.countable(t["weld"]).select(BOOK, F.explode("heat_numbers").alias("h"))
    known, on_file = t["material_heat"], t["material_heat"].where("mtr_document_id IS NOT NULL AND mtr_status = 'on_file'")
    return reconcile.membership({"used": (used, F.nullif(F.trim("h"), F.lit(""))), "known": (known, F.trim("heat_number")), "file": (on_file, F.trim("heat_number"))}, [BOOK])


@rule("material.heat_without_mtr", "weld", "material_heat")
def heat_without_mtr(t, s):
    return found(_read(_heats(t).where("in_used AND NOT in_file"), t, "15"), "material.heat_without_mtr", "critical", "material_heat", None, "15", ("key",), F.col("n_used"))


@rule("material.mtr_not_referenced", "weld", "material_heat")
def mtr_not_referenced(t, s):
    used = evidence.countable(t["weld"]).select(BOOK, F.explode("heat_numbers").alias("h")).select(BOOK, F.trim("h").alias("key")).distinct()
    idle = t["material_heat"].where("mtr_document_id IS NOT NULL").withColumn("key", F.trim("heat_number")).join(used, [BOOK, "key"], "left_anti")
    return found(_read(idle, t, "15"), "material.mtr_not_referenced", "info", "material_heat", "id", "15", ("heat_number",))


@rule("cp.flange_without_test_point", "torque_connection", "cp_test_point")
def cp_flange(t, s):
    gaps = evidence.flange_points(t["torque_connection"], t["cp_test_point"]).where("gap = 'awaiting'")
    return found(_read(gaps, t, "18"), "cp.flange_without_test_point", "warning", "torque_connection", "id", "18")


@rule("pressure.no_valid_instrument_cert", "pressure_test", "certificate")
def instrument_cert(t, s):
    slots = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(label).alias("slot"), F.col(f"{label.lower()}_cert_id").alias("cert")) for i, label in enumerate(("gauge", "recorder", "PSV"))])).alias("x")
    p = t["pressure_test"].select(BOOK, "id", "test_date", slots).select(BOOK, "id", "test_date", "x.*")
    c = t["certificate"].select(BOOK, F.col("id").alias("cert"), "issue_date", "expiry_date", F.lit(True).alias("there"))
    day = F.col("test_date")
    why = (
        F.when(F.col("there").isNull(), "not linked").when(F.col("issue_date").isNull(), "unread").when(day.isNull(), "undated test")
        .when(is_before(day, F.col("issue_date")), "issued after the test").when(is_after(day, F.col("expiry_date")), "expired before the test")
    )
    bad = p.join(c, [BOOK, "cert"], "left").withColumn("why", why).where("why IS NOT NULL").groupBy(BOOK, "id").agg(F.array_sort(F.collect_list(F.struct("place", "slot", "why"))).alias("ws"))
    return found(_read(bad, t, "17"), "pressure.no_valid_instrument_cert", "critical", "pressure_test", "id", "17", (), F.array_join(F.transform("ws", lambda w: F.concat_ws(": ", w.slot, w.why)), "; "))


@rule(("isometric.drawing_missing", "isometric.drawing_not_attributable"), "weld", "torque_connection", "document", "job_book_section")
def drawings(t, s):
    """Sections 21 and 22 that apply and were imported: isometrics without an approved drawing, and drawings of no isometric."""
    sections = t["job_book_section"].where("section_number IN ('21', '22') AND status <> 'na' AND ingestion_status IS DISTINCT FROM 'not_imported'").select(BOOK, F.col("id").alias("section_id"), F.col("section_number").alias("section"))
    on_file = evidence.attributed(t["document"].where("NOT is_deleted AND is_approved")).join(sections, [BOOK, "section_id"]).withColumn("checks", F.lit(0))
    missing = evidence.drawings_against_logs(t["weld"], t["torque_connection"], on_file).where("(in_welds OR in_torque) AND n_drawings = 0").groupBy(BOOK, "section").agg(F.count(F.lit(1)).alias("n")).join(sections, [BOOK, "section"], "left_semi")
    strays = on_file.where("isometric IS NULL").groupBy(BOOK, "section").agg(F.count(F.lit(1)).alias("n"))
    both = missing.withColumn("r", F.lit("isometric.drawing_missing")).unionByName(strays.withColumn("r", F.lit("isometric.drawing_not_attributable")))
    severity = F.when(F.col("r") == "isometric.drawing_missing", "critical").otherwise("warning")
    return found(both, F.col("r"), severity, "job_book", BOOK, F.col("section"), (BOOK, "section"), F.col("n"))


_HAS_RESULT = "(result_document_id IS NOT NULL OR chart_document_id IS NOT NULL)"
RULES += [
    declared("pressure.no_result_document", "critical", "pressure_test", f"NOT {_HAS_RESULT}", "pressure_test", section="17"),
    declared("pressure.hold_data_incomplete", "warning", "pressure_test", f"{_HAS_RESULT} AND (start_pressure_psi IS NULL OR end_pressure_psi IS NULL OR duration_minutes IS NULL OR ambient_temp_f IS NULL)", "pressure_test", section="17"),
    declared("document.archive_uploaded", "info", "document", r"NOT is_deleted AND lower(original_filename) RLIKE '\\.(zip|7z|rar|tar|gz)$'", "document"),
    declared("document.filename_normalized", "info", "document", "NOT is_deleted AND normalized_filename <> original_filename", "document"),
]


# Documents


@rule("document.wrong_job_filename", "document", "job_book")
def wrong_job(t, s):
    d = t["document"].where("NOT is_deleted").join(_book(t, "job_number"), BOOK)
    names = F.upper(F.concat_ws(" ", "original_filename", "normalized_filename"))
    foreign = F.array_except(F.regexp_extract_all(names, F.lit(r"\b([A-Z]{2}[0-9]{3})\b"), F.lit(1)), F.array(F.upper(F.trim("job_number"))))
    d = d.withColumn("foreign", foreign).where(F.size("foreign") > 0)
    return found(d, "document.wrong_job_filename", "critical", "document", "id", None, (), F.array_join("foreign", ", "))


@rule(("document.duplicate", "document.same_file_in_two_sections"), "document")
def duplicates(t, s):
    """Equal contents in a book, and in more than one of its sections; one aggregation for both."""
    sections = t.get("job_book_section")
    d = t["document"].where("NOT is_deleted AND sha256 IS NOT NULL")
    if sections is None:
        d = d.withColumn("section", F.col("section_id"))
    else:
        d = d.join(sections.select(BOOK, F.col("id").alias("section_id"), F.col("section_number").alias("section")), [BOOK, "section_id"], "left")
    g = d.groupBy(BOOK, "sha256").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.countDistinct("section").alias("places"), F.min_by("id", F.when(F.col("section").isNotNull(), F.col("id"))).alias("first_placed"), F.min_by("section", F.when(F.col("section").isNotNull(), F.col("id"))).alias("place"))
    entry = lambda id, entity, section: F.struct(F.lit(id).alias("rule"), entity.alias("entity"), section.alias("section"))
    faults = F.array_compact(F.array(
        F.when(F.col("n") > 1, entry("document.duplicate", F.col("first"), F.lit(None).cast("string"))),
        F.when(F.col("places") > 1, entry("document.same_file_in_two_sections", F.col("first_placed"), F.col("place"))),
    ))
    return found(g.select(BOOK, "sha256", "n", F.explode(faults).alias("f")), F.col("f.rule"), "warning", "document", F.col("f.entity"), F.col("f.section"), ("sha256",), F.col("n"))


@rule("document.superseded_without_successor", "document")
def no_successor(t, s):
    after = t["document"].where("supersedes_document_id IS NOT NULL").select(BOOK, F.col("supersedes_document_id").alias("id")).distinct()
    return found(t["document"].where("is_superseded AND NOT is_deleted").join(after, [BOOK, "id"], "left_anti"), "document.superseded_without_successor", "warning", "document", "id")


@rule("document.ifr_in_as_built", "document", "job_book_section")
def ifr(t, s):
    built = t["job_book_section"].where(r"lower(title) LIKE '%as-built%'").select(BOOK, F.col("id").alias("section_id"), "section_number")
    d = t["document"].where("NOT is_deleted").where(F.col("original_filename").rlike(r"(?i)\bIFR\b|issued\s*for\s*review")).join(built, [BOOK, "section_id"])
    return found(d, "document.ifr_in_as_built", "warning", "document", "id", F.col("section_number"))


@rule("document.only_lock_file", "document", "job_book_section")
def lock_file(t, s):
    per = t["document"].where("NOT is_deleted").groupBy(BOOK, F.col("section_id").alias("id")).agg(F.bool_and(F.startswith("original_filename", F.lit("~$"))).alias("locked")).where("locked")
    return found(t["job_book_section"].where("weight > 0").join(per, [BOOK, "id"]), "document.only_lock_file", "warning", "job_book_section", "id", F.col("section_number"))


@rule("section.empty_required", "job_book_section", "document")
def empty_required(t, s):
    docs = t["document"].where("NOT is_deleted").select(BOOK, F.col("section_id").alias("id")).distinct()
    required = t["job_book_section"].where("is_required AND weight > 0 AND status <> 'na' AND ingestion_status IS DISTINCT FROM 'not_imported'")
    linked = [t[n].select(BOOK, F.lit(n).alias("linked_record_type")).distinct() for n in ("weld", "torque_connection", "material_heat", "nde_report", "pressure_test", "cp_test_point", "ut_reading", "coating_inspection") if n in t]
    empty = required.join(docs, [BOOK, "id"], "left_anti")
    if linked:
        empty = empty.join(reduce(DataFrame.unionByName, linked), [BOOK, "linked_record_type"], "left_anti")
    return found(empty, "section.empty_required", "critical", "job_book_section", "id", F.col("section_number"), ("section_number",), F.col("weight"))


# Certificates and dates


@rule("certificate.expiring_soon", "certificate", "job_book")
def expiring(t, s):
    c = t["certificate"].join(_book(t, "cert_expiry_warning_days"), BOOK)
    status = validity.certificate_status(F.col("expiry_date"), s.today, F.col("cert_expiry_warning_days"))
    return found(c.where(status == "expiring_soon"), "certificate.expiring_soon", "warning", "certificate", "id", None, (), F.col("expiry_date"))


#: The section that a subject's certificates belong to; other subjects: 13.
SUBJECT_SECTION = {"welder": "6", "cwi": "7", "ndt_technician": "8", "torque_wrench": "13"}


@rule("certificate.expires_during_job", "certificate", "job_book", "weld", "nde_report", "torque_connection", "torque_wrench")
def expires_during(t, s):
    """Certificates that lapse before the job's end; critical where work of the subject is dated after. Work is counted by day
    before it meets the certificates, so that a busy subject makes no more rows than it has days."""
    lapsing = t["certificate"].join(_book(t, "construction_start", "construction_end"), BOOK).where("expiry_date < construction_end AND (construction_start IS NULL OR expiry_date >= construction_start)")
    wrench = t["torque_wrench"].select("id", F.col("wrench_id").alias("code"))
    c = t["torque_connection"].where("torque_date IS NOT NULL").select(BOOK, "wrench_id", "wrench_id_raw", F.col("torque_date").alias("day"))
    by_code = c.join(wrench, F.col("wrench_id_raw") == F.col("code")).where("wrench_id IS NULL OR wrench_id <> id").select(BOOK, F.col("id").alias("subject_id"), "day")
    work = [("welder", _credits(t).select(BOOK, F.col("who").alias("subject_id"), F.col("weld_date").alias("day"))), ("ndt_technician", t["nde_report"].select(BOOK, F.col("technician_id").alias("subject_id"), F.col("report_date").alias("day"))), ("torque_wrench", c.select(BOOK, F.col("wrench_id").alias("subject_id"), "day").unionByName(by_code))]
    days = reduce(DataFrame.unionByName, [w.where("subject_id IS NOT NULL AND day IS NOT NULL").withColumn("subject_type", F.lit(k)) for k, w in work]).groupBy(BOOK, "subject_type", "subject_id", "day").agg(F.count(F.lit(1)).alias("k"))
    key = [BOOK, "subject_type", "subject_id"]
    n = lapsing.join(days, key, "left").groupBy(*key, "id").agg(F.coalesce(F.sum(F.when(F.col("day") > F.col("expiry_date"), F.col("k"))), F.lit(0)).alias("n"))
    section = F.coalesce(F.create_map(*[F.lit(x) for pair in SUBJECT_SECTION.items() for x in pair])[F.col("subject_type")], F.lit("13"))
    return found(n, "certificate.expires_during_job", F.when(F.col("n") > 0, "critical").otherwise("warning"), "certificate", "id", section, (), F.col("n"))


@rule("record.future_dated", "job_book", "weld", "torque_connection", "nde_report", "torque_wrench")
def future(t, s):
    """Records dated after the book's data were closed, or after today; wrenches count in the books that used them."""
    horizon = _book(t, "data_as_of_date").select(BOOK, F.least(s.today, F.coalesce("data_as_of_date", s.today)).alias("h"))
    used = t["torque_connection"].where("wrench_id IS NOT NULL").select(BOOK, F.col("wrench_id").alias("id")).distinct().join(t["torque_wrench"], "id")
    dated = [("weld", t["weld"], "weld_date", "weld date", "12"), ("torque_connection", t["torque_connection"], "torque_date", "torque date", "14"), ("nde_report", t["nde_report"], "report_date", "report date", "10"), ("torque_wrench", used, "last_calibration_date", "calibration date", "13")]
    out = []
    for kind, df, column, label, section in dated:
        late = df.select(BOOK, "id", F.col(column).alias("d")).join(horizon, BOOK).where("d > h")
        out.append(found(late, "record.future_dated", "critical", kind, "id", section, (F.lit(kind), F.col("id"), F.lit(label)), F.col("d")))
    return reduce(DataFrame.unionByName, out)


@rule(("timeliness.late_entry", "timeliness.entered_before_work"), "assessed_entry")
def entries(t, s):
    early = F.col("verdict") == "entered_before_work"
    a = t["assessed_entry"].where("verdict IN ('late', 'entered_before_work')")
    id = F.when(early, "timeliness.entered_before_work").otherwise("timeliness.late_entry")
    return found(a, id, F.when(early, "critical").otherwise("info"), "entry", "record_id", F.col("section_number"), ("standard_id", "record_id"), F.col("days_late"))


@rule("timeliness.below_target", "assessed_entry")
def below_target(t, s):
    from . import timeliness

    rate = timeliness.rates(t["assessed_entry"], [BOOK]).where(F.col("on_time") / (F.col("on_time") + F.col("late")) * 100 < TARGET_PCT)
    escalated = timeliness.escalations(timeliness.weekly(t["assessed_entry"], [BOOK], "entered_on"), [BOOK]).select(BOOK).distinct().withColumn("e", F.lit(True))
    out = rate.join(escalated, BOOK, "left")
    return found(out, "timeliness.below_target", F.when(F.col("e"), "warning").otherwise("info"), "job_book", None, "12", (F.lit(None).cast("string"),), F.col("rate_pct"))
