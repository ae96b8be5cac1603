"""Stage gates: four-valued criteria in one long table, per book and gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..sources.shared import written
from . import completeness, reconcile, validity
from .scoring import unscaffolded

STATES = ("met", "not_met", "indeterminate", "not_applicable")


def at_least(value: Column, least: float) -> Column:
    """What is unknown is indeterminate, not a failure."""
    return F.when(value.isNull(), "indeterminate").when(value >= least, "met").otherwise("not_met")


def none_of(count: Column, loaded: Column) -> Column:
    """A register that was not loaded says nothing; a loaded one without faults is met."""
    return F.when(~F.coalesce(loaded, F.lit(False)), "indeterminate").when(F.coalesce(count, F.lit(0)) == 0, "met").otherwise("not_met")


def criterion(df: DataFrame, book: list[str], gate: str, name: str, state: Column) -> DataFrame:
    return df.select(*book, F.lit(gate).alias("gate"), F.lit(name).alias("id"), state.alias("state"))


def sustained(criteria: DataFrame, book: list[str], earlier: str, gate: str, name: str) -> DataFrame:
    """An earlier gate's criteria as one criterion of a later gate."""
    has = lambda s: F.bool_or(F.col("state") == s)
    state = F.when(has("not_met"), "not_met").when(has("indeterminate"), "indeterminate").otherwise("met")
    return criteria.where(F.col("gate") == earlier).groupBy(*book).agg(state.alias("state")).select(*book, F.lit(gate).alias("gate"), F.lit(name).alias("id"), "state")


#: The milestone that a gate is measured against, and the least completion there, where a book has no curve of its own.
MILESTONES = {
    "G0": ("gate_0_passed", 8),
    "G1": ("construction_25", 25),
    "G2": ("construction_50", 50),
    "G3": ("mechanical_completion", 85),
    "G4": ("gate_4_entry", 98),
    "G5": ("submission", 100),
}
#: Months that a calibration holds, where a book does not say.
CALIBRATION_MONTHS = 12
#: Subjects whose certificates are calibrations.
CALIBRATED = ["torque_wrench", "pressure_recorder"]
BOOK = "job_book_id"


def planned_minimum(gate: Column, milestones: Column | None = None, minimums: Column | None = None) -> Column:
    """The least completion that a gate asks for: by a book's own curve (its milestones and their minimums), or by the default where it
    has none. A curve that lacks the gate's milestone asks for nothing, NULL.
    """
    pairs = lambda i: F.create_map(*[F.lit(x) for g, m in MILESTONES.items() for x in (g, m[i])])[gate]
    if milestones is None:
        return pairs(1)
    own = F.get(minimums, F.array_position(milestones, pairs(0)).cast("int") - 1)
    return F.when(milestones.isNull(), pairs(1).cast("double")).when(F.array_contains(milestones, pairs(0)), own.cast("double"))


def _asked(df: DataFrame, **flags: Column) -> DataFrame:
    """A row's part in its book's facts: what it counts for."""
    return df.select(BOOK, *[c.alias(n) for n, c in flags.items()])


def _kind() -> Column:
    """Whether a certificate is a calibration, whose expiry may follow from its issue: by what it is of."""
    return F.when(F.col("subject_type").isin(CALIBRATED), "calibration")


def facts(t: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """One row per book with what the gates ask: its own fields and counts over its records. The rows of all tables, marked with what
    they count for, are one union and one aggregation by book, so no part of the facts is shuffled or joined on its own.

    ``t``: job_book, job_book_section, section_template (section_number, applies_to: both or a type), document, weld, welder_qualification, certificate, torque_connection, torque_wrench,
    nde_report, pressure_test, material_heat, compliance_flag, coating_inspection (job_book_id, construction_area), and roster (job_book_id,
    kind, subject_id) of who is mobilising. A book may have a calibration interval, a turnover date and areas of its own.
    A book without rows of a table has none of its records; whether the ledger of findings was loaded is ``flags_loaded``.
    """
    book = t["job_book"].withColumnRenamed("id", BOOK)
    end = F.coalesce("construction_end", "target_turnover_date")
    bounds = book.select(BOOK, F.coalesce("construction_start", as_of).alias("start"), F.coalesce(end, as_of).alias("stop"), end.alias("end"))
    intervals = book.select(BOOK, F.coalesce("calibration_interval_months", F.lit(CALIBRATION_MONTHS)).cast("int").alias("months"))
    certificates = t["certificate"].join(intervals, BOOK, "left")
    expiry = dates.effective_expiry(_kind(), F.col("issue_date"), F.col("expiry_date"), F.coalesce("months", F.lit(CALIBRATION_MONTHS)))
    applies = F.col("status") != "na"
    unread = F.col("ingestion_status").isNull() | (F.col("ingestion_status") == "not_imported")
    s = t["job_book_section"]
    held = t["document"].where("NOT is_deleted AND NOT is_superseded").select(BOOK, F.col("section_id").alias("id")).distinct().withColumn("held", F.lit(True))
    entered = [t[n].groupBy(BOOK).agg(F.count(F.lit(1)).alias("have")).withColumn("linked_record_type", F.lit(n)) for n in ("weld", "torque_connection", "material_heat", "nde_report", "pressure_test") if n in t]
    s = s.join(held, [BOOK, "id"], "left").join(reduce(DataFrame.unionByName, entered), [BOOK, "linked_record_type"], "left")
    counted = F.col("linked_record_type").isin("weld", "torque_connection", "material_heat", "nde_report", "pressure_test")
    procedure = F.col("section_number").isin("3", "4", "5", "9")
    short = (F.col("expected_count") > 0) & (F.coalesce("have", F.lit(0)) < F.col("expected_count"))
    parts = [_asked(
        s,
        n_na_without_reason=~applies & completeness.blank(F.col("na_reason")),
        n_procedures=procedure,
        n_empty_procedures=procedure & F.col("held").isNull(),
        n_applicable=applies,
        n_undated=applies & F.col("expected_by").isNull(),
        n_absent=applies & (unread | (F.col("computed_pct") <= 0)),
        n_shortfalls=applies & counted & short,
        coating=F.when(F.col("section_number") == "23", F.when(applies, "enabled").otherwise("na")),
    )]

    parts.append(_asked(unscaffolded(t["job_book"], t["section_template"], s), n_unscaffolded=F.lit(True)))

    # Who is mobilising, and whether they are covered.
    roster = t["roster"].join(bounds, BOOK)
    quals = t["welder_qualification"].groupBy(F.col("welder_id").alias("subject_id")).agg(F.bool_or(F.col("expiry_date").isNull()).alias("open"), F.max("expiry_date").alias("last"))
    welders = roster.where("kind = 'welder'").join(quals, "subject_id", "left")
    fit = F.coalesce(F.col("open") | (F.col("last") >= F.col("stop")), F.lit(False))
    parts.append(_asked(welders, n_welders=F.lit(True), n_unqualified=~fit))
    certs = certificates.select(BOOK, F.col("subject_type").alias("kind"), "subject_id", "ndt_methods", F.col("issue_date").alias("s"), expiry.alias("e"))
    others = roster.where("kind <> 'welder'").withColumn("event", F.concat_ws("|", BOOK, "kind", "subject_id"))
    others = others.join(validity.valid_on(others, certs.drop("ndt_methods"), [BOOK, "kind", "subject_id"], "event", "start", "s", "e").select("event", "valid"), "event")
    tools = t["torque_wrench"].select(F.col("id").alias("subject_id"), "cert_on_file")
    others = others.join(tools, "subject_id", "left").withColumn("ok", F.col("valid") & ((F.col("kind") != "torque_wrench") | F.coalesce("cert_on_file", F.lit(False))))
    tool = F.col("kind") == "torque_wrench"
    parts.append(_asked(others, n_inspectors=~tool, n_uncovered=~tool & ~F.col("ok"), n_wrenches=tool, n_wrench_problems=tool & ~F.col("ok")))
    unknown = t["torque_connection"].where("wrench_id IS NOT NULL").select(BOOK, F.col("wrench_id").alias("subject_id")).distinct().join(tools, "subject_id", "left_anti")
    parts.append(_asked(unknown, n_unregistered=F.lit(True)))

    # Records: heats by their exact number, examinations, tests, certificates that lapse, open findings.
    used = t["weld"].select(BOOK, F.explode("heat_numbers").alias("h"))
    sets = {"used": (used, F.col("h")), "file": (t["material_heat"].where("mtr_status = 'on_file'"), F.col("heat_number")), "known": (t["material_heat"], F.col("heat_number"))}
    heats = reconcile.membership(sets, [BOOK])
    in_used, in_file = F.col("in_used"), F.col("in_file")
    parts.append(_asked(heats, n_used_heats=in_used, n_without_mtr=in_used & ~in_file, n_orphan_mtr=in_file & ~in_used, n_heats=F.col("in_known")))
    parts.append(_asked(t["weld"].where("ndt_method IS NOT NULL"), n_examined=F.lit(True), n_unlinked=F.col("ndt_report_id").isNull()))
    tests = t["pressure_test"].where("test_date IS NOT NULL")
    c = certificates.select(BOOK, F.col("id").alias("cert"), F.col("issue_date").alias("s"), expiry.alias("e"))
    slots = tests.select(BOOK, "id", "test_date", F.explode(F.array("gauge_cert_id", "recorder_cert_id", "psv_cert_id")).alias("cert")).join(c, [BOOK, "cert"], "left")
    fits = F.col("s").isNotNull() & dates.is_within(F.col("test_date"), F.col("s"), F.col("e"))
    tests = tests.join(slots.groupBy(BOOK, "id").agg(F.bool_and(fits).alias("instruments")), [BOOK, "id"])
    open_ = F.col("result_document_id").isNull() | F.col("result").isNull()
    hold = F.col("start_pressure_psi").isNull() | F.col("end_pressure_psi").isNull() | F.col("duration_minutes").isNull()
    parts.append(_asked(tests, n_tested=F.lit(True), n_open_packs=open_, n_incomplete=open_ | hold | ~F.col("instruments")))
    lapse = t["certificate"].join(bounds, BOOK).where((F.col("expiry_date") >= as_of) & (F.col("expiry_date") < F.col("end")))
    parts.append(_asked(lapse, n_expiring=F.lit(True)))
    areas = book.select(BOOK, F.explode(F.array_distinct("construction_areas")).alias("construction_area"))
    inspected = t["coating_inspection"].select(BOOK, "construction_area", F.lit(True).alias("there")).distinct()
    coated = areas.join(inspected, [BOOK, "construction_area"], "left")
    parts.append(_asked(coated, n_areas=F.lit(True), n_uncoated=F.col("there").isNull()))
    flags = t["compliance_flag"].where("state IN ('open', 'acknowledged') AND severity IN ('critical', 'warning')")
    parts.append(_asked(flags, n_open=F.lit(True), n_not_on_time=F.col("due_at").isNull() | (F.col("due_at") < as_of)))

    # Every record of work against a certificate of its day, each distinct question asked once.
    passes = F.explode(F.array_distinct(F.array_compact(F.array(*[F.col(f"{x}_welder_id") for x in ("root", "hot", "fill", "cap")]))))
    w = t["weld"].where("weld_date IS NOT NULL").select(BOOK, F.col("id").alias("record"), passes.alias("who"), F.col("weld_date").alias("day"))
    asked = w.select("who", "day").distinct().withColumn("event", F.concat_ws("|", "who", "day"))
    q = validity.qualification_verdicts(asked, t["welder_qualification"].withColumnRenamed("welder_id", "who"), ["who"], "event", "day", "qualification_date", "expiry_date").select("who", "day", (F.col("verdict") == "qualified").alias("ok"))
    # Written, so that their size is known: there are people times days at most, and records need not be shuffled to meet them.
    spark = book.sparkSession
    welds = w.join(written(spark, q, "verdicts"), ["who", "day"]).select(BOOK, "ok")
    x = t["torque_connection"].where("torque_date IS NOT NULL AND wrench_id IS NOT NULL").select(BOOK, F.lit("torque_wrench").alias("kind"), F.col("wrench_id").alias("subject_id"), F.col("torque_date").alias("day"), F.lit(None).cast("string").alias("method"))
    n = t["nde_report"].where("technician_id IS NOT NULL").select(BOOK, F.lit("ndt_technician").alias("kind"), F.col("technician_id").alias("subject_id"), F.col("report_date").alias("day"), "method")
    # Certificates of any method are asked for as such; ``covered_days`` never pairs questions with certificates.
    key = [BOOK, "kind", "subject_id", "of", "named"]
    of = lambda method: [F.when(method.isNull(), "any").otherwise("method").alias("of"), F.coalesce(method, F.lit("")).alias("named")]
    work = x.unionByName(n).select(BOOK, "kind", "subject_id", "day", *of(F.col("method")))
    asks = F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.array_distinct(F.array_compact("ndt_methods")), F.array().cast("array<string>")))).alias("method")
    windows = certs.select(BOOK, "kind", "subject_id", "s", "e", asks).select(BOOK, "kind", "subject_id", "s", "e", *of(F.col("method")))
    covered = validity.covered_days(work.where("day IS NOT NULL").distinct(), windows, key, "day", "s", "e").where("live")
    known = work.join(written(spark, covered, "covered"), [*key, "day"], "left").join(tools.select("subject_id", F.lit(True).alias("there")), "subject_id", "left")
    rest = known.select(BOOK, (F.col("live").isNotNull() & ((F.col("kind") != "torque_wrench") | F.col("there").isNotNull())).alias("ok"))
    parts.append(_asked(welds.unionByName(rest), n_uncovered_work=~F.col("ok")))

    rows = reduce(lambda p, q: p.unionByName(q, allowMissingColumns=True), parts)
    names = [c for c in rows.columns if c.startswith("n_")]
    sums = rows.groupBy(BOOK).agg(*[F.count_if(c).alias(c) for c in names], F.max("coating").alias("coating"))
    return book.join(sums, BOOK, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in names})


def all_criteria(f: DataFrame) -> DataFrame:
    """(job_book_id, gate, id, state) of every criterion of every gate, from ``facts`` and in one pass over it. The second gate has no
    criterion of the curve where a book's own curve lacks its milestone; the first gate's is indeterminate there."""
    n = F.col
    decide = lambda ok: F.when(ok, "met").otherwise("not_met")
    unless = lambda empty, ok: F.when(empty, "indeterminate").otherwise(decide(ok))
    unknown, attested = F.lit("indeterminate"), F.lit("indeterminate")
    planned = lambda gate: planned_minimum(F.lit(gate), n("curve_milestones"), n("curve_minimums"))
    curve = lambda gate: unless(planned(gate).isNull(), n("completion_pct") >= planned(gate))
    peer = lambda least: F.when(n("peer_score").isNull(), "indeterminate").when(F.coalesce("peer_criticals", F.lit(0)) > 0, "not_met").otherwise(decide(n("peer_score") >= least))
    g1 = [
        ("g1.curve", curve("G1")), ("g1.timeliness", at_least(n("timeliness_pct"), 95)), ("g1.self_audit", unless(n("self_audits_due").isNull(), n("self_audits") >= n("self_audits_due"))), ("g1.peer_audit", peer(90)),
        ("g1.registers", decide((n("n_welders") > 0) & (n("n_wrenches") > 0) & (n("n_heats") > 0))), ("g1.heats", unless(n("n_used_heats") == 0, n("n_without_mtr") == 0)),
        ("g1.ncr", unless(~n("flags_loaded"), (n("n_open") == 0) | (n("n_not_on_time") == 0))),
    ]
    has = lambda state: F.array_contains(F.array(*[c for _, c in g1]), state)
    custodian = F.when(n("custodian_id").isNull(), "not_met").when(n("custodian_competency").isNull(), "indeterminate").otherwise(decide(n("custodian_competency") != "JB-1"))
    rows = {
        "G0": [
            ("g0.scaffolded", decide((n("n_unscaffolded") == 0) & (n("n_na_without_reason") == 0))), ("g0.custodian", custodian), ("g0.governing_docs", decide(n("has_references") & n("has_revisions") & n("governing_docs_confirmed_at").isNotNull())), ("g0.procedures_loaded", decide(n("n_empty_procedures") == 0)),
            ("g0.wpq", unless(n("n_welders") == 0, n("n_unqualified") == 0)), ("g0.inspector_creds", unless(n("n_inspectors") == 0, n("n_uncovered") == 0)), ("g0.wrench_calibration", unless((n("n_wrenches") == 0) & (n("n_unregistered") == 0), (n("n_wrench_problems") == 0) & (n("n_unregistered") == 0))),
            ("g0.expected_by", decide((n("n_undated") == 0) & (n("n_applicable") > 0))), ("g0.planned_curve", decide(n("planned_curve_agreed_at").isNotNull())),
        ],
        "G1": g1,
        "G2": [
            ("g2.gate1_sustained", F.when(has("not_met"), "not_met").when(has("indeterminate"), "indeterminate").otherwise("met")), ("g2.curve", F.when(planned("G2").isNotNull(), curve("G2"))), ("g2.iso_stage1", unknown), ("g2.pressure_closed", unless(n("n_tested") == 0, n("n_open_packs") == 0)),
            ("g2.cert_forecast", F.when(F.coalesce("construction_end", "target_turnover_date").isNull() | (n("n_expiring") > 0), "indeterminate").otherwise("met")), ("g2.peer_audit", peer(90)),
        ],
        "G3": [
            ("g3.records_entered", decide(n("n_shortfalls") == 0)), ("g3.iso_stages", unknown), ("g3.nde", unless(n("n_examined") == 0, n("n_unlinked") == 0)), ("g3.pressure", unless(n("n_tested") == 0, n("n_incomplete") == 0)),
            ("g3.heats", unless(n("n_used_heats") == 0, (n("n_without_mtr") == 0) & (n("n_orphan_mtr") == 0))), ("g3.coating", F.when(n("coating").eqNullSafe("enabled"), unless(n("n_areas") == 0, n("n_uncoated") == 0)).otherwise("not_applicable")), ("g3.backlog", attested),
        ],
        "G4": [
            ("g4.complete", decide(n("completion_pct") >= 100)), ("g4.presence", decide(n("n_absent") == 0)), ("g4.certificates", decide(n("n_uncovered_work") == 0)), ("g4.peer_audit", peer(95)), ("g4.tier3", F.when(n("tier3_verified_at").isNotNull(), "met").otherwise("indeterminate")),
            ("g4.findings", unless(~n("flags_loaded"), n("n_open") == 0)), ("g4.export", attested), ("g4.completeness_cert", F.when(n("completeness_certified_at").isNotNull(), "met").otherwise("indeterminate")),
        ],
        "G5": [("g5.acceptance", decide(n("status") == "accepted")), *[(f"g5.{x}", attested) for x in ("comments", "lessons", "metrics", "retention")]],
    }
    entries = F.array(*[F.struct(F.lit(gate).alias("gate"), F.lit(id).alias("id"), state.alias("state")) for gate, rs in rows.items() for id, state in rs])
    return f.select(BOOK, F.explode(entries).alias("c")).select(BOOK, "c.*").where("state IS NOT NULL")  # a gate without a milestone has no curve to meet


def evaluated(criteria: DataFrame, book: list[str]) -> DataFrame:
    """Counts by state; a gate would pass if nothing is unmet or undetermined."""
    counts = criteria.groupBy(*book, "gate").agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES])
    return counts.withColumn("would_pass", F.col("not_met") + F.col("indeterminate") == 0)


def history(reviews: DataFrame, book: list[str], as_of: Column) -> DataFrame:
    """The last gate passed, gates failed twice or more, and conditional passes past their date."""
    per = reviews.groupBy(*book, "gate").agg(F.count_if(F.col("outcome") == "fail").alias("f"), F.bool_or(F.col("outcome") == "pass").alias("p"), F.count_if((F.col("outcome") == "conditional") & (F.col("due") < as_of)).alias("l"))
    return per.groupBy(*book).agg(F.max(F.when(F.col("p"), F.col("gate"))).alias("current_gate"), F.count_if(F.col("f") >= 2).alias("repeat_failures"), F.sum("l").alias("lapsed"))


def decision_faults(reviews: DataFrame) -> Column:
    """What is inconsistent about a recorded decision."""
    return F.array_compact(F.array(
        F.when((F.col("outcome") == "pass") & (F.col("n_unmet") > 0) & F.col("override_note").isNull(), "passed with unmet criteria and no note"),
        F.when((F.col("outcome") != "pass") & F.coalesce(F.col("advanced"), F.lit(False)), "advanced without a pass"),
        F.when(F.col("approver_1").eqNullSafe(F.col("approver_2")), "one person approved twice"),
        F.when(F.coalesce(F.col("certified"), F.lit(False)) & (F.col("open_findings") > 0), "certified with open findings"),
    ))
