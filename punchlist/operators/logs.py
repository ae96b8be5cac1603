"""Logs of welds, torque and pressure tests: cells become typed rows with their issues, whatever the columns are called.

Every function is keyed by (file, sheet), so any number of logs is read in one job. A row that cannot be taken says why in
``rejected``; what is taken but doubtful is in ``issues``, as ``severity:code``. Faults of a whole log are rows of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import engineering
from ..functions.dates import loose_date
from ..functions.keys import four_passes, header_key, joint_type, method_of, number_of, pass_fail, split_list, tool_key, torque_range, yes_no
from .ingest import SHEET, typed_rows
from .reconcile import typo_suggestions

#: What columns are called, by kind of log.
FACILITY_WELD = {
    "weld_number": ["weld number", "weld #", "weld no", "weld id", "weld"], "weld_date": ["date", "weld date"], "welder_stamp": ["welder", "welder stamp", "welder id", "stamp", "welder initials"], "joint_type": ["joint type", "type", "weld type"],
    "construction_area": ["area", "construction area", "const area", "area #"], "equipment_tag": ["equipment tag", "tag", "equipment"], "isometric_number": ["iso", "iso number", "iso #", "isometric", "isometric number", "line number", "line #"],
    "pipe_size_schedule": ["pipe size", "pipe size/schedule", "size/schedule", "pipe size and schedule", "size", "pipe size (in)", "schedule", "pipe schedule"], "pipe_grade": ["grade", "pipe grade", "material grade"], "design_pressure_psi": ["design pressure", "design pressure (psi)", "design psi", "pressure", "mawp"],
    "cwi_initials": ["cwi", "cwi initials", "inspector"], "cwi_visual_result": ["visual", "visual result", "cwi visual", "visual inspection"], "visual_inspection_date": ["visual date", "inspection date"], "ndt_method": ["ndt", "ndt method", "nde method", "method", "ndt type"],
    "ndt_ticket_number": ["ndt ticket", "ticket", "ticket number", "ndt ticket #", "report #"], "ndt_result": ["ndt result", "nde result", "result"], "pressure_test_ref": ["pressure test", "test #", "pressure test #", "hydro test"],
    "workbook_pct_smys": ["% smys", "percent smys", "% of smys", "smys %"], "workbook_tier": ["required inspection", "inspection requirement", "required inspection tier", "tier"],
}
FLOWLINE_WELD = {
    "weld_number": ["weld number", "weld no", "weld #"], "weld_date": ["date", "weld date"], "passes": ["welder", "welder id", "welders", "welder root/hot/fill/cap"], "joint_type": ["joint type", "type"], "component_description": ["description", "component", "part description"], "part_length": ["length", "part length"],
    "heat_numbers": ["heat number", "heat numbers", "heat #"], "cwi_initials": ["cwi", "cwi initials"], "cwi_visual_result": ["visual", "visual result", "cwi visual"], "visual_inspection_date": ["visual date"], "ndt_company": ["ndt company", "ndt"], "xray_number": ["x-ray", "xray", "x-ray number"],
    "ndt_ticket_number": ["ticket", "ticket number"], "ndt_method": ["method", "ndt method"], "ndt_result": ["ndt result", "result"], "comments": ["comments", "notes"],
}
FACILITY_TORQUE = {
    "iso_flange_number": ["iso flange #", "iso flange number", "flange #"], "iso_number": ["iso number", "iso #"], "flange_pipe_size": ["flange pipe size (in)", "flange pipe size", "pipe size"], "bolt_diameter": ["bolt diameter (in)", "bolt diameter"], "bolt_count": ["# of bolts", "number of bolts"],
    "required_torque": ["required torque (ft-lbs)", "required torque"], "actual_torque": ["actual torque (ft-lbs)", "actual torque"], "wrench_id_raw": ["wrench id #", "wrench id"], "torque_date": ["torque date"], "employee_initials": ["employee initials"], "inspection_date": ["inspection date"], "inspector_initials": ["inspector initials"],
}
FLOWLINE_TORQUE = {
    "iso_flange_number": ["iso flange number", "iso/flange number", "flange number", "flange #"], "iso_number": ["iso number", "iso #", "iso"], "flange_pipe_size": ["flange pipe size", "pipe size", "size"], "bolt_diameter": ["bolt diameter", "bolt dia"], "bolt_count": ["bolt count", "number of bolts", "# of bolts"],
    "required_torque": ["required torque", "required torque (ft-lb)", "req torque"], "actual_torque": ["actual torque", "actual torque (ft-lb)", "act torque"], "wrench_id_raw": ["wrench id", "torque wrench", "wrench", "wrench #"], "cp_test_on_flange": ["cp test on flange", "cp test"], "torque_date": ["torque date", "date"],
    "employee_initials": ["employee initials", "employee"], "inspection_date": ["inspection date", "inspected"], "inspector_initials": ["inspector initials", "inspector"],
}
PRESSURE_HOLD = {
    "test_identifier": ["test", "test no", "test number", "test id", "test identifier", "pressure test", "hydro test", "pt"], "test_date": ["date", "test date", "date tested"], "duration_minutes": ["hold minutes", "hold time", "duration", "duration minutes", "minutes", "hold", "time minutes", "hold duration"],
    "start_pressure_psi": ["start psi", "starting pressure", "start pressure", "press start", "initial pressure", "start"], "end_pressure_psi": ["end psi", "ending pressure", "end pressure", "press end", "final pressure", "end"], "ambient_temp_f": ["temp f", "temperature", "temp", "ambient temp", "ambient temperature", "ambient"],
}
#: A sheet is a log if its header knows so many fields; and how far a stated share of yield strength may be off.
LEAST_FIELDS, SMYS_TOLERANCE = 4, 5e-5


def _text(name: str) -> Column:
    return F.nullif(F.trim(name), F.lit(""))


def _issues(*found: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(there, F.lit(code)) for code, there in found]))


def _unread(name: str, value: Column) -> Column:
    return _text(name).isNotNull() & value.isNull()


def facility_welds(cells: DataFrame, headers: DataFrame, default_pressure: float | None = None, bands: list | None = None) -> DataFrame:
    """The rows of facility weld logs. Of rows with one number the first is taken; a date that cannot be read rejects its row.

    The share of yield strength is computed anew and held against what the workbook says.
    """
    raw = typed_rows(cells, headers, list(FACILITY_WELD)).where(_text("weld_number").isNotNull()).withColumn("weld_number", F.trim("weld_number"))
    nth = F.row_number().over(Window.partitionBy("weld_number", *SHEET).orderBy("row_no"))
    day, method, result, ticket, stamp = loose_date(F.col("weld_date")), method_of(F.col("ndt_method")), pass_fail(F.col("ndt_result"), ("yes",)), _text("ndt_ticket_number"), _text("welder_stamp")
    typed = raw.select(
        *SHEET, "row_no", "weld_number", day.alias("weld_date"), stamp.alias("welder_stamp"), joint_type(F.col("joint_type")).alias("joint_type"), *[_text(c).alias(c) for c in ("construction_area", "equipment_tag", "isometric_number", "pipe_size_schedule", "pipe_grade", "cwi_initials", "pressure_test_ref", "workbook_tier")],
        F.coalesce(number_of(F.col("design_pressure_psi")), F.lit(default_pressure).cast("double")).alias("design_pressure_psi"), pass_fail(F.col("cwi_visual_result"), ("yes",)).alias("cwi_visual_result"), loose_date(F.col("visual_inspection_date")).alias("visual_inspection_date"),
        method.alias("ndt_method"), ticket.alias("ndt_ticket_number"), result.alias("ndt_result"), number_of(F.col("workbook_pct_smys")).alias("workbook_pct_smys"),
        F.when(nth > 1, "duplicate weld number").when(_unread("weld_date", day), "unreadable date").alias("rejected"),
    )
    out = engineering.with_stress(typed, "pipe_size_schedule", "pipe_grade", F.col("design_pressure_psi"), bands)
    off = F.abs(F.col("workbook_pct_smys") - F.col("pct_smys")) > SMYS_TOLERANCE
    found = _issues(
        ("warning:no welder stamp", F.col("welder_stamp").isNull()), ("warning:stress not computable", F.col("uncomputable_reason").isNotNull()), ("warning:stress differs", off),
        ("warning:tier differs", header_key(F.col("workbook_tier")) != header_key(F.col("tier"))), ("warning:examination incomplete", F.col("ndt_method").isNotNull() & (F.col("ndt_ticket_number").isNull() | F.col("ndt_result").isNull())),
    )
    status = F.when(F.col("ndt_result").isNotNull(), "ndt_complete").when(F.col("cwi_visual_result").isNotNull(), "visual_complete").otherwise("welded")
    return out.withColumn("issues", F.when(F.col("rejected").isNull(), found).otherwise(F.array(F.concat(F.lit("error:"), "rejected")))).withColumn("status", status)


def flowline_welds(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """The rows of flowline weld logs, one sheet a line: four passes in one cell, heats as a list. Numbers repeat within a sheet
    only by mistake."""
    raw = typed_rows(cells, headers, list(FLOWLINE_WELD)).where(_text("weld_number").isNotNull()).withColumn("weld_number", F.trim("weld_number"))
    nth = F.row_number().over(Window.partitionBy("weld_number", *SHEET).orderBy("row_no"))
    day, passes = loose_date(F.col("weld_date")), four_passes(F.col("passes"))
    typed = raw.select(
        *SHEET, "row_no", "weld_number", day.alias("weld_date"), *[F.get(passes, F.lit(i)).alias(p) for i, p in enumerate(("root", "hot", "fill", "cap"))], joint_type(F.col("joint_type")).alias("joint_type"), number_of(F.col("part_length"), percents=False).alias("part_length"), split_list(F.col("heat_numbers")).alias("heat_numbers"),
        *[_text(c).alias(c) for c in ("passes", "component_description", "cwi_initials", "ndt_company", "xray_number", "ndt_ticket_number", "comments")], pass_fail(F.col("cwi_visual_result")).alias("cwi_visual_result"), loose_date(F.col("visual_inspection_date")).alias("visual_inspection_date"), method_of(F.col("ndt_method")).alias("ndt_method"), pass_fail(F.col("ndt_result")).alias("ndt_result"),
        F.when(nth > 1, "duplicate weld number").when(_unread("weld_date", day), "unreadable date").alias("rejected"),
    )
    found = _issues(("warning:passes are not four", F.col("passes").isNotNull() & F.col("root").isNull() & F.col("cap").isNull()))
    return typed.withColumn("issues", F.when(F.col("rejected").isNull(), found).otherwise(F.array(F.concat(F.lit("error:"), "rejected"))))


def torque_rows(cells: DataFrame, headers: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """The rows of torque logs of either kind. A letter O in a wrench's number is a zero; a row without a wrench, or whose date
    cannot be read, is rejected."""
    fields = list(names)
    raw = typed_rows(cells, headers, fields).where(_text("iso_flange_number").isNotNull())
    day, inspected, wrench = loose_date(F.col("torque_date")), loose_date(F.col("inspection_date")), tool_key(F.translate("wrench_id_raw", "oO", "00"))
    range_, actual, inspector = torque_range(F.col("required_torque")), number_of(F.col("actual_torque"), percents=False), _text("inspector_initials")
    typed = raw.select(
        *SHEET, "row_no", F.trim("iso_flange_number").alias("iso_flange_number"), *[_text(c).alias(c) for c in ("iso_number", "flange_pipe_size", "bolt_diameter", "employee_initials")], number_of(F.col("bolt_count"), percents=False).alias("bolt_count"), range_["least"].alias("required_min"), range_["most"].alias("required_max"),
        actual.alias("actual"), wrench.alias("wrench_id_raw"), day.alias("torque_date"), inspected.alias("inspection_date"), inspector.alias("inspector_initials"), (yes_no(F.col("cp_test_on_flange")) if "cp_test_on_flange" in fields else F.lit(False)).alias("cp_test_on_flange"),
        F.when(_unread("torque_date", day), "unreadable date").when(wrench.isNull(), "no wrench").alias("rejected"), _unread("required_torque", range_["least"]).alias("_r"), _unread("inspection_date", inspected).alias("_i"),
    )
    found = _issues(
        ("warning:unreadable requirement", F.col("_r")), ("warning:no actual torque", F.col("actual").isNull()), ("warning:outside the range", ~F.col("actual").between(F.col("required_min"), F.col("required_max"))), ("warning:unreadable inspection date", F.col("_i")),
        ("warning:inspection without inspector", F.col("inspection_date").isNotNull() & F.col("inspector_initials").isNull()),
    )
    return typed.withColumn("issues", F.when(F.col("rejected").isNull(), found).otherwise(F.array(F.concat(F.lit("error:"), "rejected")))).withColumn("undated_inspection", F.col("_i")).drop("_r", "_i")


def roster(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(file, sheet, wrench_id, calibrated, claimed): the block above the header whose first cells are a place and a wrench."""
    above = cells.join(headers.select(*SHEET, "header_row"), SHEET).where(F.col("row_no") < F.col("header_row"))
    first = F.col("col_no") == 0
    rest = lambda c: F.min_by(c, F.when(~first & c.isNotNull(), F.col("col_no")))
    claim = F.when(F.trim("value").rlike("(?i)^(y|yes|n|no)$"), yes_no(F.col("value")))
    rows = above.groupBy(*SHEET, "row_no").agg(F.max(F.when(first, F.trim("value"))).alias("label"), rest(loose_date(F.col("value"))).alias("calibrated"), rest(claim).alias("claimed"))
    code = F.regexp_extract("label", r"(?i)^[0-9]+\s+([0-9O]{3,6})\s*(\(.*\))?\s*$", 1)
    return rows.where(code != "").select(*SHEET, tool_key(F.translate(code, "oO", "00")).alias("wrench_id"), "calibrated", F.coalesce("claimed", F.lit(False)).alias("claimed"))


def header_totals(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(file, sheet, total, inspected): the numbers that stand right of their labels above the header."""
    above = cells.join(headers.select(*SHEET, "header_row"), SHEET).where((F.col("row_no") < F.col("header_row")) & _text("value").isNotNull())
    nxt = F.lead("value").over(Window.partitionBy(*SHEET, "row_no").orderBy("col_no"))
    label = header_key(F.col("value"))
    kind = F.when(label == "total flanges", "total").when(label.startswith("# of flanges inspected"), "inspected")
    found = above.withColumn("next", number_of(nxt, percents=False)).withColumn("kind", kind)
    return found.groupBy(*SHEET).agg(*[F.max(F.when(F.col("kind") == k, F.col("next"))).alias(k) for k in ("total", "inspected")])


def torque_log_issues(rows: DataFrame, roster_: DataFrame, totals: DataFrame) -> DataFrame:
    """(file, sheet, issue, subject, n): what is wrong with whole torque logs: flanges on several rows (an error under one
    isometric), inspections without a date, totals that are stale, and wrenches that the roster lacks, with a likely meant one."""
    taken = rows.where("rejected IS NULL")
    flange = F.upper(F.trim("iso_flange_number"))
    again = taken.groupBy(*SHEET, flange.alias("subject")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.upper(F.coalesce("iso_number", F.lit("")))).alias("isos")).where("n > 1")
    parts = [again.select(*SHEET, F.when(F.col("isos") == F.col("n"), "warning:flange on several isometrics").otherwise("error:flange entered twice").alias("issue"), "subject", "n")]
    none = F.lit(None).cast("string")
    per = taken.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("rows"), F.count("inspection_date").alias("dated"), F.count_if("undated_inspection").alias("undated")).join(totals, SHEET, "left")
    faults = F.array_compact(F.array(
        F.when(F.col("undated") > 0, F.struct(F.lit("info:inspections without a date").alias("issue"), F.col("undated").alias("n"))),
        F.when(F.col("inspected") != F.col("dated"), F.struct(F.lit("info:inspected total is stale").alias("issue"), F.col("inspected").cast("long").alias("n"))),
        F.when(F.col("total") != F.col("rows"), F.struct(F.lit("info:flange total differs").alias("issue"), F.col("total").cast("long").alias("n"))),
    ))
    parts.append(per.select(*SHEET, F.explode(faults).alias("f")).select(*SHEET, "f.issue", none.alias("subject"), "f.n"))
    absent = taken.groupBy(*SHEET, F.col("wrench_id_raw").alias("subject")).agg(F.count(F.lit(1)).alias("n")).join(roster_.withColumnRenamed("wrench_id", "subject").select(*SHEET, "subject").distinct(), [*SHEET, "subject"], "left_anti")
    parts.append(absent.select(*SHEET, F.lit("warning:wrench not on the roster").alias("issue"), "subject", "n"))
    return reduce(DataFrame.unionByName, parts)


def likely_wrenches(absent: DataFrame, roster_: DataFrame) -> DataFrame:
    """For wrenches that a roster lacks, the rostered one that is most likely meant."""
    known = roster_.groupBy("wrench_id").agg(F.min("wrench_id").alias("order"))
    return typo_suggestions(absent.select(F.col("subject").alias("u")), "u", known, "wrench_id", "order")


def pressure_rows(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """The rows of hold sheets. A row whose date, minutes and pressures are all missing or zero is a numbered blank, not a test."""
    raw = typed_rows(cells, headers, list(PRESSURE_HOLD))
    day = loose_date(F.col("test_date"))
    numbers = {c: number_of(F.col(c), percents=False) for c in ("duration_minutes", "start_pressure_psi", "end_pressure_psi", "ambient_temp_f")}
    typed = raw.select(*SHEET, "row_no", F.coalesce(_text("test_identifier"), F.concat(F.lit("Row "), F.col("row_no") + 1)).alias("test_identifier"), day.alias("test_date"), *[n.alias(c) for c, n in numbers.items()], _issues(("warning:unreadable date", _unread("test_date", day))).alias("issues"), (_text("test_identifier").isNull() & _text("test_date").isNull()).alias("_bare"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(0.0)) == 0
    gone = F.col("_bare") & F.col("start_pressure_psi").isNull() & F.col("end_pressure_psi").isNull() & F.col("duration_minutes").isNull()
    empty = F.col("test_date").isNull() & blank("duration_minutes") & blank("start_pressure_psi") & blank("end_pressure_psi")
    return typed.where(~gone).withColumn("empty", empty).drop("_bare")


def pressure_plan(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Per sheet: tests to create and update (by the identifier, in either case), undated ones, drops of pressure, and blanks."""
    there = existing.select(F.upper(F.trim("test_identifier")).alias("_k")).distinct().withColumn("_e", F.lit(True))
    tests = rows.withColumn("_k", F.upper(F.trim("test_identifier"))).join(there, "_k", "left")
    real, known = ~F.col("empty"), F.coalesce("_e", F.lit(False))
    return tests.groupBy(*SHEET).agg(
        F.count_if(real & ~known).alias("creates"), F.count_if(real & known).alias("updates"), F.count_if(real & F.col("test_date").isNull()).alias("undated"), F.count_if(real & (F.col("end_pressure_psi") < F.col("start_pressure_psi"))).alias("dropped"), F.count_if("empty").alias("blanks"),
    )


def weld_plan_findings(rows: DataFrame, welders: DataFrame, qualifications: DataFrame, horizon: Column, begins: Column | None = None) -> DataFrame:
    """(file, sheet, rule_id, severity, n): what committing a weld log would bring in. ``welders`` (id, initials); of several with one stamp
    the smallest id counts. ``horizon`` and ``begins``: the days that work ends and begins, where they are known."""
    from . import validity

    taken = rows.where("rejected IS NULL").withColumn("_k", F.upper("welder_stamp"))
    known = taken.join(welders.groupBy(F.upper(F.trim("initials")).alias("_k")).agg(F.min("id").alias("who")), "_k", "left")
    days = known.where("who IS NOT NULL AND weld_date IS NOT NULL").select("who", "weld_date").distinct().withColumn("event", F.concat_ws("|", "who", "weld_date"))
    v = validity.qualification_verdicts(days, qualifications.withColumnRenamed("welder_id", "who"), ["who"], "event", "weld_date", "qualification_date", "expiry_date").select("who", "weld_date", "verdict")
    judged = known.join(v, ["who", "weld_date"], "left")
    stamp = F.col("welder_stamp")
    counts = {
        ("weldlog.weld_without_stamp", "critical"): F.count_if(stamp.isNull()), ("weldlog.stamp_not_in_register", "critical"): F.count_distinct(F.when(stamp.isNotNull() & F.col("who").isNull(), stamp)),
        ("weldlog.weld_outside_qualification", "critical"): F.count_if(F.col("verdict").isin("expired", "not_yet", "no_record")), ("weldlog.qualification_currency_unverifiable", "warning"): F.count_distinct(F.when(F.col("verdict") == "unverifiable", stamp)),
        ("weldlog.weld_dated_after_log", "critical"): F.count_if(F.col("weld_date") > horizon),
        ("weldlog.weld_before_construction", "warning"): F.count_if(F.col("weld_date") < (begins if begins is not None else F.lit(None).cast("date"))),
        ("weldlog.tier_disagreement", "warning"): F.count_if(header_key(F.col("workbook_tier")) != header_key(F.col("tier"))),
    }
    per = judged.groupBy(*SHEET).agg(*[c.alias(id) for (id, _), c in counts.items()])
    entries = F.array(*[F.struct(F.lit(id).alias("rule_id"), F.lit(s).alias("severity"), F.col(f"`{id}`").alias("n")) for id, s in counts])
    return per.select(*SHEET, F.explode(entries).alias("f")).select(*SHEET, "f.*").where("n > 0")
