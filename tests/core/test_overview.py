"""Overview sheets: a missing value shifts nothing, accounts are held against each other, people are imported once."""

from datetime import date

from punchlist.operators import overview

HEAD = [(1, 10, "Location Name:"), (1, 90, "PAD 3"), (2, 10, "North PIC:"), (2, 90, "Jo"), (3, 500, "Requirement- 100%"), (4, 10, "caption"), (5, 500, "visual & 10% NDE"), (9, 200, "Welds"), (9, 240, "Visuals"), (9, 430, "Failed NDT")]


def runs(spark, *lines):
    rows = [("a", n, float(x), t) for n, x, t in HEAD] + [("a", 20 + i, float(x), t) for i, line in enumerate(lines) for x, t in line]
    return spark.createDataFrame(rows, "sheet string, line_no int, x double, text string").repartition(3)


def line(*cells):
    return [(10 + 40 * i, c) for i, c in enumerate(cells)]


def test_a_missing_value_shifts_nothing(spark):
    got = {r["label"]: r for r in overview.overview_rows(runs(
        spark, line("ANN LEE", "AL", "1/2/2026", "Submitted", "1,250", "100%", "18.8%", "-", "1"), line("BO DEE", "MR LC", "Submitted", "27", "100%", "11.1%", "-", "0"), line("CY FEY", "3", "50%"), line("Stamp", "4"), line("NO COUNT", "x"),
        line("Butt Welds", "1259", "100.2%", "17.5%", "4", "2"), line("Project Totals", "1256", "100%", "17%", "-", "2"), [(600, "Di Inspect"), (700, "rt")],
    )).collect()}
    assert set(got) == {"ANN LEE", "BO DEE", "CY FEY", "Butt Welds", "Project Totals", "Di Inspect"}
    pick = lambda n: tuple(got[n][c] for c in ("role", "stamp", "wpq_expires", "weld_count", "ndt_pct", "failed_visuals", "failed_ndt"))
    assert pick("ANN LEE") == ("welder", "AL", date(2026, 1, 2), 1250, 18.8, None, 1)
    assert pick("BO DEE") == ("welder", "MR LC", None, 27, 11.1, None, 0)
    assert pick("CY FEY") == ("welder", "", None, 3, None, None, 3)
    assert pick("Butt Welds") == ("joint_type", None, None, 1259, 17.5, 4, 2)
    assert (got["Di Inspect"]["qualification"], got["Di Inspect"]["submitted"]) == ("RT", False)


def test_a_sheet_against_itself(spark):
    r = runs(
        spark, line("ANN LEE", "AL", "1/2/2025", "Submitted", "1229", "100%", "18.8%", "-", "1"), line("BO DEE", "MR LC", "Submitted", "27", "100%", "11.1%", "-", "0"),
        line("Butt Welds", "1248", "100.2%", "17.5%", "-", "2"), line("Socket Welds", "11", "100%", "9.1%", "-", "0"), line("Project Totals", "1256", "100%", "17%", "-", "2"), [(600, "Di Inspect"), (700, "CWI")],
    )
    books = spark.createDataFrame([("a", date(2025, 6, 30), "South Oil")], "sheet string, construction_end date, recorded_operator string")
    rows, heads = overview.overview_rows(r), overview.overview_headers(r)
    got = {(x["rule_id"].split(".")[1], x["subject"]): x["amount"] for x in overview.overview_findings(rows, heads, books).collect()}
    assert got == {
        ("rollups_disagree", "Project Totals"): 3, ("coverage_above_100", "Butt Welds"): 2, ("welder_without_wpq_expiry", "BO DEE (MR LC)"): 27, ("combined_stamp", "BO DEE (MR LC)"): 27, ("wpq_expires_in_window", "ANN LEE (AL)"): 1229,
        ("nde_below_requirement", "Socket Welds"): 1, ("operator_branding_stale", "North PIC"): None, ("inspector_documentation_missing", "Di Inspect"): None,
    }
    unknown = spark.createDataFrame([("a", None, "north energy")], books.schema)
    quiet = {x["rule_id"] for x in overview.overview_findings(rows, heads, unknown).collect()}
    assert not quiet & {"overview.operator_branding_stale", "overview.wpq_expires_in_window"}


def test_people_of_one_batch_are_each_others_match(spark):
    schema = "book string, row_id string, stamp string, name string, wpq_expires date"
    chain = [("b", f"r{i}", f"S{i // 2}", f"Name {(i + 1) // 2}", date(2026, 1, 1) if i == 0 else None) for i in range(9)]  # each row shares a stamp or a name with the next
    rows = spark.createDataFrame([*chain, ("b", "x1", "kt ", "Keith", None), ("b", "x2", "", "No Stamp", None), ("b", "x3", "A & B", "Two", None), ("c", "y1", "S0", "Name 0", None), ("c", "y2", "Z", "old  NAME", None)], schema).repartition(4)
    register = spark.createDataFrame([("b", "w1", "KT", "K. Taylor", None), ("c", "w2", "OX", "Someone", ["Old Name"])], "book string, person_id string, initials string, full_name string, name_aliases array<string>")
    plan = overview.people_plan(rows, register)
    got = {(r["book"], r["row_id"]): (r["action"], r["matched_by"], r["person_id"]) for r in plan.collect()}
    assert all(got["b", f"r{i}"] == (("create", None, "r0") if i == 0 else ("match", "batch", "r0")) for i in range(9))
    assert got["b", "x1"] == ("match", "stamp", "w1") and got["b", "x2"][0] == got["b", "x3"][0] == "skip"
    assert got["c", "y1"] == ("create", None, "y1") and got["c", "y2"] == ("match", "alias", "w2")
    quals = overview.qualifications_of(plan).collect()
    assert [(q["person_id"], q["qualification_date"], q["expiry_date"]) for q in quals] == [("r0", None, date(2026, 1, 1))]
    again = overview.people_plan(rows, register.unionByName(overview.entries_of(plan)))
    assert {r["action"] for r in again.collect()} == {"match", "skip"}
    assert overview.people_plan(rows.limit(0), register).count() == 0
