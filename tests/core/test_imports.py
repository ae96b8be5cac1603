"""Grids of pages, plans of flowline logs, and registers with several rows of one key."""

from datetime import date

from pyspark.sql import functions as F

from punchlist.operators import flowline, gates, grids, logs


def test_a_page_with_an_empty_heading_and_a_centred_one(spark):
    rows = [(0, 42.0, "Weld"), (0, 130.0, "Date"), (1, 40.0, "1"), (1, 80.0, "AB"), (1, 121.0, "1/2"), (2, 40.5, "2"), (2, 122.0, "1/3"), (2, 125.0, "late"), (3, 5.0, "margin"), (3, 81.0, "CD"), (4, 60.0, " ")]
    df = spark.createDataFrame([("p", *r) for r in rows], "page string, line_no int, x double, text string").repartition(3)
    got = {(r["row_no"], r["col_no"]): r["value"] for r in grids.page_grid(df, ["page"], least_x=10.0).collect()}
    assert got == {(0, 0): "Weld", (0, 2): "Date", (1, 0): "1", (1, 1): "AB", (1, 2): "1/2", (2, 0): "2", (2, 2): "1/3 late", (3, 1): "CD"}
    assert grids.page_grid(df.limit(0), ["page"]).count() == 0


def plan(spark, rows, lines, welds):
    schema = "book string, file string, sheet string, row_no int, weld_number string, passes string, root string, hot string, fill string, cap string, heat_numbers array<string>, not_used boolean"
    rows = spark.createDataFrame([("b", "f", s, i, n, p, *(p.split("/") if p else [None] * 4), h, u) for i, (s, n, p, h, u) in enumerate(rows)], schema)
    lines = spark.createDataFrame(lines, "book string, line_id string, line_code string")
    planned = flowline.planned_lines(rows, lines)
    return rows, planned, flowline.planned_welds(rows, planned, spark.createDataFrame(welds, "book string, line_id string, weld_number string"))


ROWS = [("L1", "1", "A/A/B/B", ["H1"], False), (" l1", " 2", "A/A/A/A", [], False), ("L2", "1", "", [], False), ("L2", "2", "", [], True)]


def test_a_second_flowline_import_creates_nothing(spark):
    _, planned, welds = plan(spark, ROWS, [("b", "line-1", "l1 ")], [("b", "line-1", "1")])
    lines = {r["line_key"]: (r["action"], r["line_id"], r["welds"]) for r in planned.collect()}
    assert lines["L1"] == ("match", "line-1", 2) and lines["L2"][0] == "create"
    first = {(r["line_id"], r["weld_number"].strip()): (r["action"], r["weld_id"]) for r in welds.collect()}
    assert {k: v[0] for k, v in first.items()} == {("line-1", "1"): "update", ("line-1", "2"): "create", (lines["L2"][1], "1"): "create", (lines["L2"][1], "2"): "create"}
    assert len({v[1] for v in first.values()}) == 4
    _, again, welds = plan(spark, ROWS, [("b", "line-1", "l1 "), ("b", lines["L2"][1], "L2")], [("b", line, n) for line, n in first])
    assert {r["action"] for r in again.collect()} == {"match"}
    assert {(r["line_id"], r["weld_number"].strip()): (r["action"], r["weld_id"]) for r in welds.collect()} == {k: ("update", v[1]) for k, v in first.items()}


def test_flowline_findings(spark):
    rows, *_ = plan(spark, ROWS, [("b", "line-1", "l1 ")], [("b", "x", "1")])
    welders = spark.createDataFrame([("b", "w2", "X", "a", None), ("b", "w1", "Q", "Other", ["A"]), ("c", "w3", "B", "B", None)], "book string, person_id string, initials string, full_name string, name_aliases array<string>")
    stamps = flowline.planned_stamps(rows, welders)
    assert {r["stamp"]: (r["welds"], r["welder_id"], r["action"]) for r in stamps.collect()} == {"A": (2, "w2", "match"), "B": (1, None, "unresolved")}
    got = {r["rule_id"]: (r["severity"], r["n"]) for r in flowline.flowline_findings(rows, stamps).collect()}
    assert got == {"weldlog.weld_without_stamp": ("critical", 1), "weldlog.stamp_not_in_register": ("critical", 1), "weldlog.weld_without_heat": ("warning", 2)}


def test_one_of_several_welders_with_a_stamp_is_the_smallest(spark):
    rows = spark.createDataFrame([("f", "s", 1, "1", date(2024, 1, 1), "ab", None, "low", "High Stress")], "file string, sheet string, row_no int, weld_number string, weld_date date, welder_stamp string, rejected string, workbook_tier string, tier string")
    welders = spark.createDataFrame([("w2", "AB"), ("w1", " ab ")], "id string, initials string")
    quals = spark.createDataFrame([("w1", date(2020, 1, 1), date(2023, 1, 1)), ("w2", date(2020, 1, 1), None)], "welder_id string, qualification_date date, expiry_date date")
    got = {r["rule_id"]: r["n"] for r in logs.weld_plan_findings(rows, welders, quals, F.lit(date(2025, 1, 1)), F.lit(date(2024, 6, 1))).collect()}
    assert got == {"weldlog.weld_outside_qualification": 1, "weldlog.weld_before_construction": 1, "weldlog.tier_disagreement": 1}


def test_a_books_own_curve(spark):
    df = spark.createDataFrame([(None, None), (["construction_25"], [10.0]), (["submission"], [99.0])], "m array<string>, v array<double>")
    of = lambda gate: [r[0] for r in df.select(gates.planned_minimum(F.lit(gate), F.col("m"), F.col("v"))).collect()]
    assert of("G1") == [25.0, 10.0, None] and of("G5") == [100.0, None, 99.0]
