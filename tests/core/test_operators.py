"""Truth tables and edge cases on tiny tables."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from punchlist.functions import dates, keys
from punchlist.operators import completeness, gates, history, reconcile, rules, validity
from punchlist.sources import readers, sinks
from punchlist.streaming import jobs

D = dt.date


def values(spark, kind, rows, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_windows_with_missing_ends(spark):
    rows = [(D(2024, 5, 1), None, None), (D(2024, 5, 1), D(2024, 5, 1), D(2024, 5, 1)), (D(2024, 5, 1), D(2024, 5, 2), None), (D(2024, 5, 1), None, D(2024, 4, 30)), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d date, s date, e date")
    assert [r["x"] for r in df.select("i", dates.is_within(F.col("d"), F.col("s"), F.col("e")).alias("x")).orderBy("i").collect()] == [True, True, False, False, False]


def test_qualification_truth_table(spark):
    day = D(2024, 6, 1)
    before, after = D(2024, 1, 1), D(2025, 1, 1)
    cases = {
        "none": [], "covers": [(before, after)], "open end": [(before, None)], "expired": [(before, D(2024, 5, 31))], "unread, not expired": [(None, after)], "unread": [(None, None)],
        "later": [(after, None)], "unread but expired": [(None, D(2024, 5, 31))], "expired and unread": [(before, D(2024, 5, 31)), (None, None)], "expired and later": [(before, D(2024, 5, 31)), (after, None)],
    }
    want = {"none": "no_record", "covers": "qualified", "open end": "qualified", "expired": "expired", "unread, not expired": "unverifiable", "unread": "unverifiable", "later": "not_yet", "unread but expired": "expired", "expired and unread": "unverifiable", "expired and later": "not_yet"}
    events = spark.createDataFrame([(k, k, day) for k in cases], "event string, who string, day date")
    windows = spark.createDataFrame([(k, s, e) for k, ws in cases.items() for s, e in ws], "who string, s date, e date")
    got = validity.qualification_verdicts(events, windows, ["who"], "event", "day", "s", "e")
    assert {r["event"]: r["verdict"] for r in got.collect()} == want


def test_loose_dates(spark):
    rows = ["2024-02-29", "2/31/24", "12/5/69", "12/5/70", "45000", "45000.7", "0", "80001", "December 6, 2024", "May 2 2026", "6 Sept. 2024", "3rd Mar 2024", "", "x", None, "1-2-2024"]
    want = [D(2024, 2, 29), None, D(2069, 12, 5), D(1970, 12, 5), D(2023, 3, 15), D(2023, 3, 15), None, None, D(2024, 12, 6), D(2026, 5, 2), D(2024, 9, 6), D(2024, 3, 3), None, None, None, D(2024, 1, 2)]
    assert values(spark, "string", rows, dates.loose_date) == want


def test_business_days_against_a_loop(spark):
    start = D(2023, 12, 20)
    days = [start + dt.timedelta(n) for n in range(40)]
    for week, working in dates.WORK_WEEKS.items():
        for n in (0, 1, 4, 11):
            def moved(d, n=n, working=working):
                if n == 0:
                    while d.weekday() not in working:
                        d += dt.timedelta(1)
                    return d
                while n:
                    d += dt.timedelta(1)
                    n -= d.weekday() in working
                return d

            assert values(spark, "date", days, lambda c: dates.add_business_days(c, n, week)) == [moved(d) for d in days]
        between = values(spark, "date", days, lambda c: dates.business_days_between(F.lit(start), c, week))
        assert between == [sum((start + dt.timedelta(k)).weekday() in working for k in range(1, (d - start).days + 1)) for d in days]


def test_keys(spark):
    assert values(spark, "string", ["NP-002", " W12A", "74.1", "abcdef1", "0245", "", None], keys.weld_number_key) == ["2", "12", "74.1", None, "245", None, None]
    assert values(spark, "string", ["A-10 49", "--", None], keys.heat_key) == ["A1049", None, None]
    assert values(spark, "string", ["12345", "n/a", "1,250 psi", "-4.5"], keys.number_of) == [12345.0, None, 1250.0, -4.5]
    ns = uuid.UUID("6ba7b810-9dad-11d1-80b4-00c04fd430c8")
    assert values(spark, "string", ["a", "b", "c", "weld 9"], lambda c: keys.record_id(str(ns), c)) == [str(uuid.uuid5(ns, x)) for x in ("a", "b", "c", "weld 9")]
    assert values(spark, "string", ["10", "2", "S1", "19-22"], keys.collation_key) == [10, 2, 1083, 19]


def test_tolerance(spark):
    rows = [(None, 10.0, None, None), (200.0, None, 130.0, 260.0), (300.0, None, 130.0, 260.0), (0.0, 0.0, None, None), (105.0, 100.0, None, None), (115.0, 100.0, None, None), (5.0, None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, p double, l double, h double")
    ok = completeness.within_tolerance(F.col("a"), F.col("p"), F.col("l"), F.col("h"), F.lit(10))
    assert [r["x"] for r in df.select("i", ok.alias("x")).orderBy("i").collect()] == [None, True, False, True, True, False, None]


def test_typos_in_order(spark):
    unknown = spark.createDataFrame([("0284",), ("2048",), ("9",)], "u string")
    known = spark.createDataFrame([("0289", 2), ("0281", 1), ("0248", 0), ("77", 5)], "k string, o int")
    got = {r["u"]: r["suggestion"] for r in reconcile.typo_suggestions(unknown, "u", known, "k", "o").collect()}
    assert got == {"0284": "0281", "2048": "0248", "9": None}


def test_empty_sets_reconcile(spark):
    a = spark.createDataFrame([(None,), ("x",)], "k string")
    got = reconcile.membership({"a": (a, F.col("k")), "b": (a.limit(0), F.col("k"))}).collect()
    assert [(r["key"], r["in_a"], r["in_b"]) for r in got] == [("x", True, False)]


def test_ledger(spark):
    fresh, stored = spark.createDataFrame([("a",), ("b",)], "f string"), spark.createDataFrame([("b", "open"), ("c", "open"), ("d", "closed")], "f string, state string")
    assert {(r["f"], r["change"]) for r in history.merged_ledger(fresh, stored, ["f"], "state").collect()} == {("a", "new"), ("b", "unchanged"), ("c", "disappeared")}


def test_rules_over_two_books(spark):
    weld = spark.createDataFrame(
        [("A", "1", "w1", None, None, None, None, None, D(2024, 5, 1), ["H1"], "RT", None, None, "ok", "1", "Pass"), ("A", "2", None, None, None, None, None, None, D(2024, 5, 1), ["H2"], None, None, None, "ok", "2", None), ("B", "1", "w2", None, None, None, None, None, D(2030, 1, 1), [], None, None, None, "not_used", "1", None)],
        "job_book_id string, id string, welder_id string, welder_stamp string, root_welder_id string, hot_welder_id string, fill_welder_id string, cap_welder_id string, weld_date date, heat_numbers array<string>, ndt_method string, xray_number string, ndt_report_id string, status string, weld_number string, ndt_result string",
    )
    quals = spark.createDataFrame([("w1", None, None)], "welder_id string, qualification_date date, expiry_date date")
    heats = spark.createDataFrame([("A", "m1", "H1", "d", "on_file"), ("A", "m9", "H9", "d", "on_file")], "job_book_id string, id string, heat_number string, mtr_document_id string, mtr_status string")
    sections = spark.createDataFrame([("A", "10", None), ("B", "15", "not_imported")], "job_book_id string, section_number string, ingestion_status string")
    tables = {"weld": weld, "welder_qualification": quals, "material_heat": heats, "job_book_section": sections}
    got = {(r["job_book_id"], r["rule_id"], r["entity_id"], r["fingerprint"].split("|")[1]) for r in rules.findings(tables, rules.Settings("2025-01-01")).collect()}
    assert got == {("A", "welder.qualification_currency_unverifiable", "1", "1"), ("A", "weld.no_welder_stamp", "2", "2"), ("A", "weld.nde_without_report", "1", "1"), ("A", "material.heat_without_mtr", None, "H2"), ("A", "material.mtr_not_referenced", "m9", "H9")}
    unread = sections.withColumn("ingestion_status", F.lit("not_imported"))
    silent = {r["rule_id"] for r in rules.findings({**tables, "job_book_section": unread.withColumn("section_number", F.lit("15"))}, rules.Settings("2025-01-01")).collect()}
    assert not any(r.startswith("material") for r in silent) and "weld.nde_without_report" in silent
    ids = [i for r in rules.RULES for i in r.ids]
    assert len(set(ids)) == len(ids) == 53


def test_second_pass(spark):
    sections = spark.createDataFrame([("A", "x7", "7", "ready_for_review"), ("A", "x8", "8", "ready_for_review")], "job_book_id string, id string, section_number string, status string")
    found = spark.createDataFrame([("A", "7", "critical"), ("A", "7", "warning"), ("A", "8", "info"), ("A", None, "critical")], "job_book_id string, section string, severity string")
    assert [(r["entity_id"], r["section"], r["detail"]) for r in rules.ready_with_open_findings(sections, found).collect()] == [("x7", "7", "2")]


def test_gate_states(spark):
    assert values(spark, "double", [None, 10.0, 30.0], lambda c: gates.at_least(c, 25)) == ["indeterminate", "not_met", "met"]
    df = spark.createDataFrame([("pass", 2, None, False, "x", "x", True, 1), ("pass", 0, None, True, "x", "y", False, 0)], "outcome string, n_unmet int, override_note string, advanced boolean, approver_1 string, approver_2 string, certified boolean, open_findings int")
    assert [len(r["f"]) for r in df.select(gates.decision_faults(df).alias("f")).collect()] == [3, 0]


def test_cell_dump(spark, tmp_path):
    (tmp_path / "log.txt").write_text("# Sheet 1\nweld\tdate\n~3\n7\t\t5/1/24\n## formulas\nA1\t=B1\n# Two\nx\n")
    got = sorted((r["sheet"], r["row_no"], r["col_no"], r["value"]) for r in readers.cell_dump(spark, str(tmp_path)).collect())
    assert got == [("Sheet 1", 0, 0, "weld"), ("Sheet 1", 0, 1, "date"), ("Sheet 1", 4, 0, "7"), ("Sheet 1", 4, 2, "5/1/24"), ("Two", 0, 0, "x")]


def test_listing_and_hold_sheet(spark, tmp_path):
    lines = spark.createDataFrame([("C:\\x\\root\\07 - Welding\\a\\log.PDF\t 12 ",), ("no size",)], "value string")
    listing = readers.plain_listing(lines, "root")
    got = readers.listed_documents(listing, F.col("path"), F.col("bytes")).collect()
    assert [(r["section"], r["depth"], r["filename"], r["bytes"], r["mime"]) for r in got] == [("7", 2, "log.PDF", 12, "application/pdf")]
    (tmp_path / "hold.tsv").write_text("# note\nPT-1\t5/1/24\t100\t90\t60\t70\nPT-2\t\t0\t0\t\t\n")
    sheet = readers.hold_sheet(spark, str(tmp_path)).withColumn("o", readers.hold_outcome(F.col("start_pressure_psi"), F.col("end_pressure_psi"))).collect()
    assert [(r["test_identifier"], r["o"]) for r in sheet] == [("PT-1", "dropped"), ("PT-2", None)]


def test_stamps_and_rates(spark, tmp_path):
    path = str(tmp_path / "stamps")
    for pct, at in ((10.0, "2024-01-01"), (20.0, "2024-02-01")):
        sinks.stamp_scores(spark.createDataFrame([("A", "1", pct)], "job_book_id string, section string, pct double"), path, F.lit(at).cast("timestamp"))
    assert [r["pct"] for r in sinks.latest_stamp(spark.read.parquet(path), ["job_book_id", "section"], ["pct"]).collect()] == [20.0]
    weeks, out = spark.createDataFrame([("A", D(2024, 1, 1), 3, 1)], "job_book_id string, week date, on_time long, late long"), str(tmp_path / "rates")
    for _ in range(2):
        sinks.write_rates(weeks, out)
    assert spark.read.parquet(out).count() == 1


def test_capture_and_expiry(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", None), (2, "b", None)], "id long, v string, gone string")
    path = str(tmp_path / "log")
    jobs.captured(lambda _: old, ["id"], ["v", "gone"], "gone", path)(spark.createDataFrame([(1, "a", "x"), (3, "c", None)], "id long, v string, gone string"), 0)
    assert {(r["id"], r["action"]) for r in spark.read.parquet(path).collect()} == {(1, "soft_delete"), (2, "hard_delete"), (3, "create")}
    ups = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), None), (2, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1)), (3, dt.datetime(2024, 1, 2), None)], "id long, staged_at timestamp, committed_at timestamp")
    assert [r["id"] for r in jobs.expired_uploads(ups, F.lit("2024-01-02 00:00:00").cast("timestamp")).collect()] == [1]
