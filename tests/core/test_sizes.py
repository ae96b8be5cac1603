"""Plans and jobs that have to hold on large tables: what is broadcast, what a task holds, how often rows are written."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from punchlist import registry
from punchlist.operators import evidence, linking, notify, overview, pairs, papers, reconcile, validity

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(spark, df, node, metric):
    """The most rows that any such node of ``df`` puts out, or writes, when it runs."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        top = df._jdf.queryExecution().executedPlan()
        df._jdf.queryExecution().toRdd().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    most, left = 0, [top]
    while left:
        one = left.pop()
        if node in one.nodeName() and one.metrics().contains(metric):
            most = max(most, one.metrics().get(metric).get().value())
        left += [one.children().apply(i) for i in range(one.children().size())]
    return most


def joined(spark, df):
    return rows(spark, df, "Join", "numOutputRows")


def shuffled(spark, df):
    return rows(spark, df, "Exchange", "shuffleRecordsWritten")


@given
@pytest.mark.parametrize("name", ["a30_torque_log_issues", "a36_pressure_plan", "i10_torque_plan", "i3_facility_welds", "i5_likely_wrenches", "i5_torque_rows", "i6_flowline_torque", "i7_pressure_rows", "i8_plan_findings", "i9_flowline_findings"])
def test_cells_of_logs_are_never_broadcast(spark, name):
    """Cells stand left of the names and of the headers."""
    cells_left = [line for line in plan(registry.queries()[name](spark, SF)).splitlines() if "BroadcastHashJoin" in line and "BuildLeft" in line and ("name_key" in line or "col_no" in line or "header_row" in line)]
    assert cells_left == []


def test_words_of_a_long_line_are_split_once(spark):
    """Split anew for every word, this line took minutes."""
    line = "1 " + " ".join(f"FW-{i % 7} word" for i in range(20_000))
    start = time.monotonic()
    rows = papers.report_rows(spark.createDataFrame([("r", 0, line)], "report_id string, line_no int, text string")).collect()
    assert [sorted(r["candidates"]) for r in rows] == [[f"FW-{i}" for i in range(7)]]
    assert time.monotonic() - start < 30


def test_a_name_of_many_people_makes_one_row(spark):
    people = spark.range(2000).selectExpr("id", "'S' || id % 2 AS short", "'S1' AS long")
    asked = spark.range(300).selectExpr("id AS o", "'S' || id % 4 AS name")
    names = [F.col("short"), F.col("long")]
    out = reconcile.resolve(asked, "o", F.col("name"), people, "id", names)
    assert joined(spark, out) <= 300
    assert {(r["o"] % 4, r["resolved"], r["rank"]) for r in out.collect()} == {(0, 0, 0), (1, 1, 0), (2, None, None), (3, None, None)}
    one = spark.createDataFrame([(1, "S0", "S1"), (2, "S1", "S1"), (3, "S2", "S0"), (4, "S2", None)], "id long, short string, long string")
    sole = reconcile.resolve(asked.where("o < 4"), "o", F.col("name"), one, "id", names, ambiguous_is_null=True)
    assert sorted(tuple(r) for r in sole.collect()) == [(0, 1, 0), (1, 2, 0), (2, None, None), (3, None, None)]


def test_a_code_that_a_register_repeats_is_compared_once(spark):
    known = spark.range(3000).selectExpr("'12' || id % 3 || '4' AS tool", "id AS ord")
    asked = spark.createDataFrame([("1294",), ("2104",), ("9999",), ("1204",)], "code string")
    out = reconcile.typo_suggestions(asked, "code", known, "tool", "ord")
    assert joined(spark, out) <= 20
    assert {tuple(r) for r in out.collect()} == {("1294", "1204"), ("2104", "1204"), ("9999", None), ("1204", "1214")}


def test_certificates_never_meet_single_connections(spark):
    """Against every certificate with every connection; two wrenches, one of the code as written alone."""
    import random

    rng, d0 = random.Random(5), dt.date(2024, 1, 1)
    some = lambda n, none=0.1: None if rng.random() < none else d0 + dt.timedelta(days=rng.randrange(n))
    wrenches = [("t1", "B1", d0 + dt.timedelta(days=20), d0 + dt.timedelta(days=60), True), ("t2", "B2", d0 + dt.timedelta(days=30), None, True), ("t3", "B3", d0, d0, False), ("t4", "B4", None, d0, True), ("t5", "B5", d0 + dt.timedelta(days=50), d0 + dt.timedelta(days=10), None)]
    codes = [w[1] for w in wrenches] + ["B9"]
    own = {w[1]: w for w in wrenches}
    cs = [(f"c{i}", rng.choice(["t1", "t2", "t4", None]), rng.choice([*codes, "other", None]), some(90)) for i in range(600)]
    ps = []
    for i in range(500):
        code, d, kind = rng.choice(codes), some(90), rng.choice(["calibration", "calibration", "failed", "unread", "superseded"])
        due = None if d is None or rng.random() < 0.2 else d + dt.timedelta(days=rng.randrange(60))
        kind = "unread" if kind == "calibration" and d is None else kind
        ps.append((f"f{i}", code, "matched" if code in own else "new_wrench", kind, kind != "superseded", d, due, own[code][0] if code in own else None))

    def verdict(start, end, day):
        return "undated" if day is None else "early" if day < start else "expired" if end is not None and day > end else "valid"

    want = {}
    for f, code, _, kind, writable, d, due, id in ps:
        met = [c for c in cs if c[2] == code or (id is not None and c[1] == id and c[2] != code)]
        _, _, s, e, on_file = own.get(code, (None, None, None, None, None))
        resolved = exposed = 0
        for c in met:
            was = verdict(s, e, c[3]) if on_file and s else "other"
            now = verdict(d, due, c[3]) if d else "unread"
            changes = writable and kind == "calibration" and was != now
            resolved += changes and now == "valid"
            exposed += (changes and now in ("early", "expired")) or (writable and kind == "failed" and c[3] is not None)
        if met:
            want[f] = (len(met), resolved, exposed)
    plan_of = spark.createDataFrame(ps, "file string, wrench_id string, match string, disposition string, writable boolean, date_calibrated date, due date, matched_id string")
    out = linking.plan_effects(plan_of, spark.createDataFrame(wrenches, "id string, wrench_id string, last_calibration_date date, calibration_due_date date, cert_on_file boolean"), spark.createDataFrame(cs, "id string, wrench_id string, wrench_id_raw string, torque_date date"))
    assert joined(spark, out) <= 500
    assert {r["file"]: (r["connections"], r["resolved"], r["exposed"]) for r in out.collect()} == want


def test_pairs_of_notes_are_not_shuffled(spark):
    """Only the notes that come twice may need it."""
    notes = spark.createDataFrame([(1, 1, 7, "info"), (2, 1, 8, "warning"), (3, 1, 7, "info"), (3, 2, 7, "warning"), (3, 2, 7, "warning"), (4, None, 7, "warning"), (5, 1, None, None)], "note long, book int, author long, severity string")
    people = spark.createDataFrame([(1, 7, "custodian"), (1, 7, "assignee"), (1, 8, "assignee"), (2, 7, "custodian"), (2, 9, "assignee"), (2, 9, "assignee"), (1, 9, "reader"), (None, 9, "custodian"), (1, None, "custodian")], "book int, person long, role string")
    out = notify.fan_out(notes, people, "note", "book", "author", "person", "role", "severity")
    assert sorted(out.collect(), key=repr) == sorted([(1, None), (2, 7), (2, None), (3, None), (3, 9), (5, 7)], key=repr)
    many = spark.range(400).selectExpr("id AS note", "1 AS book", "-1L AS author", "'warning' AS severity")
    all_of = spark.range(300).selectExpr("1 AS book", "id AS person", "'custodian' AS role")
    wide = notify.fan_out(many, all_of, "note", "book", "author", "person", "role", "severity")
    assert shuffled(spark, wide) <= 2000 and wide.count() == 120_000


def test_pairs_of_notes_are_written_in_runs(spark, tmp_path):
    """The audience of a note is written as the one before it, though notes of all books come in turn."""
    notes = spark.range(6000).selectExpr("id * 7919 % 6000 AS note", "CAST(id % 8 AS INT) AS book", "id % 100 AS author", "IF(id % 5 = 0, 'info', 'warning') AS severity")
    people = spark.range(2000).selectExpr("CAST(id % 8 AS INT) AS book", "id * 7919 % 2000 + 1000000 AS person", "IF(id % 16 < 8, 'custodian', 'assignee') AS role")
    out = str(tmp_path / "pairs")
    notify.fan_out(notes, people, "note", "book", "author", "person", "role", "severity").write.parquet(out)
    assert spark.read.parquet(out).count() == 6000 * 125 + 4800 * 125
    assert sum(os.path.getsize(f"{out}/{f}") for f in os.listdir(out) if f.endswith(".parquet")) < 6000 * 225 / 2


def test_rows_of_one_key_meet_in_blocks(spark, monkeypatch):
    """Every pair of a key once, of rows with and without equal ids, and no row of a blank key."""
    monkeypatch.setattr(pairs, "ROWS", 50)
    monkeypatch.setattr(pairs, "HELD", 20)
    one = spark.range(330).selectExpr("CASE WHEN id < 300 THEN 'a' WHEN id < 320 THEN 'b' WHEN id < 325 THEN 'c' END AS k", "id % 200 AS x", "id AS row_x")
    many = spark.range(170).selectExpr("CASE WHEN id < 110 THEN 'a' WHEN id < 160 THEN 'b' WHEN id < 165 THEN 'd' END AS k", "id AS y")
    out = pairs.all_pairs(one, many, ["k"], "x", "y")
    assert sorted(tuple(r) for r in out.select("k", "row_x", "y").collect()) == [("a", x, y) for x in range(300) for y in range(110)] + [("b", x, y) for x in range(300, 320) for y in range(110, 160)]
    assert shuffled(spark, out) <= 300 * 6 + 20 * 3 + 5


def test_windows_meet_days_not_each_other(spark):
    """Many certificates and many questions of one subject; against every certificate with every question."""
    import random

    rng, d0 = random.Random(3), dt.date(2024, 1, 1)
    some = lambda none=0.1: None if rng.random() < none else d0 + dt.timedelta(days=rng.randrange(300))
    ws = [(rng.choice(["a", "a", "a", "b", "c", None]), s, None if s is None or rng.random() < 0.05 else s + dt.timedelta(days=rng.randrange(-3, 9)), rng.choice([None, [], ["RT"], ["RT", "UT"], ["PT"], ["MT", None]])) for s in (some() for _ in range(150))]
    ws += [("d", None, d0, ["RT"]), ("e", d0 + dt.timedelta(days=400), None, None), ("f", d0, d0, None)]
    es = [(i, rng.choice(["a", "a", "a", "b", "c", "d", "e", "f", "g", None]), some(0.05), rng.choice(["RT", "UT", "PT", "MT", None])) for i in range(900)]
    windows = spark.createDataFrame(ws, "who string, s date, e date, m array<string>")
    events = spark.createDataFrame(es, "id long, who string, at date, method string")
    v = validity.qualification_verdicts(events, windows, ["who"], "id", "at", "s", "e")
    c = validity.method_coverage(events, windows, ["who"], "id", "at", "method", "s", "e", "m")
    want_v, want_c = {}, {}
    for i, who, day, method in es:
        own = [w for w in ws if who is not None and w[0] == who]
        live = [w for w in own if day and w[1] and w[1] <= day and (w[2] is None or day <= w[2])]
        passed = all(w[2] is not None and day is not None and w[2] < day for w in own)
        later = any(day and w[1] and w[1] > day for w in own)
        want_v[i] = "no_record" if not own else "qualified" if live else "expired" if passed else "unverifiable" if any(w[1] is None for w in own) else "not_yet" if later else "expired"
        names = {m for w in live for m in w[3] or []}
        covered = method is not None and method in names
        want_c[i] = ("covered" if covered else "methods_unrecorded" if any(w[3] is None for w in live) else "method_not_covered" if live else "no_cert", sorted(names - {None}) + [None] * (None in names))
    assert {r["id"]: r["verdict"] for r in v.collect()} == want_v
    assert {r["id"]: (r["verdict"], r["covers"]) for r in c.collect()} == want_c
    assert joined(spark, v) <= 3000 and joined(spark, c) <= 6000


def test_tickets_meet_in_lists(spark):
    """Of one ticket with many reports and welds, no pair comes out of the join itself."""
    reports = spark.range(400).selectExpr("'B' AS job_book_id", "'r' || id AS id", "CASE WHEN id < 390 THEN 'RT-7' WHEN id < 395 THEN 'RT-0' || id END AS report_number")
    welds = spark.range(300).selectExpr("'B' AS job_book_id", "'w' || id AS id", "CASE WHEN id = 299 THEN 'not_used' END AS status", "CASE WHEN id % 2 = 0 THEN ' T-07' WHEN id = 1 THEN '391' END AS ndt_ticket_number", "CASE WHEN id > 1 THEN 'x7' END AS xray_number")
    out = evidence.welds_of_tickets(welds, reports)
    assert joined(spark, out) <= 400
    assert sorted(tuple(r) for r in out.collect()) == sorted([("B", f"r{i}", f"w{j}") for i in range(390) for j in range(300) if j not in (1, 299)] + [("B", "r391", "w1")])


def test_lists_of_a_ticket_are_short_and_meet_in_blocks(spark, monkeypatch):
    """One ticket has all reports and welds: its pairs are made in many tasks, of lists that are soon unfolded."""
    monkeypatch.setattr(evidence, "LISTS", 2)
    ids = spark.range(1000).selectExpr("'B' AS k", "id AS x")
    sizes = [len(r["xs"]) for r in pairs.lists(ids, ["k"], "x", "xs").collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 128
    reports = spark.range(500).selectExpr("'B' AS job_book_id", "'r' || id AS id", "'RT-7' AS report_number")
    welds = spark.range(400).selectExpr("'B' AS job_book_id", "'w' || id AS id", "'ok' AS status", "'T-07' AS ndt_ticket_number", "'' AS xray_number")
    out = evidence.welds_of_tickets(welds, reports)
    assert out.distinct().count() == out.count() == 200_000
    tasks = {r[0] for r in out.select(F.spark_partition_id()).distinct().collect()}
    assert len(tasks) > 1


def test_people_are_decided_once_per_pair_of_names(spark):
    """Few people on many rows: no row is shuffled to find out who it is."""
    rows_ = spark.range(3000).selectExpr("CAST(id % 2 AS STRING) AS book", "'r' || lpad(id, 6, '0') AS row_id", "CASE id % 5 WHEN 0 THEN 's1' WHEN 1 THEN ' S2' WHEN 2 THEN 's3' WHEN 3 THEN ' ' ELSE 'A + B' END AS stamp", "CASE id % 5 WHEN 0 THEN 'One' WHEN 1 THEN 'two' WHEN 2 THEN 'TWO' END AS name", "CAST(NULL AS DATE) AS wpq_expires")
    register = spark.createDataFrame([("0", "p1", "S1", "Someone", None)], "book string, person_id string, initials string, full_name string, name_aliases array<string>")
    out = overview.people_plan(rows_, register)
    assert shuffled(spark, out) <= 300
    got = {(r["book"], int(r["row_id"][1:]) % 5, r["action"], r["matched_by"], r["person_id"], r["skip_reason"]) for r in out.collect()}
    want = {("0", 0, "match", "stamp", "p1", None), ("1", 0, "create", None, "r000005", None), ("1", 0, "match", "batch", "r000005", None)}
    want |= {(b, c, "skip", None, None, why) for b in "01" for c, why in ((3, "no_stamp"), (4, "combined_stamp"))}
    for b, first in (("0", "r000002"), ("1", "r000001")):
        want |= {(b, c, "match", "batch", first, None) for c in (1, 2)} | {(b, 2 if b == "0" else 1, "create", None, first, None)}
    assert got == want and out.count() == 3000


@given
@pytest.mark.parametrize("name", ["f11_hoop_stress", "r_stress"])
def test_welds_are_not_shuffled_to_sizes_of_pipe(spark, name):
    """There are a handful of sizes, so a handful of tasks would hold all welds."""
    assert "SortMergeJoin" not in plan(registry.queries()[name](spark, SF))


@given
@pytest.mark.parametrize("name", ["i9_flowline_findings", "i9_flowline_welds"])
def test_rows_of_flowline_logs_are_read_once(spark, name):
    """Two steps need the rows; neither reads the log's cells again."""
    assert "posexplode" not in plan(registry.queries()[name](spark, SF))


@given
def test_cells_are_put_in_order_by_their_rows_first(spark):
    """All cells may be of one file, which then tells none of them apart."""
    sorts = [line for line in plan(registry.queries()["i6_flowline_torque"](spark, SF)).splitlines() if "Sort [" in line and "row_no" in line]
    assert sorts and all("Sort [row_no" in line for line in sorts)


def test_lines_are_not_shuffled_to_numbers_of_welds(spark):
    """Many lines print one number, or none that can be read; Spark does not know how large the log is."""
    lines = spark.createDataFrame([("B", f"r{i % 7}", f"l{i}", None, None, ["1.1"] if i % 3 else ["no number", "2.2"]) for i in range(300)], "job_book_id string, report_id string, line string, report_date date, welder_stamp string, candidates array<string>")
    welds = spark.createDataFrame([("B", "w1", "1.1", None, None, None), ("B", "w2", "2.2", None, "T-1", None), ("C", "w3", "1.1", None, None, None)], "job_book_id string, id string, weld_number string, welder_stamp string, ndt_ticket_number string, xray_number string")
    out = linking.chosen_welds(lines, welds)
    assert "SortMergeJoin" not in plan(out)
    assert {(int(r["line"][1:]) % 3 == 0, r["printed"], r["weld_id"], r["status"], r["n_candidates"]) for r in out.collect()} == {(False, "1.1", "w1", "unchecked", 1), (True, "no number", None, "unmatched", 0)}
    assert out.count() == 300


@given
def test_lines_of_documents_are_read_once(spark):
    """Pages, files and reports are told from what each page says, not from its lines anew."""
    told = plan(registry.queries()["i11_document_gaps"](spark, SF))
    assert "Technician" not in told and "o_orderkey" not in told


def test_a_page_that_is_not_there_counts_only_for_what_it_states(spark):
    lines = [("a", 1, 0, "REPORT NUMBER: X"), ("a", 9, 0, "REPORT NUMBER: Y"), ("a", 9, 1, "Page 1 of 4"), ("a", None, 0, "Page 5 of 6"), (None, 1, 0, "REPORT NUMBER: Z"), ("b", 1, 0, "Page 1 of 2")]
    pages = [("a", 1), ("a", 2), ("a", 2), (None, 1)]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    out = papers.document_gaps(frame(lines, "file string, page int, line_no int, text string"), frame(pages, "file string, page int"))
    missing = [("a", "missing_field", s, None, 1, f) for f, s in (("report_date", "critical"), ("procedure_reference", "warning"), ("technician_name", "warning"))]
    want = [*missing, ("a", "row_not_read", "critical", None, 1, "no rows"), ("a", "page_empty", "critical", 2, None, None), ("a", "pages_missing", "critical", None, None, "2 of 6"), (None, "page_empty", "critical", 1, None, None), (None, "no_reports", "critical", None, None, None)]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(want, key=repr)
