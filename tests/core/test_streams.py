"""Streams that stop and go on: every row once, and a repeated batch writes what it wrote."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from punchlist.operators import history
from punchlist.streaming import jobs

T = dt.datetime


def put(spark, folder, name, part, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}.parquet")


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    put(spark, source, "events", 0, [(1, "a"), (2, "b")], "id long, v string")
    for more in ([(3, "c")], [(4, "d"), (5, "e")], []):
        out = jobs.run(jobs.source(spark, source, "events").where("id <> 2"), "copied", "append", folder=work)
        if more:
            put(spark, source, "events", 1, more, "id long, v string")
    jobs.run(jobs.source(spark, source, "events").where("id <> 2"), "copied", "append", folder=work)
    assert sorted(r["id"] for r in jobs.sink(spark, out).collect()) == [1, 3, 4, 5]


def test_a_repeated_batch_of_the_ledger_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "ledger")
    each = jobs.fault_ledger(path, ["k"], "at", "60 MINUTES")
    day = T(2024, 1, 1)
    batches = [[("x", day), ("x", day + dt.timedelta(minutes=1)), ("y", day)], [("x", day + dt.timedelta(minutes=30))], [("x", day + dt.timedelta(minutes=90)), ("z", day)]]
    for i, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, "k string, at timestamp")
        for _ in range(2):
            each(batch, i)
    last = {r["k"]: r for r in spark.read.parquet(f"{path}/version=2").collect()}
    assert {k: (r["n"], r["due"]) for k, r in last.items()} == {"x": (4, True), "y": (1, False), "z": (1, True)}
    middle = {r["k"]: r["due"] for r in spark.read.parquet(f"{path}/version=1").collect()}
    assert middle == {"x": False, "y": False}  # still quiet, and not seen again


def test_a_resolved_fault_comes_back(spark, tmp_path):
    path, day = str(tmp_path / "ledger"), T(2024, 1, 1)
    each = jobs.fault_ledger(path, ["k"], "at", "60 MINUTES")
    each(spark.createDataFrame([("x", day)], "k string, at timestamp"), 0)
    first = spark.read.parquet(f"{path}/version=0").withColumn("resolved", F.lit(True))
    rows = first.collect()
    spark.createDataFrame(rows, first.schema).write.mode("overwrite").parquet(f"{path}/version=0")
    each(spark.createDataFrame([("x", day)], "k string, at timestamp"), 1)
    assert [(r["n"], r["resolved"], r["reopened"]) for r in spark.read.parquet(f"{path}/version=1").collect()] == [(2, False, True)]


def test_digests_send_each_note_once(spark, tmp_path):
    path, day = str(tmp_path / "sent"), T(2024, 1, 1)
    people = spark.createDataFrame([("a", True), ("b", False)], "person string, is_active boolean")
    each = jobs.digest_batches(path, people, F.lit(day + dt.timedelta(hours=2)), 60)
    schema = "person string, note long, created_at timestamp, read_at timestamp"
    each(spark.createDataFrame([("a", 1, day, None), ("a", 2, day + dt.timedelta(minutes=90), None), ("a", 3, day, day), ("b", 4, day, None)], schema), 0)
    again = spark.createDataFrame([("a", 1, day, None), ("a", 5, day, None)], schema)
    each(again, 1)
    each(again, 1)
    assert sorted(r["note"] for r in jobs.sink(spark, path).collect()) == [1, 5]


def test_archive_runs_until_nothing_is_left(spark):
    objects = spark.createDataFrame([(i, f"k{i}", f"h{i}", 10) for i in range(23)], "i long, object_key string, sha256 string, size long")
    archived, seen = objects.limit(0), []
    for _ in range(6):
        picked = jobs.archive_run(objects, archived, ["i"], "size", 60, 5).collect()
        seen += [r["i"] for r in picked]
        archived = spark.createDataFrame([(i, f"k{i}", f"h{i}", 10) for i in seen], objects.schema)
    assert seen == list(range(23))


def test_notes_meet_in_either_order(spark, tmp_path):
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    put(spark, source, "moves", 0, [("h1", "heat"), ("h2", "certificate")], "k string, kind string")
    run = lambda: {r["k"]: r["status"] for r in spark.read.parquet(jobs.run(jobs.late_matches(jobs.source(spark, source, "moves"), "k", "kind"), "matches", "complete", folder=work)).collect()}
    assert run() == {"h1": "missing", "h2": "no heat"}
    put(spark, source, "moves", 1, [("h1", "certificate"), ("h2", "heat")], "k string, kind string")
    assert run() == {"h1": "on_file", "h2": "on_file"}
    put(spark, source, "moves", 2, [("h1", "withdrawal")], "k string, kind string")
    assert run() == {"h1": "missing", "h2": "on_file"}


def test_budget_over_large_groups(spark):
    df = spark.createDataFrame([(1, i, 7) for i in range(500)], "g int, i long, size long")
    got = sorted(r["i"] for r in history.within_budget(df, ["g"], ["i"], "size", 70, 50).collect())
    assert got == list(range(10))


def states(spark, source, work, kind="moves"):
    """The keyed states that a stream said last, by key; the run goes on where the one before stopped."""
    stream = jobs.source(spark, source, kind)
    said = jobs.run(jobs.fault_states(stream, ["k"], "at", "what", dt.timedelta(minutes=60)), "states", "update", folder=work)
    return {r["k"]: tuple(r)[1:] for r in jobs.current(spark, said, ["k"], "version").collect()}


def test_who_is_told_does_not_depend_on_batches(spark, tmp_path):
    day, minutes = T(2024, 1, 1), lambda m: dt.timedelta(minutes=m)
    rows = [("x", day + minutes(m), what) for m, what in ((0, "fault"), (10, "fault"), (59, "fault"), (60, "fault"), (70, "resolved"), (80, "fault"), (130, "fault"), (200, "resolved"))] + [("y", day + minutes(5), "fault")]
    rows.sort(key=lambda r: r[1])
    schema = "k string, at timestamp, what string"
    want = {"x": (6, day, day + minutes(130), day + minutes(130), 3, True, 1), "y": (1, day + minutes(5), day + minutes(5), day + minutes(5), 1, False, 0)}
    for name, cuts in (("one", []), ("three", [2, 5]), ("each", list(range(1, len(rows))))):
        source, work = str(tmp_path / name), str(tmp_path / f"{name}-work")
        for first, end in zip([0, *cuts], [*cuts, len(rows)]):
            put(spark, source, "moves", 0, rows[first:end], schema)
            got = states(spark, source, work)  # started anew for each part
        assert {k: v[:7] for k, v in got.items()} == want, name


def test_rows_of_a_key_that_come_in_parts_are_taken_in_order_of_time(spark, tmp_path):
    day = T(2024, 1, 1)
    at = lambda m: day + dt.timedelta(minutes=m)
    rows = [("x", at(m), "resolved" if m % 7 == 3 else "fault") for m in range(0, 300, 2)][::-1]
    source = str(tmp_path / "in")
    put(spark, source, "moves", 0, rows, "k string, at timestamp, what string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = states(spark, source, str(tmp_path / "work"))["x"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    n, told, last, resolved, again = 0, [], None, False, 0
    for _, when, what in rows[::-1]:
        if what == "resolved":
            resolved = n > 0
            continue
        n, last, again, resolved = n + 1, when, again + resolved, False
        if not told or when - told[-1] >= dt.timedelta(minutes=60):
            told.append(when)
    assert got[:7] == (n, day, last, told[-1], len(told), resolved, again)


def test_a_withdrawal_takes_back_its_own_certificate(spark, tmp_path):
    day, schema = T(2024, 1, 1), "k string, at timestamp, kind string, c string"
    rows = [("h1", "heat", ""), ("h1", "withdrawal", "A"), ("h1", "certificate", "A"), ("h1", "certificate", "B"), ("h1", "certificate", "B"), ("h2", "certificate", "A"), ("h2", "withdrawal", "A"), ("h2", "heat", ""), ("h3", "certificate", "Z")]
    want = {"h1": (1, 1, "on_file"), "h2": (1, 0, "missing"), "h3": (0, 1, "no heat")}
    for name, order, step in (("asis", rows, 9), ("back", rows[::-1], 1), ("half", rows[4:] + rows[:4], 4)):
        source, work = str(tmp_path / name), str(tmp_path / f"{name}-work")
        for i in range(0, len(order), step):
            put(spark, source, "moves", 0, [(k, day + dt.timedelta(minutes=i), kind, c) for k, kind, c in order[i : i + step]], schema)
            said = jobs.run(jobs.certificate_matches(jobs.source(spark, source, "moves"), "k", "at", "kind", "c", "1 day", dt.timedelta(days=30)), "matches", "update", folder=work)
        assert {r["k"]: (r["heats"], r["live_certificates"], r["status"]) for r in jobs.current(spark, said, ["k"], "version").collect()} == want, name


def test_a_key_without_news_is_forgotten(spark, tmp_path):
    source, work, schema = str(tmp_path / "in"), str(tmp_path / "work"), "k string, at timestamp, kind string, c string"
    for day in (1, 2, 20, 21):
        put(spark, source, "moves", 0, [("old" if day == 1 else f"d{day}", T(2024, 1, day), "certificate", "A"), ("late" if day == 21 else "x", T(2024, 1, day), "heat", "")], schema)
        said = jobs.run(jobs.certificate_matches(jobs.source(spark, source, "moves"), "k", "at", "kind", "c", "1 day", dt.timedelta(days=5)), "matches", "update", folder=work)
    put(spark, source, "moves", 0, [("old", T(2024, 1, 21), "heat", "")], schema)
    said = jobs.run(jobs.certificate_matches(jobs.source(spark, source, "moves"), "k", "at", "kind", "c", "1 day", dt.timedelta(days=5)), "matches", "update", folder=work)
    last = [(r["heats"], r["live_certificates"]) for r in jobs.sink(spark, said).where("k = 'old' and heats = 1").collect()]
    assert last == [(1, 0)]


def test_uploads_expire_once_and_after_a_restart(spark, tmp_path):
    source, work, schema = str(tmp_path / "in"), str(tmp_path / "work"), "u long, at timestamp, kind string"
    at = lambda day, hour=0: T(2024, 1, day, hour)
    parts = [[(1, at(1), "staged"), (2, at(1), "staged"), (3, at(1, 5), "committed"), (3, at(1), "staged")], [(2, at(1, 23), "committed"), (4, at(2), "staged")], [(5, at(9), "staged")], [(4, at(9), "committed"), (6, at(20), "staged")], [(7, at(30), "staged")]]
    for part in parts:
        put(spark, source, "moves", 0, part, schema)
        out = jobs.run(jobs.expiring_uploads(jobs.source(spark, source, "moves"), "u", "at", "kind", "1 day"), "expired", "append", folder=work)
    assert sorted((r["u"], r["staged_at"]) for r in jobs.sink(spark, out).collect()) == [(1, at(1)), (4, at(2)), (5, at(9)), (6, at(20))]


def test_late_rows_are_kept_aside(spark, tmp_path):
    path, each = str(tmp_path / "late"), jobs.late_rows(str(tmp_path / "late"), "at", "14 DAYS")
    days = [[1, 30], [2, 16, 17, 60], [45, 46], [70]]
    for i, batch in enumerate(days):
        rows = spark.createDataFrame([(d, T(2024, 1, 1) + dt.timedelta(days=d)) for d in batch], "d long, at timestamp")
        for _ in range(2):
            each(rows, i)
    assert sorted(r["d"] for r in spark.read.parquet(f"{path}/late").collect()) == [2, 45]


def test_rates_of_two_books_in_one_week(spark, tmp_path):
    from punchlist.sources import sinks

    path, schema = str(tmp_path / "rates"), "book string, week date, on_time long, late long, rate double"
    write = lambda *rows: sinks.write_rates(spark.createDataFrame(list(rows), schema), path, book="book")
    one, two = dt.date(2024, 1, 1), dt.date(2024, 1, 8)
    write(("a", one, 1, 0, 100.0), ("a", two, 0, 0, None))
    write(("b", one, 2, 2, 50.0))
    write(("a", one, 0, 1, 0.0))
    got = {(r["book"], r["week"]): (r["on_time"], r["late"]) for r in spark.read.parquet(path).collect()}
    assert got == {("a", one): (0, 1), ("a", two): (0, 0), ("b", one): (2, 2)}
    for bad in ([("c", one, 1, 0, 100.0), ("c", one, 2, 0, 100.0)], [("c", one, -1, 2, 50.0)], [("c", one, 0, 0, 0.0)], [("c", one, 1, 1, None)]):
        try:
            write(*bad)
        except Exception as e:
            assert "USER_RAISED" in str(e) or "counts" in str(e) or "two rows" in str(e)
        else:
            raise AssertionError(bad)
    assert spark.read.parquet(path).count() == 3


def test_a_repeated_capture_is_in_the_log_once(spark, tmp_path):
    path, old = str(tmp_path / "log"), spark.createDataFrame([(1, "a", None)], "id long, v string, gone string")
    each = jobs.captured(lambda _: old, ["id"], ["v", "gone"], "gone", path)
    for _ in range(3):
        each(spark.createDataFrame([(1, "b", None)], old.schema), 0)
    each(spark.createDataFrame([(1, "c", None)], old.schema), 1)
    assert jobs.sink(spark, path).count() == 2


def test_live_rows_reach_the_scan(spark):
    from punchlist import registry

    plan = registry.queries()["s1_live_rows_pushed_down"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,F)" in plan


def test_a_dump_in_many_tasks(spark, tmp_path):
    from punchlist.sources import readers

    lines = ["junk before", "## Sheet: A — 3 rows × 2 columns"]
    want, row = [], 0
    for i in range(3000):
        if i == 1500:
            lines += ["Formulas: 1", "A1\t=x", "## Sheet: B (empty)", "", "## Sheet: C"]
            row = 0
        if i % 97 == 5:
            lines.append(f"[{i % 4 + 1} empty rows]")
            row += i % 4 + 1
        lines.append(f"r{i}\t \tx  ")
        want += [("A" if i < 1500 else "C", row, 0, f"r{i}"), ("A" if i < 1500 else "C", row, 2, "x")]
        row += 1
    (tmp_path / "dump.txt").write_text("\n".join(lines))
    (tmp_path / "other.txt").write_text("# Short\na\tb\n~2\nc\n## formulas\nd")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        cells = readers.cell_dump(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = [(r["file"].rsplit("/", 1)[1], r["sheet"], r["row_no"], r["col_no"], r["value"]) for r in cells.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(x[1:] for x in got if x[0] == "dump.txt") == sorted(want)
    assert sorted(x[1:] for x in got if x[0] == "other.txt") == [("Short", 0, 0, "a"), ("Short", 0, 1, "b"), ("Short", 3, 0, "c")]


def test_notes_reach_each_person_once_and_only_notes_are_kept(spark, tmp_path):
    path, schema = str(tmp_path / "sent"), "n long, b int, a long, s string"
    people = spark.createDataFrame([(1, 7, "custodian"), (1, 8, "assignee"), (2, 7, "custodian"), (2, 9, "assignee")], "b int, p long, r string")
    each = jobs.note_batches(path, people, "n", "b", "a", "p", "r", "s")
    batches = [[(1, 1, 0, "info"), (2, 1, 8, "warning")], [(1, 1, 0, "warning"), (2, 2, 0, "warning"), (3, 1, 0, "info"), (3, 1, 0, "info")], [(1, 1, 0, "info")]]
    for i, batch in enumerate(batches):
        for _ in range(2):
            each(spark.createDataFrame(batch, schema), i)
    sent = spark.read.parquet(path)
    assert sorted((r["batch"], r["n"], r["p"]) for r in sent.collect()) == [(0, 1, 7), (0, 2, 7), (1, 1, 8), (1, 2, 9), (1, 3, 7)]


def test_sent_notes_are_not_kept_in_pairs(spark, tmp_path):
    """The same pairs of notes and their audiences; people may change from batch to batch."""
    path, schema = str(tmp_path / "sent"), "n long, b int, a long, s string"
    people = spark.createDataFrame([(1, 7, "custodian"), (1, 8, "assignee"), (2, 7, "custodian"), (2, 9, "assignee")], "b int, p long, r string")
    later = people.unionByName(spark.createDataFrame([(1, 10, "custodian")], people.schema))
    batches = [([(1, 1, 0, "info"), (2, 1, 8, "warning"), (5, 1, 7, "info"), (5, 2, 7, "warning")], people), ([(1, 1, 0, "warning"), (2, 2, 0, "warning"), (3, 1, 0, "info"), (3, 1, 0, "info")], people), ([(1, 1, 0, "info"), (4, 1, 10, "info"), (6, 1, None, "info")], later)]
    for i, (batch, who) in enumerate(batches):
        each = jobs.told_batches(path, who, "n", "b", "a", "p", "r", "s")
        for _ in range(2):
            each(spark.createDataFrame(batch, schema), i)
    got = sorted(tuple(r) for r in jobs.told_pairs(spark, path, "n", "b", "a", "p").collect())
    assert got == [(1, 7), (1, 8), (2, 7), (2, 9), (3, 7), (4, 7), (5, 9), (6, 7), (6, 10)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the given tables")
def test_the_stream_of_notes_writes_no_pairs(spark, monkeypatch):
    """What it keeps grows with notes and people."""
    from punchlist import registry

    made, fresh_path = [], jobs.fresh_path
    monkeypatch.setattr(jobs, "fresh_path", lambda *a: made.append(fresh_path(*a)) or made[-1])
    sent = registry.queries()["t3_note_stream"](spark, "/root/testdata/sf0.01")
    kept = sum(spark.read.parquet(f"{made[0]}/sent/{what}").count() for what in ("once", "audiences", "pairs"))
    assert kept <= 10_000 + 200 and sent.count() == 12_060


def test_uploads_are_kept_in_buckets(spark, tmp_path, monkeypatch):
    """Many uploads in few buckets: each is judged by itself. One call of Python an upload took about a millisecond each."""
    source, work, schema = str(tmp_path / "in"), str(tmp_path / "work"), "u long, at timestamp, kind string"
    monkeypatch.setattr(jobs, "UPLOAD_BUCKETS", 2)
    hour = lambda n: T(2024, 1, 1) + dt.timedelta(hours=n)
    put(spark, source, "moves", 0, [(i, hour(i % 5), "staged") for i in range(60)] + [(i, hour(i % 5 + i), "committed") for i in range(0, 60, 2)], schema)
    put(spark, source, "moves", 0, [(999, hour(24 * 30), "staged")], schema)
    out = jobs.run(jobs.expiring_uploads(jobs.source(spark, source, "moves", 1), "u", "at", "kind", "1 day"), "expired", "append", folder=work)
    assert sorted((r["u"], r["staged_at"]) for r in jobs.sink(spark, out).collect()) == [(i, hour(i % 5)) for i in range(60) if i % 2 or i > 24]
