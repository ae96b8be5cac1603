"""Sources, sinks and streams over the given tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import access, timeliness
from ..sources import readers, sinks
from ..streaming import jobs
from .books import sections
from .bound import ORACLES, bound, date, day, read
from .records import ctes, records


@bound("s2_orders_with_lines", "SELECT o_orderkey, coalesce(n, 0) AS n_lines, coalesce(q, 0) AS quantity FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def orders_with_lines(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "o_orderkey")
    out = readers.with_children(read(spark, sf_dir, "orders"), li, "o_orderkey", ["l_linenumber", "l_quantity"], "lines", ["l_linenumber"])
    return out.select("o_orderkey", F.size("lines").cast("long").alias("n_lines"), F.aggregate("lines", F.lit(0.0), lambda s, x: s + x.l_quantity).alias("quantity"))


@bound("s3_renamed_columns", 'SELECT n_nationkey AS "nNationkey", n_name AS "nName" FROM nation')
def renamed_columns(spark, sf_dir):
    return readers.renamed(read(spark, sf_dir, "nation"), readers.camel, ["nNationkey", "nName"])


@bound("s5_listed_sections", """SELECT nullif(regexp_extract(f, '^\\s*0*([1-9]\\d*(?:-\\d+)?|S\\d+)\\b', 1), '') AS section, count(*) AS n_files, sum(n_chars)::BIGINT AS bytes, 2 AS max_depth
FROM (SELECT n_chars, CASE WHEN doc_id % 9 = 0 THEN 'Other' ELSE lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || ' - ' || lang END AS f FROM documents) GROUP BY 1""")
def listed_sections(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    top = F.when(F.col("doc_id") % 9 == 0, "Other").otherwise(F.concat(F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lit(" - "), F.col("lang")))
    return readers.section_counts(readers.listed_documents(d, F.concat_ws("/", top, "source", F.concat("doc_id", F.lit(".pdf"))), F.col("n_chars")))


@bound("s11_turnover_manifest", "SELECT doc_id, lpad(left(source, 2), 2, '0') || '/' || doc_id || '.pdf' AS package_path, doc_id % 4 <> 0 AS available FROM documents WHERE doc_id % 7 <> 0")
def turnover_manifest(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.left("source", F.lit(2)).alias("section"), F.concat("doc_id", F.lit(".pdf")).alias("name"), F.concat_ws("/", "source", "doc_id").alias("stored"))
    return sinks.manifest(d.where("doc_id % 7 <> 0"), d.where("doc_id % 4 <> 0").select("stored"), "section", "name", "stored").select("doc_id", "package_path", "available")


@bound("s12_completeness_report", f"SELECT book, string_agg(rpad(o_orderpriority, 16, ' ') || lpad(printf('%.2f', pct), 8, ' '), chr(10) ORDER BY o_orderpriority) AS report FROM ({ORACLES['a8_section_scores']}) GROUP BY book")
def completeness_report(spark, sf_dir):
    return sinks.report_lines(sections(spark, sf_dir), "book", [F.col("o_orderpriority")], "o_orderpriority", "pct")


@bound("t1_weekly_stream", "SELECT date_trunc('week', ts)::DATE AS week, event_type, count(*) AS n FROM events GROUP BY ALL")
def weekly_stream(spark, sf_dir):
    stream = jobs.source(spark, sf_dir, "events").withColumn("ts", jobs.as_utc("ts"))
    return jobs.current(spark, jobs.run(jobs.weekly_counts(stream, "ts", ["event_type"]), "weekly", "update"), ["week", "event_type"])


@bound("t2_fault_stream", "SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM events WHERE event_type = 'error' GROUP BY ALL")
def fault_stream(spark, sf_dir):
    upserts = jobs.fault_upserts(jobs.source(spark, sf_dir, "events").where("event_type = 'error'"), ["user_id", "event_type"], "event_id")
    out = jobs.sink(spark, jobs.run(upserts, "faults", "update"))
    best = out.groupBy("user_id", "event_type").agg(F.max_by(F.struct("n", "first_seen", "last_seen"), "n").alias("b"))
    return best.select("user_id", "event_type", "b.n", F.col("b.first_seen").alias("first_event"), F.col("b.last_seen").alias("last_event"))


@bound("t3_note_stream", """SELECT DISTINCT event_id AS note, s_suppkey AS person FROM events JOIN supplier ON user_id % 25 = s_nationkey WHERE (s_suppkey % 4 = 0 OR (s_suppkey % 4 = 1 AND event_type = 'error')) AND s_suppkey <> user_id % 100""")
def note_stream(spark, sf_dir):
    e = jobs.source(spark, sf_dir, "events").select(F.col("event_id").alias("note"), (F.col("user_id") % 25).cast("int").alias("book"), (F.col("user_id") % 100).alias("author"), F.when(F.col("event_type") == "error", "warning").otherwise("info").alias("severity"))
    people = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("book"), F.col("s_suppkey").alias("person"), F.when(F.col("s_suppkey") % 4 == 0, "custodian").when(F.col("s_suppkey") % 4 == 1, "assignee").otherwise("reader").alias("role"))
    base = jobs.fresh_path(spark, "notes")
    jobs.run(e, "notes", "append", jobs.told_batches(f"{base}/sent", people, note="note", book="book", author="author", person="person", role="role", severity="severity"), base)
    return jobs.told_pairs(spark, f"{base}/sent", "note", "book", "author", "person")


@bound("t9_lateness_stream", "SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'unmeasurable' WHEN e < w THEN 'entered_before_work' WHEN e <= w + CASE isodow(w) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END THEN 'on_time' ELSE 'late' END AS verdict FROM (SELECT event_id, user_id, ts::DATE AS w, (ts::DATE + (event_id % 5 - 1)::INTEGER)::DATE AS e FROM events)")
def lateness_stream(spark, sf_dir):
    e = jobs.source(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("w"), F.date_add(F.to_date("ts"), (F.col("event_id") % 5 - 1).cast("int")).alias("e"), F.when(F.col("user_id") % 7 != 0, "field_entry").alias("source"))
    judged = timeliness.assessed(e, F.col("w"), F.col("e"), F.col("source"), F.lit(0), "mon_fri")
    return jobs.sink(spark, jobs.run(judged.select("event_id", "verdict"), "lateness", "append"))


@bound("s1_live_rows_pushed_down", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
def live_rows(spark, sf_dir):
    """An order that is finished stands for a live one; the predicate is on a stored column, so the scan has it."""
    return readers.live(read(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@bound("t2_fault_ledger", """WITH e AS (SELECT user_id, count(*) AS n, min(ts) AS f, max(ts) AS l FROM events WHERE event_type = 'error' GROUP BY 1) SELECT user_id, n, f AS first_seen, l AS last_seen, true AS due FROM e""")
def fault_ledger(spark, sf_dir):
    return faults(spark, sf_dir).select("user_id", "n", "first_seen", "last_seen", F.col("notified_at").isNotNull().alias("due"))


def faults(spark, sf_dir):
    """The faults of each user as keyed state: every event of type error is one, and a purchase resolves them."""
    kind = F.when(F.col("event_type") == "error", "fault").when(F.col("event_type") == "purchase", "resolved")
    stream = jobs.source(spark, sf_dir, "events").select("user_id", "ts", kind.alias("kind")).where("kind is not null")
    said = jobs.run(jobs.fault_states(stream, ["user_id"], "ts", "kind", timedelta(minutes=60)), "fault-states", "update")
    return jobs.current(spark, said, ["user_id"], "version").where("n > 0")


@bound("t2_fault_notifications", """WITH RECURSIVE e AS (SELECT user_id, ts FROM events WHERE event_type = 'error'), k AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS before, ts FROM events WHERE event_type IN ('error', 'purchase')),
told(user_id, ts) AS (SELECT user_id, min(ts) FROM e GROUP BY user_id UNION ALL SELECT * FROM (SELECT told.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = told.user_id AND e.ts >= told.ts + INTERVAL 60 MINUTE) AS ts FROM told) WHERE ts IS NOT NULL)
SELECT user_id, max(told.ts) AS notified_at, count(*) AS notifications, (SELECT max_by(event_type, (ts, event_type)) = 'purchase' FROM k WHERE k.user_id = told.user_id) AS resolved,
  (SELECT count(*) FROM k WHERE k.user_id = told.user_id AND event_type = 'error' AND before = 'purchase' AND k.ts > (SELECT min(ts) FROM e WHERE e.user_id = told.user_id)) AS reopened FROM told GROUP BY user_id""")
def fault_notifications(spark, sf_dir):
    return faults(spark, sf_dir).select("user_id", "notified_at", "notifications", "resolved", "reopened")


@bound("t4_digest_stream", "SELECT DISTINCT user_id AS person, event_id AS note FROM events WHERE event_id % 3 <> 0 AND ts < (SELECT min(ts) FROM events) + INTERVAL 10 DAY - INTERVAL 30 MINUTE AND user_id % 7 <> 0")
def digest_stream(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    now = F.lit(e.agg(F.min("ts")).first()[0]) + F.expr("INTERVAL 10 DAYS")
    people = e.select(F.col("user_id").alias("person")).distinct().withColumn("is_active", F.col("person") % 7 != 0)
    notes = jobs.source(spark, sf_dir, "events").select(F.col("user_id").alias("person"), F.col("event_id").alias("note"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("read_at"))
    base = jobs.fresh_path(spark, "digests")
    jobs.run(notes, "digests", "append", jobs.digest_batches(f"{base}/sent", people, now, 30), base)
    return jobs.sink(spark, f"{base}/sent")


@bound("t5_late_matches", """SELECT user_id % 500 AS key, count(*) FILTER (event_type NOT IN ('click', 'error')) AS heats, count(*) FILTER (event_type = 'click') AS certificates, count(*) FILTER (event_type = 'error') AS withdrawals,
CASE WHEN count(*) FILTER (event_type NOT IN ('click', 'error')) = 0 THEN 'no heat' WHEN count(*) FILTER (event_type = 'click') > count(*) FILTER (event_type = 'error') THEN 'on_file' ELSE 'missing' END AS status FROM events GROUP BY 1""")
def late_matches(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "certificate").when(F.col("event_type") == "error", "withdrawal").otherwise("heat")
    stream = jobs.source(spark, sf_dir, "events").select((F.col("user_id") % 500).alias("key"), kind.alias("kind"))
    return spark.read.parquet(jobs.run(jobs.late_matches(stream, "key", "kind"), "matches", "complete"))


@bound("t8_archive_run", """SELECT object_key, sha256 FROM (SELECT doc_id, source || '/' || doc_id AS object_key, sha256(text) AS sha256, coalesce(sum(n_chars) OVER w, 0) AS b, count(*) OVER w AS n FROM documents WHERE doc_id % 4 <> 0 WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE b < 200000 AND n < 150""")
def archive_run(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "doc_id").alias("object_key"), F.sha2("text", 256).alias("sha256"), "n_chars")
    return jobs.archive_run(d, d.where("doc_id % 4 = 0"), ["doc_id"], "n_chars", 200_000, 150).select("object_key", "sha256")


@bound("t5_withdrawn_certificates", """WITH m AS (SELECT user_id % 500 AS key, CASE event_type WHEN 'click' THEN 'certificate' WHEN 'error' THEN 'withdrawal' ELSE 'heat' END AS kind, event_id % 7 AS c FROM events),
k AS (SELECT key, count(*) FILTER (kind = 'heat') AS heats, list_distinct(list(c) FILTER (kind = 'certificate')) AS there, list_distinct(list(c) FILTER (kind = 'withdrawal')) AS gone FROM m GROUP BY key)
SELECT key, heats, live AS live_certificates, CASE WHEN heats = 0 THEN 'no heat' WHEN live > 0 THEN 'on_file' ELSE 'missing' END AS status FROM (SELECT *, coalesce(len(list_filter(there, lambda c: NOT list_contains(coalesce(gone, []), c))), 0) AS live FROM k)""")
def withdrawn_certificates(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "certificate").when(F.col("event_type") == "error", "withdrawal").otherwise("heat")
    stream = jobs.source(spark, sf_dir, "events").select((F.col("user_id") % 500).alias("key"), jobs.as_utc("ts").alias("ts"), kind.alias("kind"), (F.col("event_id") % 7).cast("string").alias("certificate"))
    said = jobs.run(jobs.certificate_matches(stream, "key", "ts", "kind", "certificate", "30 days", timedelta(days=730)), "certificates", "update")
    return jobs.current(spark, said, ["key"], "version").select("key", "heats", "live_certificates", "status")


@bound("t6_captured_changes", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'create' WHEN o_orderkey % 5 = 1 THEN 'soft_delete' ELSE 'update' END AS action FROM orders WHERE o_orderkey % 5 < 3""")
def captured_changes(spark, sf_dir):
    """Orders as they come against a snapshot that lacks some, has others undeleted, and others with another status."""
    return captured(spark, sf_dir, 1)


@bound("t6_repeated_capture", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'create' WHEN o_orderkey % 5 = 1 THEN 'soft_delete' ELSE 'update' END AS action FROM orders WHERE o_orderkey % 5 < 3""")
def repeated_capture(spark, sf_dir):
    """The same, with every batch written twice, as after a failure: the log has each change once."""
    return captured(spark, sf_dir, 2)


def captured(spark, sf_dir, times):
    k = F.col("id")
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 5 == 1, day("o_orderdate")).alias("deleted_at"))
    snapshot = o.where(k % 5 != 0).select("id", F.when(k % 5 == 2, "before").otherwise(F.col("status")).alias("status"), F.when(k % 5 != 1, F.col("deleted_at")).alias("deleted_at"))
    base = jobs.fresh_path(spark, "captures")
    each = jobs.captured(lambda batch: snapshot.join(batch.select("id"), "id", "left_semi"), ["id"], ["status", "deleted_at"], "deleted_at", f"{base}/log")
    stream = jobs.source(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 5 == 1, day("o_orderdate")).alias("deleted_at"))
    jobs.run(stream, "captured", "append", lambda batch, id: [each(batch, id) for _ in range(times)], base)
    return jobs.sink(spark, f"{base}/log").select("id", "action")


@bound("t7_expired_uploads", """WITH u AS (SELECT event_id AS upload, ts AS staged_at, CASE WHEN event_id % 4 <> 0 THEN ts + to_hours(event_id % 50) END AS committed_at FROM events)
SELECT upload, staged_at FROM u WHERE (committed_at IS NULL OR committed_at > staged_at + INTERVAL 24 HOUR) AND staged_at + INTERVAL 24 HOUR < (SELECT max(greatest(staged_at, coalesce(committed_at, staged_at))) FROM u) - INTERVAL 2 DAY""")
def expired_uploads(spark, sf_dir):
    """Each event stages an upload; three of four are committed, some too late."""
    e = jobs.source(spark, sf_dir, "events").withColumn("ts", jobs.as_utc("ts"))
    commit = F.when(F.col("event_id") % 4 != 0, F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 50).cast("int")))
    moves = F.array(F.struct(F.lit("staged").alias("kind"), F.col("ts").alias("at")), F.struct(F.lit("committed").alias("kind"), commit.alias("at")))
    stream = e.select(F.col("event_id").alias("upload"), F.explode(moves).alias("m")).select("upload", "m.kind", F.col("m.at").alias("at")).where("at is not null")
    return jobs.sink(spark, jobs.run(jobs.expiring_uploads(stream, "upload", "at", "kind", "2 days"), "expired", "append")).select("upload", jobs.utc_clock(F.col("staged_at")).alias("staged_at"))


@bound("s9_audit_log", """SELECT 'first' AS run, l_orderkey AS id, CASE WHEN l_orderkey % 3 = 0 THEN 'create' ELSE 'update' END AS action FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 1) WHERE l_orderkey % 3 < 2
UNION ALL SELECT 'second', l_orderkey, 'soft_delete' FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 1) WHERE l_orderkey % 4 = 0""")
def audit_log(spark, sf_dir):
    """Two runs over the same rows, each of them repeated once: what each of them changed is in the log once."""
    l, k = read(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("id")).distinct(), F.col("id")
    none = F.lit(None).cast("date")
    now = l.select("id", F.lit("b").alias("v"), none.alias("gone"))
    states = {"first": (l.where(k % 3 != 0).select("id", F.when(k % 3 == 1, "a").otherwise("b").alias("v"), none.alias("gone")), now), "second": (now, l.select("id", F.lit("b").alias("v"), F.when(k % 4 == 0, date("1998-01-01")).alias("gone")))}
    path = jobs.fresh_path(spark, "audit-log")
    for run, (old, new) in states.items():
        for _ in range(2):
            sinks.append_changes(old, new, ["id"], ["v", "gone"], "gone", path, F.lit("1998-01-02").cast("timestamp"), run)
    return spark.read.parquet(path).select("run", "id", "action")


@bound("s13_weekly_rates", """SELECT book, week, CASE WHEN book % 5 = 3 THEN 0 ELSE on_time END AS on_time, CASE WHEN book % 5 = 3 THEN n ELSE n - on_time END AS late FROM (SELECT o_custkey % 30 AS book, date_trunc('week', o_orderdate)::DATE AS week, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS on_time FROM orders GROUP BY ALL)""")
def weekly_rates(spark, sf_dir):
    """Books written one half after the other, then some of them once more with other counts: every (book, week) is there once."""
    o = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 30).alias("book"), F.trunc(day("o_orderdate"), "week").alias("week"), (F.col("o_orderstatus") == "F").alias("f"))
    rates = o.groupBy("book", "week").agg(F.count_if("f").alias("on_time"), F.count_if(~F.col("f")).alias("late"))
    path = jobs.fresh_path(spark, "rates")
    again = rates.where("book % 5 = 3").select("book", "week", F.lit(0).cast("long").alias("on_time"), (F.col("on_time") + F.col("late")).alias("late"))
    for part in (rates.where("book % 2 = 0"), rates.where("book % 2 = 1"), again):
        sinks.write_rates(part, path, book="book")
    return spark.read.parquet(path).select("book", F.col("week").cast("date").alias("week"), "on_time", "late")


#: Each nation a dump with a sheet of its customers: a heading, rows of cells, runs of blank rows, and a listing of formulas after some.
@bound("s4_cells", """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 3 + 1 ELSE 0 END AS blanks FROM customer),
p AS (SELECT *, row_number() OVER w - 1 + coalesce(sum(blanks) OVER (PARTITION BY n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS row_no FROM c WINDOW w AS (PARTITION BY n ORDER BY k))
SELECT 'Sheet ' || n AS sheet, row_no, 0 AS col_no, 'K' || k AS value FROM p UNION ALL SELECT 'Sheet ' || n, row_no, 2, 'v ' || k % 10 FROM p WHERE k % 4 <> 0""")
def cells(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    line = lambda part, text: F.struct(F.lit(part).alias("part"), text.alias("value"))
    own = F.array(line(0, F.concat(F.lit("K"), k, F.lit("\t\t"), F.when(k % 4 != 0, F.concat(F.lit(" v "), k % 10)).otherwise(""))), line(1, F.when(k % 7 == 0, F.concat(F.lit("["), k % 3 + 1, F.lit(" empty rows]")))))
    c = read(spark, sf_dir, "customer")
    rows = c.select("c_nationkey", k.alias("at"), F.explode(own).alias("l")).select("c_nationkey", "at", "l.*")
    heads = c.select("c_nationkey").distinct().select("c_nationkey", F.explode(F.array(
        F.struct(F.lit(-1).cast("long").alias("at"), line(0, F.concat(F.lit("## Sheet: Sheet "), n, F.lit(" — 60 rows × 3 columns"))).alias("l")),
        F.struct(F.lit(2**62).alias("at"), line(0, F.when(n % 5 == 0, "Formulas: 2")).alias("l")), F.struct(F.lit(2**62).alias("at"), line(1, F.when(n % 5 == 0, "A1\t=B1")).alias("l")),
    )).alias("h")).select("c_nationkey", "h.at", "h.l.*")
    path = jobs.fresh_path(spark, "dumps")
    rows.unionByName(heads).where("value is not null").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "at", "part").select("c_nationkey", "value").write.partitionBy("c_nationkey").text(path)
    return readers.cell_dump(spark, path).select("sheet", "row_no", "col_no", "value")


@bound("s10_weld_sheet", f"""WITH {ctes("weld")} SELECT job_book_id, weld_number AS "Weld #", coalesce(weld_date::VARCHAR, '') AS "Date", coalesce(welder_stamp, '') AS "Welder", array_to_string(heat_numbers, ', ') AS "Heat #s", coalesce(ndt_method, '') AS "NDT method", status AS "Status" FROM weld""")
def weld_sheet(spark, sf_dir):
    """Written for all books and read back: what a book's folder shows under its headings."""
    path = jobs.fresh_path(spark, "weld-sheets")
    sinks.export_sheet(records(spark, sf_dir, "weld")["weld"], "weld_log", path)
    back = spark.read.option("header", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    shown = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("Weld #", "Date", "Welder", "Heat #s", "NDT method", "Status")]
    return back.select(F.col("job_book_id").cast("string").alias("job_book_id"), *shown)


@bound("s10_torque_sheet", f"""WITH {ctes("torque_connection")} SELECT job_book_id, coalesce(CASE WHEN required_torque_min_ft_lb IS NOT NULL THEN required_torque_min_ft_lb::INTEGER || '-' || required_torque_max_ft_lb::INTEGER ELSE required_torque_ft_lb::INTEGER::VARCHAR END, '') AS "Required",
coalesce(wrench_id_raw, '') AS "Wrench", coalesce(torque_date::VARCHAR, '') AS "Torqued", coalesce(inspection_date::VARCHAR, '') AS "Inspected", '' AS "Bolts" FROM torque_connection""")
def torque_sheet(spark, sf_dir):
    shown = sinks.sheet(records(spark, sf_dir, "torque_connection")["torque_connection"], "torque_log")
    return shown.select("job_book_id", "Required", "Wrench", "Torqued", "Inspected", "Bolts")


@bound("p21_document_library", f"""WITH {ctes("document", "job_book_section")}, d AS (SELECT d.*, s.section_number, s.title FROM document d JOIN job_book_section s ON s.id = d.section_id)
SELECT 'section' AS search, id FROM d WHERE section_number = '10' AND (contains(lower(original_filename), 'rpt') OR contains(lower(coalesce(other_filename, '')), 'rpt') OR contains(lower(title), 'rpt')) UNION ALL SELECT 'title', id FROM d WHERE contains(lower(original_filename), 'as-built') OR contains(lower(coalesce(other_filename, '')), 'as-built') OR contains(lower(title), 'as-built')""")
def document_library(spark, sf_dir):
    t = records(spark, sf_dir, "document", "job_book_section")
    d = t["document"].join(t["job_book_section"].select(F.col("id").alias("section_id"), "section_number", F.col("title").alias("section_title")), "section_id").withColumnRenamed("other_filename", "normalized_filename")
    found = lambda name, rows: rows.select(F.lit(name).alias("search"), "id")
    return found("section", access.library(d, "10", " RPT ")).unionByName(found("title", access.library(d, query="As-BUILT")))


@bound("p21_finding_queue", f"""WITH {ctes("compliance_flag")}, f AS (SELECT DISTINCT job_book_id, severity, state AS rule_id FROM compliance_flag)
SELECT 'all' AS filter, *, row_number() OVER (PARTITION BY job_book_id ORDER BY list_position(['critical', 'warning', 'info'], severity), rule_id)::INTEGER AS place FROM f UNION ALL SELECT 'warning', *, row_number() OVER (PARTITION BY job_book_id ORDER BY rule_id)::INTEGER FROM f WHERE severity = 'warning'""")
def finding_queue(spark, sf_dir):
    f = records(spark, sf_dir, "compliance_flag")["compliance_flag"].select("job_book_id", "severity", F.col("state").alias("rule_id")).distinct()
    return access.of_severity(f).withColumn("filter", F.lit("all")).unionByName(access.of_severity(f, "warning").withColumn("filter", F.lit("warning")))
