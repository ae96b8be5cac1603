"""Report lines against welds, and certificates against wrenches, over the shared record views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linking
from .bound import bound, day, read
from .records import ctes, records


def lines(spark, sf_dir):
    li, k = read(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    number = F.concat(k % 400, F.lit("."), F.col("l_linenumber"))
    some = F.when(k % 5 == 0, F.array(F.lit("x9999999"), F.concat(F.lit("NP-0"), number))).when(k % 5 == 1, F.array(F.concat(F.lit("W"), number))).when(k % 5 == 2, F.array(F.lit("no number"), F.lit("1.1"))).when(k % 5 == 3, F.array(F.concat(F.lit("0"), number), F.lit("1.2"))).otherwise(F.array().cast("array<string>"))
    own = F.concat_ws("-", F.concat(F.lit("w"), k), "l_linenumber", "l_partkey", "l_suppkey")
    return li.select((F.col("l_suppkey") % 25).cast("string").alias("job_book_id"), F.concat(F.lit("r"), k).alias("report_id"), own.alias("line"), day("l_shipdate").alias("report_date"), F.when(k % 3 == 0, "crew").when(k % 3 == 1, "zz").alias("welder_stamp"), some.alias("candidates"))


def welds(spark, sf_dir):
    w = records(spark, sf_dir, "weld")["weld"]
    number = F.regexp_extract("id", r"^w(\d+)", 1).cast("long")
    ticket = F.when(number % 8 == 0, F.date_format("weld_date", "M/d/yyyy")).when(number % 8 == 4, F.date_format("weld_date", "M/d/yy")).otherwise(F.col("ndt_ticket_number"))
    return w.where("weld_date IS NULL OR weld_date < '1995-06-01'").withColumn("ndt_ticket_number", ticket)


_LINES = f"""{ctes('weld')}, n AS (SELECT *, regexp_extract(id, '^w([0-9]+)', 1)::BIGINT AS ok FROM weld WHERE weld_date IS NULL OR weld_date < DATE '1995-06-01'),
wl AS (SELECT job_book_id, id, weld_number, welder_stamp, ndt_method, CASE WHEN ok % 8 = 0 THEN strftime(weld_date, '%-m/%-d/%Y') WHEN ok % 8 = 4 THEN strftime(weld_date, '%-m/%-d/%y') ELSE ndt_ticket_number END AS tk, xray_number, coalesce(nullif(trim(CASE WHEN ok % 8 = 0 THEN strftime(weld_date, '%-m/%-d/%Y') WHEN ok % 8 = 4 THEN strftime(weld_date, '%-m/%-d/%y') ELSE ndt_ticket_number END), ''), nullif(trim(xray_number), '')) AS ticket FROM n),
li AS (SELECT (l_suppkey % 25)::VARCHAR AS job_book_id, 'r' || l_orderkey AS report_id, 'w' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS line, l_shipdate::DATE AS report_date, CASE l_orderkey % 3 WHEN 0 THEN 'CREW' WHEN 1 THEN 'ZZ' END AS st, (l_orderkey % 400) || '.' || l_linenumber AS num, l_orderkey % 5 AS m FROM lineitem),
ca AS (SELECT *, unnest(CASE m WHEN 0 THEN [0, 1] WHEN 1 THEN [0] WHEN 2 THEN [0, 1] WHEN 3 THEN [0, 1] ELSE [0] END) AS pos FROM li),
pr AS (SELECT *, CASE WHEN m = 0 AND pos = 0 THEN 'x9999999' WHEN m = 0 THEN 'NP-0' || num WHEN m = 1 THEN 'W' || num WHEN m = 2 AND pos = 0 THEN 'no number' WHEN m = 2 THEN '1.1' WHEN m = 3 AND pos = 0 THEN '0' || num WHEN m = 3 THEN '1.2' ELSE '' END AS printed, CASE WHEN m = 0 AND pos = 0 THEN '9999999' WHEN m IN (0, 1) THEN num WHEN m = 2 AND pos = 0 THEN NULL WHEN m = 2 THEN '1.1' WHEN m = 3 AND pos = 0 THEN num WHEN m = 3 THEN '1.2' END AS k FROM ca),
ct AS (SELECT p.*, count(w.id) AS n, min(w.id) AS wid FROM pr p LEFT JOIN wl w ON w.job_book_id = p.job_book_id AND w.weld_number = p.k GROUP BY ALL),
jd AS (SELECT c.*, w.weld_number AS wn, CASE WHEN n = 0 THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' WHEN (st IS NOT NULL AND w.welder_stamp <> '' AND st = upper(w.welder_stamp)) OR (regexp_matches(w.ticket, '/[0-9][0-9][0-9][0-9]$') AND try_strptime(w.ticket, '%m/%d/%Y')::DATE = report_date) THEN 'confirmed' WHEN NOT (st IS NOT NULL AND coalesce(w.welder_stamp, '') <> '') AND w.ticket IS NULL THEN 'unchecked' ELSE 'unconfirmed' END AS status
  FROM ct c LEFT JOIN wl w ON n = 1 AND w.id = wid AND w.job_book_id = c.job_book_id),
ch AS (SELECT job_book_id, report_id, line, printed, CASE WHEN n = 1 THEN wid END AS weld_id, CASE WHEN n = 1 THEN wn WHEN n > 1 THEN k END AS weld_number, status, n AS n_candidates FROM jd WHERE status = 'confirmed' OR pos = 0 QUALIFY row_number() OVER (PARTITION BY job_book_id, report_id, line ORDER BY status <> 'confirmed', pos) = 1)"""


@bound("j15_chosen_welds", f"WITH {_LINES} SELECT * FROM ch")
def chosen(spark, sf_dir):
    return linking.chosen_welds(lines(spark, sf_dir), welds(spark, sf_dir))


@bound("a27_plan_counts", f"WITH {_LINES} SELECT job_book_id, count(DISTINCT report_id) AS reports, count(*) AS rows, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'unchecked') AS unchecked, count(*) FILTER (status = 'unconfirmed') AS unconfirmed, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'unmatched') AS unmatched, count(*) FILTER (status = 'confirmed') AS writable FROM ch GROUP BY 1")
def plan_counts(spark, sf_dir):
    return linking.plan_counts(chosen(spark, sf_dir), ["job_book_id"])


@bound("a27_evidenced_not_logged", f"WITH {_LINES} SELECT DISTINCT ch.job_book_id, weld_id, ch.weld_number FROM ch JOIN wl ON wl.id = weld_id AND wl.job_book_id = ch.job_book_id WHERE status <> 'unchecked' AND ndt_method IS NULL AND coalesce(tk, '') = '' AND coalesce(xray_number, '') = ''")
def evidenced_not_logged(spark, sf_dir):
    return linking.evidenced_not_logged(chosen(spark, sf_dir), welds(spark, sf_dir))


@bound("i13_methods", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'RT' WHEN 1 THEN 'UT' WHEN 2 THEN 'MT' END AS method FROM orders")
def methods(spark, sf_dir):
    k = F.col("o_orderkey")
    procedure = F.when(k % 5 == 0, "FDS rt-04 rev 2").when(k % 5 == 3, "PORT-7").when(k % 5 == 2, "mt")
    return read(spark, sf_dir, "orders").select("o_orderkey", linking.method_in(procedure, F.when(k % 5 == 1, F.concat(F.lit("UT-"), k)).otherwise("0412")).alias("method"))


def certificates(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    d = day("o_orderdate")
    return o.select(
        F.concat(F.lit("cert"), k).alias("file"), k.alias("place"), F.when(k % 23 != 0, F.concat(F.lit("B"), F.col("o_custkey") * 2 % 250)).alias("wrench_id"), F.when(k % 19 != 0, d).alias("date_calibrated"), F.when(k % 31 == 0, F.date_sub(d, 10)).when(k % 7 != 0, F.date_add(d, 365)).alias("due"), F.when(k % 11 == 0, "fail").when(k % 2 == 0, "pass").alias("final_status")
    )


_PLAN = f"""{ctes('torque_wrench', 'torque_connection')}, ce AS (SELECT 'cert' || o_orderkey AS file, o_orderkey AS place, CASE WHEN o_orderkey % 23 <> 0 THEN 'B' || (o_custkey * 2 % 250) END AS wrench_id, CASE WHEN o_orderkey % 19 <> 0 THEN o_orderdate::DATE END AS d, (CASE WHEN o_orderkey % 31 = 0 THEN o_orderdate::DATE - 10 WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE + 365 END)::DATE AS due, CASE WHEN o_orderkey % 11 = 0 THEN 'fail' WHEN o_orderkey % 2 = 0 THEN 'pass' END AS fs FROM orders),
us AS (SELECT wrench_id_raw AS w FROM torque_connection UNION SELECT t.wrench_id FROM torque_connection c JOIN torque_wrench t ON t.id = c.wrench_id),
m AS (SELECT ce.*, t.id AS tid, t.last_calibration_date AS onf, t.roster_claimed_calibration_date AS claimed, CASE WHEN ce.wrench_id IS NULL THEN 'no_serial' WHEN t.id IS NOT NULL THEN 'matched' WHEN ce.wrench_id IN (SELECT w FROM us) THEN 'new_wrench' ELSE 'unused' END AS match FROM ce LEFT JOIN torque_wrench t ON t.wrench_id = ce.wrench_id),
pp AS (SELECT m.*, greatest(onf, max(CASE WHEN match IN ('matched', 'new_wrench') AND fs IS DISTINCT FROM 'fail' AND (due IS NULL OR due >= d) THEN d END) OVER (PARTITION BY wrench_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS prior FROM m),
dp AS (SELECT *, CASE WHEN match = 'no_serial' THEN 'unread' WHEN d < prior THEN 'superseded' WHEN fs = 'fail' THEN 'failed' WHEN d IS NULL THEN 'unread' WHEN due < d THEN 'window_reversed' ELSE 'calibration' END AS disposition FROM pp),
pl AS (SELECT *, match IN ('matched', 'new_wrench') AND disposition NOT IN ('superseded', 'window_reversed') AS writable FROM dp),
uc AS (SELECT p.*, c.id AS cid, c.torque_date AS td, t.cert_on_file AS f, t.last_calibration_date AS s, t.calibration_due_date AS e FROM pl p JOIN torque_connection c ON c.wrench_id_raw = p.wrench_id OR c.wrench_id = p.tid LEFT JOIN torque_wrench t ON t.id = p.tid),
vv AS (SELECT *, CASE WHEN tid IS NULL THEN 'unknown' WHEN NOT f THEN 'none' WHEN s IS NULL THEN 'unread' WHEN td IS NULL THEN 'undated' WHEN td < s THEN 'early' WHEN td > e THEN 'expired' ELSE 'valid' END AS was, CASE WHEN d IS NULL THEN 'unread' WHEN td IS NULL THEN 'undated' WHEN td < d THEN 'early' WHEN td > due THEN 'expired' ELSE 'valid' END AS now_ FROM uc),
ef AS (SELECT file, count(*) AS connections, count(*) FILTER (writable AND disposition = 'calibration' AND was <> now_ AND now_ = 'valid') AS resolved, count(*) FILTER ((writable AND disposition = 'calibration' AND was <> now_ AND now_ IN ('expired', 'early')) OR (writable AND disposition = 'failed' AND td IS NOT NULL)) AS exposed FROM vv GROUP BY 1)"""


@bound("j27_calibration_plan", f"WITH {_PLAN} SELECT file, wrench_id, match, disposition, writable, prior, coalesce(claimed <> d, false) AS roster_disagrees, tid AS matched_id FROM pl")
def calibration_plan(spark, sf_dir):
    t = records(spark, sf_dir, "torque_wrench", "torque_connection")
    return linking.calibration_plan(certificates(spark, sf_dir), t["torque_wrench"], t["torque_connection"]).select("file", "wrench_id", "match", "disposition", "writable", "prior", "roster_disagrees", "matched_id")


@bound("a28_plan_effects", f"WITH {_PLAN} SELECT * FROM ef")
def plan_effects(spark, sf_dir):
    t = records(spark, sf_dir, "torque_wrench", "torque_connection")
    plan = linking.calibration_plan(certificates(spark, sf_dir), t["torque_wrench"], t["torque_connection"])
    return linking.plan_effects(plan, t["torque_wrench"], t["torque_connection"])


@bound("a27_calibration_counts", f"WITH {_PLAN} SELECT count(*) AS files, count(*) FILTER (writable) AS writes, count(*) FILTER (writable AND disposition = 'calibration') AS calibrations, count(*) FILTER (writable AND disposition = 'unread') AS unread, count(*) FILTER (NOT writable) AS held, count(DISTINCT wrench_id) FILTER (writable AND match = 'new_wrench') AS created, sum(resolved) FILTER (writable)::BIGINT AS resolved, sum(exposed) FILTER (writable)::BIGINT AS exposed FROM pl LEFT JOIN ef USING (file)")
def calibration_counts(spark, sf_dir):
    t = records(spark, sf_dir, "torque_wrench", "torque_connection")
    plan = linking.calibration_plan(certificates(spark, sf_dir), t["torque_wrench"], t["torque_connection"])
    return linking.calibration_counts(plan, linking.plan_effects(plan, t["torque_wrench"], t["torque_connection"]))
