"""Validity, credit rollups and completeness over orders and line items.

Customers stand for people, their orders for records of qualification, order keys for joints; residues of keys leave dates
out, so that every verdict occurs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import completeness, rollup, validity
from .bound import bound, date, day, read
from .records import ctes, records

_JOINTS = """j AS (SELECT l_orderkey % 10 AS book, list_distinct([l_suppkey, l_partkey % 100 + 1]) AS ps, l_returnflag = 'R' AS x,
  CASE WHEN l_linestatus = 'F' THEN 'pass' ELSE 'fail' END AS r, l_shipdate::DATE AS d FROM lineitem WHERE l_linenumber <> 7),
e AS (SELECT book, unnest(ps) AS person, x, r, d FROM j),
a1 AS (SELECT book, person, count(*) AS joints, count(*) FILTER (x) AS examined, count(*) FILTER (x AND r = 'pass') AS passed,
  count(*) FILTER (x AND r = 'fail') AS failed, min(d) AS first_day, max(d) AS last_day,
  round(least(1.0, count(*) FILTER (x) / count(*)) * 100, 2) AS examined_pct, count(*) FILTER (x) / count(*) * 100 < 33 AS below_minimum
  FROM e GROUP BY book, person)"""


def joints(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").where("l_linenumber <> 7").withColumn("book", F.col("l_orderkey") % 10)


def credit(spark, sf_dir):
    people = rollup.credited(F.lit(None).cast("bigint"), [F.col("l_suppkey"), F.col("l_partkey") % 100 + 1])
    result = F.when(F.col("l_linestatus") == "F", "pass").otherwise("fail")
    return rollup.credit_rollup(joints(spark, sf_dir), ["book"], people, F.col("l_returnflag") == "R", people, result, day("l_shipdate"), 33)


bound("a1_credit_rollup", f"WITH {_JOINTS} SELECT * FROM a1")(credit)


@bound("a1_exam_credit_by_rule", """
SELECT book, person, count(*) AS joints, count(*) FILTER (x AND list_contains(xp, person)) AS examined
FROM (SELECT o_orderkey % 10 AS book, unnest(ps) AS person, o_orderstatus = 'F' AS x,
  CASE o_orderkey % 3 WHEN 0 THEN [o_custkey % 50] WHEN 1 THEN [o_orderkey % 50] ELSE ps END AS xp
  FROM (SELECT *, list_distinct([o_custkey % 50, o_orderkey % 50]) AS ps FROM orders)) GROUP BY book, person""")
def exam_credit_by_rule(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("book", F.col("o_orderkey") % 10)
    none, passes = F.lit(None).cast("bigint"), [F.col("o_custkey") % 50, F.col("o_orderkey") % 50]
    rule = F.when(F.col("o_orderkey") % 3 == 0, "root_welder").when(F.col("o_orderkey") % 3 == 1, "cap_welder").otherwise("all")
    out = rollup.credit_rollup(o, ["book"], rollup.credited(none, passes), F.col("o_orderstatus") == "F", rollup.exam_credited(rule, none, passes), F.lit("pass"), day("o_orderdate"), 10)
    return out.select("book", "person", "joints", "examined")


@bound("a2_credit_totals", f"""WITH {_JOINTS} SELECT book, joints, credits, exam_credits, round((credits / joints - 1) * 100, 2) AS overstated_pct
FROM (SELECT book, count(*) AS joints FROM j GROUP BY book) JOIN (SELECT book, sum(joints)::BIGINT AS credits, sum(examined)::BIGINT AS exam_credits FROM a1 GROUP BY book) USING (book)""")
def credit_totals(spark, sf_dir):
    return rollup.credit_totals(joints(spark, sf_dir), credit(spark, sf_dir), ["book"])


@bound("a3_flat_rule", f"""WITH {_JOINTS} SELECT book, bool_and(examined_pct >= 20) AS all_meet, (array_agg(person ORDER BY examined_pct, person))[1] AS lowest_person,
min(examined_pct) AS lowest_pct FROM a1 GROUP BY book""")
def flat_rule(spark, sf_dir):
    return rollup.flat_rule(credit(spark, sf_dir), ["book"], 20)


@bound("a4_continuity", """SELECT l_suppkey, max(d) AS last_day, (DATE '1999-12-01' - max(d))::INTEGER AS days_since, (max(d) + 183)::DATE AS lapses_on, DATE '1999-12-01' > max(d) + 183 AS lapsed
FROM (SELECT l_suppkey, l_shipdate::DATE AS d FROM lineitem WHERE l_shipdate < DATE '1999-09-01' AND l_suppkey % 7 = l_orderkey % 7) GROUP BY l_suppkey""")
def continuity(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").where("l_shipdate < DATE'1999-09-01' AND l_suppkey % 7 = l_orderkey % 7").withColumn("d", day("l_shipdate"))
    return validity.continuity(li, ["l_suppkey"], "d", date("1999-12-01"))


@bound("a5_inspection_totals", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS inspected, round(count(*) FILTER (o_orderstatus = 'F') / count(*) * 100, 2) AS inspected_pct FROM orders GROUP BY o_orderpriority")
def inspection_totals(spark, sf_dir):
    return rollup.inspection_totals(read(spark, sf_dir, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "F")


_EVENTS = """ev AS (SELECT o_orderkey AS event, o_custkey AS who, (o_orderdate::DATE + (o_orderkey % 120)::INTEGER - 30)::DATE AS work_day, o_orderstatus AS method FROM orders),
win AS (SELECT o_custkey AS who, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS s, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderdate::DATE + 60)::DATE END AS e,
  CASE WHEN o_orderkey % 5 <> 0 THEN [o_orderstatus] END AS methods FROM orders WHERE o_orderkey % 3 = 0)"""


def _events(spark, sf_dir):
    shift = (F.col("o_orderkey") % 120 - 30).cast("int")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), F.col("o_custkey").alias("who"), F.date_add(day("o_orderdate"), shift).alias("work_day"), F.col("o_orderstatus").alias("method"))


def _windows(spark, sf_dir):
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").where(k % 3 == 0).select(
        F.col("o_custkey").alias("who"), F.when(k % 7 != 0, day("o_orderdate")).alias("s"), F.when(k % 11 != 0, F.date_add(day("o_orderdate"), 60)).alias("e"), F.when(k % 5 != 0, F.array("o_orderstatus")).alias("methods")
    )


@bound("j1_qualification_on_date", f"""WITH {_EVENTS} SELECT event, who, work_day, CASE WHEN n = 0 THEN 'no_record' WHEN covered THEN 'qualified' WHEN all_passed THEN 'expired' WHEN open_start THEN 'unverifiable' WHEN later THEN 'not_yet' ELSE 'expired' END AS verdict
FROM (SELECT event, ev.who, work_day, count(win.who) AS n, bool_or(s IS NOT NULL AND s <= work_day AND (e IS NULL OR e >= work_day)) AS covered, bool_and(coalesce(e < work_day, false)) AS all_passed,
  bool_or(win.who IS NOT NULL AND s IS NULL) AS open_start, bool_or(coalesce(s > work_day, false)) AS later FROM ev LEFT JOIN win ON win.who = ev.who GROUP BY ALL)""")
def qualification(spark, sf_dir):
    return validity.qualification_verdicts(_events(spark, sf_dir), _windows(spark, sf_dir), ["who"], "event", "work_day", "s", "e")


_INSIDE = "win.who IS NOT NULL AND (s IS NULL OR s <= work_day) AND (e IS NULL OR e >= work_day)"


@bound("j2_valid_on_date", f"""WITH {_EVENTS}, ok AS (SELECT event, s, e, {_INSIDE} AND s IS NOT NULL AS ok FROM ev LEFT JOIN win ON win.who = ev.who),
best AS (SELECT event, s, e FROM ok WHERE ok QUALIFY row_number() OVER (PARTITION BY event ORDER BY s DESC, e DESC NULLS LAST) = 1)
SELECT event, best.event IS NOT NULL AS valid, s AS valid_from, e AS valid_to FROM (SELECT DISTINCT event FROM ok) LEFT JOIN best USING (event)""")
def valid_on(spark, sf_dir):
    return validity.valid_on(_events(spark, sf_dir), _windows(spark, sf_dir).drop("methods"), ["who"], "event", "work_day", "s", "e")


@bound("j2_valid_on_date_open", f"""WITH {_EVENTS} SELECT event, coalesce(bool_or({_INSIDE}), false) AS valid FROM ev LEFT JOIN win ON win.who = ev.who GROUP BY event""")
def valid_on_open(spark, sf_dir):
    known = _windows(spark, sf_dir).drop("methods").withColumn("there", F.lit(True))
    return validity.valid_on(_events(spark, sf_dir), known, ["who"], "event", "work_day", "s", "e", strict=False, extra=F.coalesce("there", F.lit(False))).select("event", "valid")


@bound("j3_method_coverage", f"""WITH {_EVENTS}, x AS (SELECT event, method, methods, s IS NOT NULL AND {_INSIDE} AS live FROM ev LEFT JOIN win ON win.who = ev.who)
SELECT event, CASE WHEN bool_or(live AND coalesce(list_contains(methods, method), false)) THEN 'covered' WHEN bool_or(live AND methods IS NULL) THEN 'methods_unrecorded' WHEN bool_or(live) THEN 'method_not_covered' ELSE 'no_cert' END AS verdict,
coalesce(string_agg(DISTINCT CASE WHEN live THEN methods[1] END, ',' ORDER BY CASE WHEN live THEN methods[1] END), '') AS covers FROM x GROUP BY event""")
def method_coverage(spark, sf_dir):
    out = validity.method_coverage(_events(spark, sf_dir), _windows(spark, sf_dir), ["who"], "event", "work_day", "method", "s", "e", "methods")
    return out.withColumn("covers", F.array_join("covers", ","))


_TOOLS = """tools AS (SELECT c_custkey AS id, 'Brand#' || (c_custkey % 25) AS code, CASE WHEN c_custkey % 13 <> 0 THEN (DATE '1994-01-01' + (c_custkey % 1500)::INTEGER)::DATE END AS s,
  (DATE '1994-01-01' + (c_custkey % 1500)::INTEGER + 700)::DATE AS e, c_acctbal > 0 AS f FROM customer WHERE c_custkey % 3 <> 0),
used AS (SELECT o_orderkey AS event, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS ref, CASE WHEN o_orderkey % 5 <> 0 THEN 'Brand#' || (o_orderkey % 30) END AS code, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate::DATE END AS work_day FROM orders)"""


def calibrations(spark, sf_dir):
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    start = F.date_add(date("1994-01-01"), (c % 1500).cast("int"))
    tools = read(spark, sf_dir, "customer").where(c % 3 != 0).select(c.alias("id"), F.concat(F.lit("Brand#"), c % 25).alias("code"), F.when(c % 13 != 0, start).alias("s"), F.date_add(start, 700).alias("e"), (F.col("c_acctbal") > 0).alias("f"))
    used = read(spark, sf_dir, "orders").select(k.alias("event"), F.when(k % 4 != 0, F.col("o_custkey")).alias("ref"), F.when(k % 5 != 0, F.concat(F.lit("Brand#"), k % 30)).alias("raw"), F.when(k % 17 != 0, day("o_orderdate")).alias("work_day"))
    return validity.calibration_verdicts(used, tools, "event", "ref", "raw", "work_day", "id", "code", "s", "e", "f")


bound("j4_calibration_verdict", f"""WITH {_TOOLS}, first AS (SELECT * FROM tools QUALIFY row_number() OVER (PARTITION BY code ORDER BY id) = 1)
SELECT event, CASE WHEN ref IS NULL AND u.code IS NULL THEN 'no_wrench_recorded' WHEN coalesce(a.id, b.id) IS NULL THEN 'unknown_wrench' WHEN NOT (CASE WHEN a.id IS NOT NULL THEN a.f ELSE b.f END) THEN 'no_certificate'
  WHEN (CASE WHEN a.id IS NOT NULL THEN a.s ELSE b.s END) IS NULL THEN 'certificate_unread' WHEN work_day IS NULL THEN 'no_torque_date' WHEN work_day < (CASE WHEN a.id IS NOT NULL THEN a.s ELSE b.s END) THEN 'not_yet_issued'
  WHEN work_day > (CASE WHEN a.id IS NOT NULL THEN a.e ELSE b.e END) THEN 'expired' ELSE 'valid' END AS verdict,
  CASE WHEN a.id IS NOT NULL THEN a.s ELSE b.s END AS calibrated, CASE WHEN a.id IS NOT NULL THEN a.e ELSE b.e END AS due
FROM used u LEFT JOIN tools a ON a.id = u.ref LEFT JOIN first b ON b.code = u.code""")(calibrations)


@bound("j5_covered_throughout", f"""WITH {_EVENTS}, v AS (SELECT event, coalesce(bool_or({_INSIDE} AND s IS NOT NULL), false) AS valid FROM ev LEFT JOIN win ON win.who = ev.who GROUP BY event)
SELECT who, bool_and(valid) AS covered_throughout, count(*) FILTER (NOT valid) AS n_exposed FROM v JOIN ev USING (event) GROUP BY who""")
def covered_throughout(spark, sf_dir):
    v = valid_on(spark, sf_dir).join(_events(spark, sf_dir).select("event", "who"), "event")
    return validity.covered_throughout(v, ["who"])


@bound("f15_certificate_status", """SELECT o_orderkey, CASE WHEN e IS NULL THEN 'valid' WHEN e < DATE '1997-06-01' THEN 'expired' WHEN e - DATE '1997-06-01' <= 30 THEN 'expiring_soon' ELSE 'valid' END AS status
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderdate::DATE + 365)::DATE END AS e FROM orders)""")
def certificate_status(spark, sf_dir):
    e = F.when(F.col("o_orderkey") % 11 != 0, F.date_add(day("o_orderdate"), 365))
    return read(spark, sf_dir, "orders").select("o_orderkey", validity.certificate_status(e, date("1997-06-01"), 30).alias("status"))


@bound("f5_effective_expiry", """SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderdate::DATE + 365)::DATE WHEN o_orderkey % 2 = 0 THEN (o_orderdate::DATE + INTERVAL 6 MONTH)::DATE END AS expires,
o_orderkey % 11 = 0 AND o_orderkey % 2 = 0 AS derived FROM orders""")
def effective_expiry(spark, sf_dir):
    from ..functions.dates import effective_expiry, expiry_is_derived

    k, issued = F.col("o_orderkey"), day("o_orderdate")
    kind, expires = F.when(k % 2 == 0, "calibration").otherwise("card"), F.when(k % 11 != 0, F.date_add(issued, 365))
    return read(spark, sf_dir, "orders").select("o_orderkey", effective_expiry(kind, issued, expires, 6).alias("expires"), expiry_is_derived(kind, issued, expires).alias("derived"))


@bound("o5_expiry_calendar", "SELECT o_orderkey, (o_orderdate::DATE + 365)::DATE AS e, (o_orderdate::DATE + 365 - DATE '1997-06-01')::INTEGER AS days_left FROM orders WHERE o_orderdate::DATE + 365 BETWEEN DATE '1997-06-01' AND DATE '1997-08-30'")
def expiry_calendar(spark, sf_dir):
    certs = read(spark, sf_dir, "orders").select("o_orderkey", F.date_add(day("o_orderdate"), 365).alias("e"))
    return validity.expiry_calendar(certs, "e", date("1997-06-01"), 90).orderBy("days_left", "o_orderkey")


def missing_fields(spark, sf_dir):
    c = records(spark, sf_dir, "torque_connection")["torque_connection"]
    return c.select("job_book_id", "id", completeness.torque_missing().alias("missing"))


# What a connection lacks, label by label.
_SPEC = f"""{ctes('torque_connection')}, spec AS (SELECT job_book_id, id, list_filter([CASE WHEN required_torque_ft_lb IS NULL THEN 'required torque' END, CASE WHEN actual_torque_ft_lb IS NULL THEN 'actual torque' END,
  CASE WHEN wrench_id IS NULL AND coalesce(wrench_id_raw, '') = '' THEN 'wrench ID' END, CASE WHEN torque_date IS NULL THEN 'torque date' END, CASE WHEN trim(coalesce(employee_initials, '')) = '' THEN 'employee initials' END,
  CASE WHEN inspector_initials <> '' AND inspection_date IS NULL THEN 'inspection date' END, CASE WHEN (inspection_date IS NOT NULL OR inspector_initials <> '') AND trim(coalesce(inspector_initials, '')) = '' THEN 'inspector initials' END], lambda x: x IS NOT NULL) AS missing FROM torque_connection)"""


@bound("p9_missing_fields", f"WITH {_SPEC} SELECT id, array_to_string(missing, '; ') AS missing, len(missing) = 0 AS complete FROM spec")
def missing_joined(spark, sf_dir):
    return missing_fields(spark, sf_dir).select("id", F.array_join("missing", "; ").alias("missing"), (F.size("missing") == 0).alias("complete"))


@bound("a6_completeness_summary", f"WITH {_SPEC} SELECT job_book_id, count(*) AS n, count(*) FILTER (len(missing) = 0) AS n_complete, round(avg((len(missing) = 0)::INTEGER) * 100, 2) AS complete_pct FROM spec GROUP BY job_book_id")
def completeness_summary(spark, sf_dir):
    return completeness.summary(missing_fields(spark, sf_dir), ["job_book_id"])


@bound("a6_missing_histogram", f"WITH {_SPEC} SELECT job_book_id, field, count(*) AS n FROM (SELECT job_book_id, unnest(missing) AS field FROM spec) GROUP BY ALL")
def missing_histogram(spark, sf_dir):
    return completeness.missing_histogram(missing_fields(spark, sf_dir), ["job_book_id"])


@bound("o4_most_missing", f"WITH {_SPEC}, h AS (SELECT job_book_id, field, count(*) AS n FROM (SELECT job_book_id, unnest(missing) AS field FROM spec) GROUP BY ALL) SELECT job_book_id, field, n, (row_number() OVER (PARTITION BY job_book_id ORDER BY n DESC, field))::INTEGER AS place FROM h QUALIFY place <= 4")
def most_missing(spark, sf_dir):
    return completeness.most_missing(missing_histogram(spark, sf_dir), ["job_book_id"])


# The two shapes of weld logs; a weld without any facility field is a flowline's.
_WELDS = f"""{ctes('weld')}, w AS (SELECT *, coalesce(welder_stamp, '') <> '' OR welder_id IS NOT NULL OR construction_area IS NOT NULL OR isometric_number IS NOT NULL AS fac, ndt_method IS NOT NULL OR trim(coalesce(xray_number, '')) <> '' AS seen FROM weld)"""


@bound("p8_weld_completeness", f"""WITH {_WELDS} SELECT id, CASE WHEN status = 'not_used' THEN '' ELSE array_to_string(list_filter([CASE WHEN weld_date IS NULL THEN 'weld date' END,
  CASE WHEN fac AND trim(coalesce(welder_stamp, '')) = '' AND welder_id IS NULL THEN 'welder stamp' END, CASE WHEN fac AND isometric_number IS NULL THEN 'isometric number' END, CASE WHEN fac AND pipe_size_schedule IS NULL THEN 'pipe size / schedule' END,
  CASE WHEN fac AND pipe_grade IS NULL THEN 'pipe grade' END, CASE WHEN fac AND design_pressure_psi IS NULL THEN 'design pressure' END, CASE WHEN NOT fac AND root_welder_id IS NULL THEN 'root pass welder' END, CASE WHEN NOT fac AND hot_welder_id IS NULL THEN 'hot pass welder' END,
  CASE WHEN NOT fac AND fill_welder_id IS NULL THEN 'fill pass welder' END, CASE WHEN NOT fac AND cap_welder_id IS NULL THEN 'cap pass welder' END, CASE WHEN NOT fac AND component_description IS NULL THEN 'component description' END, CASE WHEN NOT fac AND len(heat_numbers) = 0 THEN 'heat numbers' END,
  CASE WHEN joint_type IS NULL THEN 'joint type' END, CASE WHEN trim(coalesce(cwi_initials, '')) = '' THEN 'CWI initials' END, CASE WHEN cwi_visual_result IS NULL THEN 'CWI visual result' END, CASE WHEN seen AND ndt_method IS NULL THEN 'NDT method' END,
  CASE WHEN seen AND ndt_result IS NULL THEN 'NDT result' END, CASE WHEN seen AND fac AND ndt_ticket_number IS NULL THEN 'NDT ticket number' END, CASE WHEN seen AND NOT fac AND ndt_report_id IS NULL THEN 'linked NDE report' END], lambda x: x IS NOT NULL), '; ') END AS missing FROM w""")
def weld_completeness(spark, sf_dir):
    return records(spark, sf_dir, "weld")["weld"].select("id", F.array_join(completeness.weld_missing(), "; ").alias("missing"))


@bound("p10_heat_completeness", f"WITH {ctes('material_heat')} SELECT id, array_to_string(list_filter([CASE WHEN mtr_document_id IS NULL THEN 'MTR document' END, CASE WHEN mtr_status = 'illegible' THEN 'legible MTR' END, CASE WHEN mtr_status = 'unidentified' THEN 'identified heat number on MTR' END], lambda x: x IS NOT NULL), '; ') AS missing FROM material_heat")
def heat_completeness(spark, sf_dir):
    return records(spark, sf_dir, "material_heat")["material_heat"].select("id", F.array_join(completeness.heat_missing(), "; ").alias("missing"))


@bound("p11_pressure_completeness", f"""WITH {ctes('pressure_test', 'certificate')} SELECT t.id, array_to_string(list_filter([CASE WHEN test_date IS NULL THEN 'test date' END, CASE WHEN test_pressure_psi IS NULL THEN 'test pressure' END, CASE WHEN duration_minutes IS NULL THEN 'duration' END, CASE WHEN result IS NULL THEN 'result' END,
  CASE WHEN chart_document_id IS NULL THEN 'recorder chart' END, CASE WHEN c.id IS NULL THEN 'recorder calibration certificate' WHEN test_date < issue_date OR test_date > expiry_date THEN 'recorder calibration valid on the test date' END], lambda x: x IS NOT NULL), '; ') AS missing
FROM pressure_test t LEFT JOIN certificate c ON c.id = recorder_cert_id""")
def pressure_completeness(spark, sf_dir):
    t = records(spark, sf_dir, "pressure_test", "certificate")
    return completeness.pressure_missing(t["pressure_test"], t["certificate"]).select("id", F.array_join("missing", "; ").alias("missing"))


@bound("p6_torque_tolerance", """SELECT l_returnflag, l_linenumber, count(*) FILTER (v) AS inside, count(*) FILTER (NOT v) AS outside, count(*) FILTER (v IS NULL) AS unknown FROM (SELECT l_returnflag, l_linenumber, CASE WHEN low IS NULL OR high IS NULL THEN NULL WHEN high > low THEN a BETWEEN low AND high WHEN low = 0 THEN a = 0 ELSE abs(a - low) / low * 100 <= 10 END AS v
FROM (SELECT l_returnflag, l_linenumber, l_quantity AS a, coalesce(CASE WHEN l_returnflag = 'A' THEN 10.0 END, pt) AS low, coalesce(CASE WHEN l_returnflag = 'A' THEN 40.0 END, pt) AS high
  FROM (SELECT *, CASE WHEN l_linenumber <> 1 THEN (25 + l_linenumber)::DOUBLE END AS pt FROM lineitem))) GROUP BY ALL""")
def torque_tolerance(spark, sf_dir):
    point = F.when(F.col("l_linenumber") != 1, (F.col("l_linenumber") + 25).cast("double"))
    ranged = F.col("l_returnflag") == "A"
    v = completeness.within_tolerance(F.col("l_quantity"), point, F.when(ranged, 10.0), F.when(ranged, 40.0), F.lit(10))
    out = read(spark, sf_dir, "lineitem").withColumn("v", v).groupBy("l_returnflag", "l_linenumber")
    return out.agg(F.count_if("v").alias("inside"), F.count_if(~F.col("v")).alias("outside"), F.count_if(F.col("v").isNull()).alias("unknown"))
