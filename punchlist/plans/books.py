"""Timeliness, scores and gates over orders: priorities stand for sections, order dates for work, later days for entry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import gates, scoring, timeliness
from .bound import bound, date, day, read

# Working days in SQL: a generated calendar with a running count, independent of the arithmetic that is compared with it.
_CAL = """cal AS (SELECT d, w, sum(w::INTEGER) OVER (ORDER BY d)::INTEGER AS i FROM (SELECT d::DATE AS d, isodow(d) <= 5 AS w FROM generate_series(DATE '1990-01-01', DATE '2005-12-31', INTERVAL 1 DAY) t(d))),
days AS (SELECT d, i, w FROM cal), nextday AS (SELECT i, min(d) AS d FROM cal WHERE w GROUP BY i)"""
_WORK = f"""{_CAL}, ev AS (SELECT o_orderkey, o_custkey % 20 AS book, o_orderpriority, o_orderdate::DATE AS work, CASE WHEN o_orderkey % 23 <> 0 THEN (o_orderdate::DATE + (o_orderkey % 9 - 1)::INTEGER)::DATE END AS entered,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderpriority = '5-LOW' THEN 'bulk_import' ELSE 'field_entry' END AS source, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 5 ELSE -1 END AS n FROM orders),
due AS (SELECT ev.*, CASE WHEN n = 0 THEN (SELECT NULL) END AS z, x.d AS due FROM ev LEFT JOIN days c ON c.d = ev.work LEFT JOIN nextday x ON x.i = c.i + CASE WHEN n = 0 AND c.w THEN 0 WHEN n = 0 THEN 1 ELSE n END),
f14 AS (SELECT o_orderkey, book, o_orderpriority, work, entered, CASE WHEN n = -1 THEN 'precondition' WHEN source = 'bulk_import' OR entered IS NULL OR source IS NULL THEN 'unmeasurable' WHEN entered < work THEN 'entered_before_work'
  WHEN entered <= due THEN 'on_time' ELSE 'late' END AS verdict, due FROM due),
f AS (SELECT o_orderkey, book, o_orderpriority, work, entered, verdict, CASE WHEN verdict IN ('on_time', 'late') THEN due END AS due_by, CASE WHEN verdict = 'late' THEN b.i - a.i WHEN verdict = 'on_time' THEN 0 END AS days_late
  FROM f14 LEFT JOIN days a ON a.d = f14.due LEFT JOIN days b ON b.d = f14.entered)"""
_RATE = """count(*) FILTER (verdict = 'on_time') AS on_time, count(*) FILTER (verdict = 'late') AS late, count(*) FILTER (verdict = 'unmeasurable') AS unmeasurable, count(*) FILTER (verdict = 'precondition') AS precondition,
count(*) FILTER (verdict = 'entered_before_work') AS before_work, CASE WHEN count(*) FILTER (verdict IN ('on_time', 'late')) > 0 THEN round(count(*) FILTER (verdict = 'on_time') / count(*) FILTER (verdict IN ('on_time', 'late')) * 100, 2) END AS rate_pct"""


def entries(spark, sf_dir):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 20).alias("book"), "o_orderpriority", day("o_orderdate").alias("work"), F.when(k % 23 != 0, F.date_add(day("o_orderdate"), (k % 9 - 1).cast("int"))).alias("entered"),
        F.when(k % 19 == 0, F.lit(None)).when(p == "5-LOW", "bulk_import").otherwise("field_entry").alias("source"),
        F.when(p == "1-URGENT", 0).when(p == "2-HIGH", 1).when(p == "3-MEDIUM", 3).when(p == "5-LOW", 5).otherwise(-1).alias("allowed"),
    )
    return timeliness.assessed(o, F.col("work"), F.col("entered"), F.col("source"), F.col("allowed"), "mon_fri").drop("source", "allowed")


bound("f14_entry_verdict", f"WITH {_WORK} SELECT * FROM f")(entries)


@bound("a13_timeliness_rate", f"WITH {_WORK} SELECT book, {_RATE} FROM f GROUP BY book")
def rate(spark, sf_dir):
    return timeliness.rates(entries(spark, sf_dir), ["book"])


@bound("a14_rate_by_standard", f"WITH {_WORK} SELECT o_orderpriority, {_RATE} FROM f GROUP BY o_orderpriority")
def rate_by_standard(spark, sf_dir):
    return timeliness.rates(entries(spark, sf_dir), ["o_orderpriority"])


@bound("w1_weekly_timeliness", f"WITH {_WORK} SELECT book, date_trunc('week', entered)::DATE AS week, {_RATE} FROM f WHERE entered IS NOT NULL GROUP BY ALL")
def weekly(spark, sf_dir):
    return timeliness.weekly(entries(spark, sf_dir), ["book"], "entered")


@bound("w2_escalations", f"""WITH {_WORK}, w AS (SELECT book, date_trunc('week', entered)::DATE AS week, {_RATE} FROM f WHERE entered IS NOT NULL GROUP BY ALL), m AS (SELECT *, lag(rate_pct) OVER (PARTITION BY book ORDER BY week) AS previous_pct FROM w WHERE rate_pct IS NOT NULL)
SELECT book, week, rate_pct, previous_pct FROM m WHERE rate_pct < 90 AND previous_pct < 90""")
def escalations(spark, sf_dir):
    return timeliness.escalations(weekly(spark, sf_dir), ["book"])


@bound("o7_late_entries", f"WITH {_WORK} SELECT o_orderkey, days_late FROM f WHERE verdict = 'late' ORDER BY days_late DESC, o_orderkey LIMIT 100")
def late_entries(spark, sf_dir):
    return entries(spark, sf_dir).where("verdict = 'late'").select("o_orderkey", "days_late").orderBy(F.desc("days_late"), "o_orderkey").limit(100)


@bound("f12_add_business_days", f"WITH {_CAL} SELECT DISTINCT o_orderdate::DATE AS day, a.d AS plus_3, (SELECT min(d) FROM cal WHERE w AND cal.d >= o_orderdate::DATE) AS same FROM orders JOIN days c ON c.d = o_orderdate::DATE JOIN nextday a ON a.i = c.i + 3")
def add_business_days(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(day("o_orderdate").alias("day")).distinct()
    return o.select("day", dates.add_business_days(F.col("day"), 3, "mon_fri").alias("plus_3"), dates.add_business_days(F.col("day"), 0, "mon_fri").alias("same"))


@bound("f13_business_days_between", f"WITH {_CAL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, (b.i - a.i)::INTEGER AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN days a ON a.d = o_orderdate::DATE JOIN days b ON b.d = l_shipdate::DATE")
def business_days_between(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), day("o_orderdate").alias("from_day"))
    li = read(spark, sf_dir, "lineitem").join(o, "l_orderkey")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", dates.business_days_between(F.col("from_day"), day("l_shipdate"), "mon_fri").alias("days"))


@bound("f12_calendar", f"WITH {_CAL} SELECT DISTINCT o_orderdate::DATE AS day, w AS working FROM orders JOIN days ON d = o_orderdate::DATE")
def calendar(spark, sf_dir):
    cal = dates.calendar(spark, "1990-01-01", "2005-12-31")
    return read(spark, sf_dir, "orders").select(day("o_orderdate").alias("day")).distinct().join(cal, "day").select("day", "working")


@bound("w13_self_audits_due", f"WITH {_CAL} SELECT o_orderkey, greatest(0, floor((b.i - a.i) / 10))::INTEGER AS due FROM orders JOIN days a ON a.d = o_orderdate::DATE JOIN days b ON b.d = DATE '1999-03-01'")
def self_audits(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", timeliness.self_audits_due(day("o_orderdate"), date("1999-03-01"), "mon_fri").alias("due"))


_SEC = """sec AS (SELECT book, o_orderpriority, CASE WHEN (book + length(o_orderpriority)) % 3 <> 0 THEN 160 END AS declared, substr(o_orderpriority, 1, 1)::INTEGER * 10 AS weight, book % 4 <> 0 OR o_orderpriority <> '5-LOW' AS was_read
  FROM (SELECT DISTINCT o_custkey % 20 AS book, o_orderpriority FROM orders)),
fact AS (SELECT o_custkey % 20 AS book, o_orderpriority, count(*) AS entered, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY ALL),
a8 AS (SELECT book, o_orderpriority, declared, weight, was_read, entered, done, CASE WHEN declared IS NULL THEN entered ELSE greatest(declared, entered) END AS scope, round(least(1.0, done / CASE WHEN declared IS NULL THEN entered ELSE greatest(declared, entered) END) * 100, 2) AS pct FROM sec JOIN fact USING (book, o_orderpriority)),
a9 AS (SELECT book, round(sum(weight * pct) / sum(weight), 2) AS score, count(*) AS n_counted, round(sum(weight) FILTER (was_read) / sum(weight) * 100, 2) AS evidence_pct, bool_or(NOT was_read) AS lower_bound FROM a8 GROUP BY book)"""


def sections(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("book", F.col("o_custkey") % 20)
    facts = o.groupBy("book", "o_orderpriority").agg(F.count(F.lit(1)).alias("entered"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    p = F.col("o_orderpriority")
    sec = o.select("book", "o_orderpriority").distinct().select("book", "o_orderpriority", F.when((F.col("book") + F.length(p)) % 3 != 0, 160).alias("declared"), (F.substring(p, 1, 1).cast("int") * 10).alias("weight"), ((F.col("book") % 4 != 0) | (p != "5-LOW")).alias("was_read"))
    return scoring.section_scores(sec, facts, ["book", "o_orderpriority"], "declared")


bound("a8_section_scores", f"WITH {_SEC} SELECT * FROM a8")(sections)


@bound("a9_book_scores", f"WITH {_SEC} SELECT *, CASE WHEN score >= 95 THEN 'complete' WHEN score >= 75 THEN 'near' WHEN score >= 50 THEN 'partial' ELSE 'early' END AS band FROM a9")
def books(spark, sf_dir):
    return scoring.book_scores(sections(spark, sf_dir), ["book"], read=F.col("was_read"))


@bound("a10_weight_loss", f"WITH {_SEC} SELECT book, o_orderpriority, round(weight * (100 - pct) / 100, 4) AS loss FROM a8")
def weight_loss(spark, sf_dir):
    return scoring.weight_loss(sections(spark, sf_dir)).select("book", "o_orderpriority", "loss").orderBy(F.desc("loss"), "book", "o_orderpriority")


@bound("s8_stale_scores", f"WITH {_SEC} SELECT book, o_orderpriority, c.pct AS cached_pct, a8.pct FROM a8 FULL JOIN (SELECT book, o_orderpriority, round(pct + CASE WHEN book % 3 = 0 THEN 0.5 ELSE 0 END, 2) AS pct FROM a8 WHERE book <> 7) c USING (book, o_orderpriority) WHERE c.pct IS NULL OR a8.pct IS NULL OR abs(c.pct - a8.pct) > 0.005")
def stale_scores(spark, sf_dir):
    fresh = sections(spark, sf_dir).select("book", "o_orderpriority", "pct")
    cached = fresh.where("book <> 7").select("book", "o_orderpriority", F.round(F.col("pct") + F.when(F.col("book") % 3 == 0, 0.5).otherwise(0), 2).alias("cached_pct"))
    return scoring.stale(cached, fresh, ["book", "o_orderpriority"], "cached_pct", "pct")


_GATE = f"""{_WORK}, {_SEC}, t AS (SELECT book, {_RATE} FROM f GROUP BY book),
crit AS (SELECT book, 'G1' AS gate, 'curve' AS id, CASE WHEN score >= 25 THEN 'met' ELSE 'not_met' END AS state FROM a9
  UNION ALL SELECT book, 'G1', 'timeliness', CASE WHEN rate_pct IS NULL THEN 'indeterminate' WHEN rate_pct >= 40 THEN 'met' ELSE 'not_met' END FROM t
  UNION ALL SELECT book, 'G1', 'heats', CASE WHEN count(*) = 0 THEN 'not_applicable' WHEN bool_and(was_read) THEN 'met' ELSE 'indeterminate' END FROM a8 GROUP BY book
  UNION ALL SELECT book, 'G2', 'curve', CASE WHEN score >= 35 THEN 'met' ELSE 'not_met' END FROM a9),
g1 AS (SELECT * FROM crit UNION ALL SELECT book, 'G2', 'gate1_sustained', CASE WHEN bool_or(state = 'not_met') THEN 'not_met' WHEN bool_or(state = 'indeterminate') THEN 'indeterminate' ELSE 'met' END FROM crit WHERE gate = 'G1' GROUP BY book)"""


def criteria(spark, sf_dir) -> DataFrame:
    score, rates = books(spark, sf_dir), rate(spark, sf_dir)
    read_all = sections(spark, sf_dir).groupBy("book").agg(F.bool_and("was_read").alias("known"))
    first = [
        gates.criterion(score, ["book"], "G1", "curve", gates.at_least(F.col("score"), 25)),
        gates.criterion(rates, ["book"], "G1", "timeliness", gates.at_least(F.col("rate_pct"), 40)),
        gates.criterion(read_all, ["book"], "G1", "heats", F.when(F.col("known"), "met").otherwise("indeterminate")),
    ]
    g1 = reduce(DataFrame.unionByName, first)
    return g1.unionByName(gates.criterion(score, ["book"], "G2", "curve", gates.at_least(F.col("score"), 35))).unionByName(gates.sustained(g1, ["book"], "G1", "G2", "gate1_sustained"))


bound("g1_g2_criteria", f"WITH {_GATE} SELECT * FROM g1")(criteria)


@bound("a17_gate_counts", f"""WITH {_GATE} SELECT book, gate, count(*) FILTER (state = 'met') AS met, count(*) FILTER (state = 'not_met') AS not_met, count(*) FILTER (state = 'indeterminate') AS indeterminate, count(*) FILTER (state = 'not_applicable') AS not_applicable,
count(*) FILTER (state IN ('not_met', 'indeterminate')) = 0 AS would_pass FROM g1 GROUP BY book, gate""")
def gate_counts(spark, sf_dir):
    return gates.evaluated(criteria(spark, sf_dir), ["book"])


_REV = "rev AS (SELECT o_custkey AS book, 'G' || (o_orderkey % 6) AS gate, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'O' THEN 'pass' ELSE 'conditional' END AS outcome, o_orderdate::DATE AS due FROM orders)"


def reviews(spark, sf_dir):
    outcome = F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "O", "pass").otherwise("conditional")
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), F.concat(F.lit("G"), F.col("o_orderkey") % 6).alias("gate"), F.col("o_orderkey").alias("seq"), outcome.alias("outcome"), day("o_orderdate").alias("due"))


@bound("a18_gate_history", f"""WITH {_REV} SELECT book, max(gate) FILTER (outcome = 'pass') AS current_gate, count(DISTINCT CASE WHEN fails >= 2 THEN gate END) AS repeat_failures, count(*) FILTER (outcome = 'conditional' AND due < DATE '1997-01-01') AS lapsed
FROM (SELECT *, count(*) FILTER (outcome = 'fail') OVER (PARTITION BY book, gate) AS fails FROM rev) GROUP BY book""")
def gate_history(spark, sf_dir):
    return gates.history(reviews(spark, sf_dir), ["book"], date("1997-01-01"))


@bound("w8_attempts", f"WITH {_REV} SELECT book, gate, seq, row_number() OVER (PARTITION BY book, gate ORDER BY seq)::INTEGER AS attempt FROM rev")
def attempts(spark, sf_dir):
    from ..operators.history import attempts

    return attempts(reviews(spark, sf_dir).select("book", "gate", "seq"), ["book", "gate"], ["seq"])


@bound("a19_portfolio_summary", f"WITH {_WORK}, {_SEC}, t AS (SELECT book, {_RATE} FROM f GROUP BY book) SELECT book, score, evidence_pct, rate_pct, late FROM a9 JOIN t USING (book)")
def portfolio_summary(spark, sf_dir):
    return books(spark, sf_dir).join(rate(spark, sf_dir), "book").select("book", "score", "evidence_pct", "rate_pct", "late")
