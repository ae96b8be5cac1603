"""Searches, validations and previews over parts, customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import heat_key
from ..operators import access, validity
from ..sources.readers import hold_outcome
from .bound import bound, date, day, read


@bound("p18_log_search", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_brand) LIKE '%ring%' OR lower(p_type) LIKE '%ring%'")
def log_search(spark, sf_dir):
    return access.searched(read(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"], " RING ").select("p_partkey", "p_name")


@bound("p16_visible_books", "SELECT c_custkey, person FROM (SELECT c_custkey, c_nationkey % 10 AS person FROM customer WHERE c_acctbal > 5000 UNION SELECT c_custkey, c_custkey % 10 FROM customer UNION SELECT o_custkey, o_orderkey % 10 FROM orders WHERE o_orderstatus = 'P')")
def visible_books(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    person = lambda df, x: df.select("c_custkey", (F.col(x) % 10).cast("long").alias("person"))
    granted = o.where("o_orderstatus = 'P'").withColumn("c_custkey", F.col("o_custkey"))
    return access.visible(c.select("c_custkey"), "c_custkey", person(c.where("c_acctbal > 5000"), "c_nationkey"), person(c, "c_custkey"), person(granted, "o_orderkey"), "person")


@bound("p24_request_problems", """SELECT c_custkey, unnest(list_filter([CASE WHEN c_acctbal <= 0 THEN 'empty file' END, CASE WHEN c_acctbal > 9000 THEN 'too large' END, CASE WHEN c_custkey % 6 = 0 THEN 'unknown type' END], lambda x: x IS NOT NULL)) AS problem FROM customer""")
def request_problems(spark, sf_dir):
    b = F.col("c_acctbal")
    checks = [("empty file", b > 0), ("too large", b <= 9000), ("unknown type", F.when(F.col("c_custkey") % 6 != 0, True))]
    return access.problems(read(spark, sf_dir, "customer"), ["c_custkey"], checks)


@bound("j17_library_links", """WITH l AS (SELECT p_name AS k, bool_or(p_size % 4 <> 0) AS live, bool_or(p_size % 4 = 0) AS gone FROM part WHERE p_size < 8 GROUP BY p_name)
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND live THEN 'on_file' WHEN p_partkey % 2 = 1 AND gone AND NOT live THEN 'missing' WHEN p_partkey % 2 = 0 THEN 'missing' ELSE 'on_file' END AS status_after FROM part LEFT JOIN l ON p_name = k""")
def library_links(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("key", heat_key(F.col("p_name")))
    heats = p.select("p_partkey", "key", F.when(F.col("p_partkey") % 2 == 0, "missing").otherwise("on_file").alias("status"))
    return access.library_links(heats, p.where("p_size < 8").select("key", "p_size"), "key", "status", F.col("p_size") % 4 == 0).select("p_partkey", "status_after")


_V = "CASE WHEN {s} IS NULL THEN 'unread' WHEN d < {s} THEN 'not_yet' WHEN d > {s} + 700 THEN 'expired' ELSE 'valid' END"


@bound("a28_effect_preview", f"""WITH x AS (SELECT o_orderkey, o_orderdate::DATE AS d, (DATE '1994-01-01' + (o_custkey % 1500)::INTEGER)::DATE AS s, CASE WHEN o_custkey % 5 = 0 THEN (DATE '1994-01-01' + (o_custkey % 1500)::INTEGER + 400)::DATE ELSE (DATE '1994-01-01' + (o_custkey % 1500)::INTEGER)::DATE END AS s2 FROM orders),
v AS (SELECT {_V.format(s='s')} AS b, {_V.format(s='s2')} AS a FROM x) SELECT count(*) FILTER (b <> 'valid' AND a = 'valid') AS resolved, count(*) FILTER (b = 'valid' AND a <> 'valid') AS exposed, count(*) FILTER (a = b) AS unchanged FROM v""")
def effect_preview(spark, sf_dir):
    c = F.col("c_custkey")
    used = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), F.col("o_custkey").alias("ref"), F.lit(None).cast("string").alias("raw"), day("o_orderdate").alias("d"))

    def verdicts(shift):
        start = F.date_add(date("1994-01-01"), (c % 1500).cast("int") + shift)
        tools = read(spark, sf_dir, "customer").select(c.alias("id"), F.col("c_name").alias("code"), start.alias("s"), F.date_add(start, 700).alias("e"), F.lit(True).alias("f"))
        return validity.calibration_verdicts(used, tools, "event", "ref", "raw", "d", "id", "code", "s", "e", "f")

    return access.effect(verdicts(F.lit(0)), verdicts(F.when(c % 5 == 0, 400).otherwise(0)), "event")


@bound("a31_work_after_expiry", """WITH c AS (SELECT o_orderkey AS cert, o_custkey AS who, (o_orderdate::DATE + 365)::DATE AS e FROM orders WHERE o_orderkey % 10 = 0)
SELECT cert, count(*) FILTER (o.o_orderdate::DATE > e) AS n_after, max(CASE WHEN o.o_orderdate::DATE > e THEN o.o_orderdate::DATE END) AS last_after FROM c LEFT JOIN orders o ON o.o_custkey = who GROUP BY cert""")
def work_after_expiry(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("d", day("o_orderdate"))
    certs = o.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("cert"), F.col("o_custkey").alias("who"), F.date_add("d", 365).alias("e"))
    return access.work_after_expiry(certs, o.select(F.col("o_custkey").alias("who"), "d"), "cert", "who", "e", "d")


@bound("f16_hold_outcome", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN a IS NULL OR (a = 0 AND b = 0) THEN NULL WHEN b < a - 1 THEN 'dropped' WHEN b > a + 1 THEN 'rose' ELSE 'held' END AS outcome
FROM (SELECT *, CASE WHEN l_linenumber <> 7 THEN CASE WHEN l_linenumber = 6 THEN 0.0 ELSE 25.0 END END AS a, CASE WHEN l_linenumber = 6 THEN 0.0 ELSE l_quantity END AS b FROM lineitem)""")
def hold_outcomes(spark, sf_dir):
    six, seven = F.col("l_linenumber") == 6, F.col("l_linenumber") == 7
    a, b = F.when(~seven, F.when(six, 0.0).otherwise(25.0)), F.when(six, 0.0).otherwise(F.col("l_quantity"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", hold_outcome(a, b, 1.0).alias("outcome"))
