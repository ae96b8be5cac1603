"""Registers against each other, lookups, duplicates, findings and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import reconcile, rollup
from .bound import bound, day, read

_SETS = """u AS (SELECT l_partkey AS key, 'used' AS s FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT p_partkey, 'roster' FROM part WHERE p_size <= 25 UNION ALL SELECT p_partkey, 'certified' FROM part WHERE p_retailprice < 1200),
m AS (SELECT key, count(*) FILTER (s = 'used') AS n_used, count(*) FILTER (s = 'roster') AS n_roster, count(*) FILTER (s = 'certified') AS n_certified FROM u GROUP BY key)"""


def three_way(spark, sf_dir):
    li, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    return reconcile.membership({"used": (li.where("l_quantity > 45"), F.col("l_partkey")), "roster": (p.where("p_size <= 25"), F.col("p_partkey")), "certified": (p.where("p_retailprice < 1200"), F.col("p_partkey"))})


bound("j9_three_way_membership", f"WITH {_SETS} SELECT *, n_used > 0 AS in_used, n_roster > 0 AS in_roster, n_certified > 0 AS in_certified FROM m")(three_way)


@bound("j6_two_way_coverage", f"""WITH {_SETS} SELECT count(*) FILTER (n_used > 0) AS needed, count(*) FILTER (n_used > 0 AND n_certified > 0) AS covered, count(*) FILTER (n_used > 0 AND n_certified = 0) AS missing,
count(*) FILTER (n_used = 0 AND n_certified > 0) AS extraneous, round(count(*) FILTER (n_used > 0 AND n_certified > 0) / count(*) FILTER (n_used > 0) * 100, 2) AS covered_pct FROM m""")
def two_way(spark, sf_dir):
    return reconcile.coverage(three_way(spark, sf_dir), "used", "certified")


@bound("j10_unevidenced", """SELECT l_suppkey, count(*) AS examined, count(*) FILTER (e.o_orderkey IS NOT NULL) AS evidenced, count(*) FILTER (e.o_orderkey IS NULL) AS unevidenced
FROM lineitem LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F') e ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY l_suppkey""")
def unevidenced(spark, sf_dir):
    evidence = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("e"))
    rows = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(evidence, "l_orderkey", "left")
    return rows.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("examined"), F.count("e").alias("evidenced"), F.count_if(F.col("e").isNull()).alias("unevidenced"))


@bound("j13_weld_number_match", """WITH t AS (SELECT (p_partkey // 2)::VARCHAR AS k, count(*) AS n, min(p_partkey) AS first FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1)
SELECT o_orderkey, CASE WHEN coalesce(n, 0) = 0 THEN 'unknown' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS verdict, coalesce(n, 0) AS n_candidates, CASE WHEN n = 1 THEN first END AS "match" FROM orders LEFT JOIN t ON (o_orderkey % 2500)::VARCHAR = t.k""")
def weld_number_match(spark, sf_dir):
    probe = keys.weld_number_key(F.concat(F.lit("W-0"), F.col("o_orderkey") % 2500, F.lit("A")))
    targets = read(spark, sf_dir, "part").where("p_partkey % 5 <> 0")
    key = keys.weld_number_key(F.floor(F.col("p_partkey") / 2).cast("string"))
    return reconcile.multiplicity(read(spark, sf_dir, "orders"), probe, targets, key, "o_orderkey", "p_partkey")


@bound("j16_name_resolution", """WITH r AS (SELECT s_suppkey AS id, 0 AS rank, 'S' || (s_suppkey % 60) AS k FROM supplier UNION ALL SELECT s_suppkey, 1, 'S' || (s_nationkey + 50) FROM supplier)
SELECT o_orderkey, b.id AS resolved, b.rank AS rank FROM orders LEFT JOIN (SELECT k, id, rank FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY rank, id) = 1) b ON 'S' || (o_orderkey % 100) = b.k""")
def name_resolution(spark, sf_dir):
    names = [F.concat(F.lit("S"), F.col("s_suppkey") % 60), F.concat(F.lit("S"), F.col("s_nationkey") + 50)]
    return reconcile.resolve(read(spark, sf_dir, "orders"), "o_orderkey", F.concat(F.lit("S"), F.col("o_orderkey") % 100), read(spark, sf_dir, "supplier"), "s_suppkey", names)


@bound("j21_bands", "SELECT CASE WHEN p_retailprice < 950 THEN 'low' WHEN p_retailprice < 1100 THEN 'middle' ELSE 'high' END AS band, count(*) AS n, min(p_retailprice) AS least, max(p_retailprice) AS most FROM part GROUP BY 1")
def bands(spark, sf_dir):
    b = reconcile.band(F.col("p_retailprice"), [(0, 950, "low"), (950, 1100, "middle"), (1100, None, "high")])
    return read(spark, sf_dir, "part").groupBy(b.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.min("p_retailprice").alias("least"), F.max("p_retailprice").alias("most"))


@bound("j23_typo_suggestion", """WITH u AS (SELECT DISTINCT lpad((o_custkey % 3000)::VARCHAR, 4, '0') AS code FROM orders), k AS (SELECT lpad((p_partkey * 37 % 10000)::VARCHAR, 4, '0') AS known, p_partkey AS ord FROM part),
c AS (SELECT code, known, CASE WHEN hamming(code, known) = 1 THEN '1' ELSE '2' END AS kind, ord FROM u JOIN k ON code <> known AND length(code) = length(known) AND (hamming(code, known) = 1 OR list_sort(string_split(code, '')) = list_sort(string_split(known, ''))))
SELECT code, min({kind: kind, ord: ord, known: known}).known AS suggestion FROM u LEFT JOIN c USING (code) GROUP BY code""")
def typo(spark, sf_dir):
    u = read(spark, sf_dir, "orders").select(F.lpad((F.col("o_custkey") % 3000).cast("string"), 4, "0").alias("code"))
    k = read(spark, sf_dir, "part").select(F.lpad((F.col("p_partkey") * 37 % 10000).cast("string"), 4, "0").alias("tool"), F.col("p_partkey").alias("ord"))
    return reconcile.typo_suggestions(u, "code", k, "tool", "ord")


@bound("j19_missing_definitions", "SELECT n_nationkey, c_mktsegment FROM (SELECT n_nationkey FROM nation), (SELECT DISTINCT c_mktsegment FROM customer) EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 8 = 0")
def missing_definitions(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    template = read(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*[F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])).alias("c_mktsegment"))
    return template.join(c.where("c_custkey % 8 = 0").select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment"), ["n_nationkey", "c_mktsegment"], "left_anti")


@bound("j24_digest_rows", """SELECT r_name, n_name, count(*) AS n, count(DISTINCT o_custkey) AS people, min(o_orderdate::DATE) AS oldest FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderstatus = 'P' AND c_acctbal > 0 GROUP BY ALL""")
def digest_rows(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    c = read(spark, sf_dir, "customer").where("c_acctbal > 0")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("people"), F.min(day("o_orderdate")).alias("oldest"))


@bound("j29_portfolio", "SELECT r_name, count(c_custkey) AS books FROM region LEFT JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY r_name")
def portfolio(spark, sf_dir):
    r, n, c = (read(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    return r.join(n, r.r_regionkey == n.n_regionkey, "left").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("r_name").agg(F.count("c_custkey").alias("books"))


@bound("a7_tier_rollup", """SELECT p_brand, count(v) AS computed, count(*) FILTER (v IS NULL) AS uncomputable, count(*) FILTER (v < 5) AS below, count(*) FILTER (v >= 5) AS required, round(max(v), 4) AS most, count(*) FILTER (v >= 5 AND d) AS met,
count(*) FILTER (v >= 5) - count(*) FILTER (v >= 5 AND d) AS shortfall FROM (SELECT p_brand, CASE WHEN p_size % 9 <> 0 THEN p_retailprice / (p_size * 10) END AS v, p_partkey % 3 = 0 AS d FROM part) GROUP BY p_brand""")
def tiers(spark, sf_dir):
    v = F.when(F.col("p_size") % 9 != 0, F.col("p_retailprice") / (F.col("p_size") * 10))
    return rollup.tier_rollup(read(spark, sf_dir, "part"), ["p_brand"], v, 5, F.col("p_partkey") % 3 == 0)


@bound("a21_divisions", "SELECT c_mktsegment, count(*) FILTER (c_acctbal > 9900) AS n_books FROM (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 4 = 0 AND c_acctbal > 9900 THEN 'BUILDING' ELSE c_mktsegment END AS c_mktsegment FROM customer) GROUP BY c_mktsegment")
def divisions(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    books = c.where("c_acctbal > 9900").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")))
    return rollup.by_division(books, c.select("c_mktsegment").distinct(), "c_mktsegment", "BUILDING")


@bound("a22_section_bytes", "SELECT source, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY source")
def section_bytes(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))


@bound("a23_duplicate_documents", "SELECT sha256(text) AS digest, count(*) AS n, count(DISTINCT source) AS n_places FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_documents(spark, sf_dir):
    return rollup.duplicates(read(spark, sf_dir, "documents"), [], F.sha2("text", 256), F.col("source"))


@bound("a25_key_collisions", """SELECT key, count(DISTINCT s) AS n_spellings, min(s) AS one, max(s) AS another FROM (SELECT regexp_replace(upper(s), '[^A-Z0-9]', '', 'g') AS key, s FROM (SELECT p_name || CASE p_size % 3 WHEN 0 THEN '-' WHEN 1 THEN ' ' ELSE '' END || (p_partkey % 200) AS s FROM part)) GROUP BY key HAVING count(DISTINCT s) > 1""")
def collisions(spark, sf_dir):
    s = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, "-").when(F.col("p_size") % 3 == 1, " ").otherwise(""), F.col("p_partkey") % 200)
    return rollup.key_collisions(read(spark, sf_dir, "part"), [], keys.heat_key(s), s)


@bound("a26_batch_classes", """SELECT o_orderkey, CASE WHEN k IS NULL THEN 'missing_key' WHEN count(*) OVER (PARTITION BY k) > 1 THEN 'duplicate_in_batch' ELSE 'fileable' END AS state
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey || '/' || (o_orderkey % 12) END AS k FROM orders)""")
def batch_classes(spark, sf_dir):
    return rollup.batch_classes(read(spark, sf_dir, "orders"), "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.concat_ws("/", "o_custkey", F.col("o_orderkey") % 12)))


@bound("a15_audit_scores", """SELECT l_orderkey, greatest(0, 100 - 25 * c - 10 * m - 2 * i)::BIGINT AS score, c AS n_critical, c > 0 AS failed FROM (SELECT l_orderkey, count(*) FILTER (k = 'critical') AS c, count(*) FILTER (k = 'major') AS m, count(*) FILTER (k = 'minor') AS i
FROM (SELECT l_orderkey, CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 'critical' WHEN l_returnflag = 'R' THEN 'major' ELSE 'minor' END AS k FROM lineitem) GROUP BY l_orderkey)""")
def audit_scores(spark, sf_dir):
    kind = F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1), "critical").when(F.col("l_returnflag") == "R", "major").otherwise("minor")
    return rollup.audit_scores(read(spark, sf_dir, "lineitem").withColumn("kind", kind), ["l_orderkey"], "kind")


@bound("a16_latest_per_group", "SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate::DATE AS d FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("d", day("o_orderdate"))
    return rollup.latest(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "o_orderstatus", "d"])


@bound("a20_library_references", "SELECT l_partkey, count(*) AS n_heats, count(DISTINCT l_orderkey) AS n_books FROM lineitem WHERE l_quantity > 30 GROUP BY l_partkey")
def library_references(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").where("l_quantity > 30").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_heats"), F.countDistinct("l_orderkey").alias("n_books"))
