"""What people may see, search, declare and pull over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access
from .bound import bound, day, read
from .findings import tables
from .records import ctes, records


@bound("p17_client_views", f"WITH {ctes('document', 'weld')} SELECT 'document' AS kind, id, NULL AS status FROM document WHERE is_approved AND section_id NOT LIKE '%.3' UNION ALL SELECT 'weld', id, status FROM weld")
def client_views(spark, sf_dir):
    t = tables(spark, sf_dir, "document", "weld")
    d = t["document"].withColumn("visibility", F.when(F.col("section_id").endswith(".3"), "internal"))
    seen = access.redacted_documents(d, "client_user").select(F.lit("document").alias("kind"), "id", F.lit(None).cast("string").alias("status"))
    welds = access.projected(t["weld"], "third_party_inspector", access.CLIENT_WELD)
    assert "root_welder_id" not in welds.columns
    return seen.unionByName(welds.select(F.lit("weld").alias("kind"), "id", "status"))


@bound("p19_torque_presets", f"WITH {ctes('torque_connection')} SELECT 'uninspected' AS preset, id FROM torque_connection WHERE inspection_date IS NULL AND (contains(coalesce(iso_number, ''), '7-ga') OR contains(lower(coalesce(wrench_id_raw, '')), '7-ga')) UNION ALL SELECT 'wrench_issue', id FROM torque_connection WHERE wrench_id_raw IS NULL AND (contains(coalesce(iso_number, ''), '1-acm')) UNION ALL SELECT 'cp', id FROM torque_connection WHERE cp_test_on_flange AND contains(lower(coalesce(wrench_id_raw, '')), 'b1')")
def torque_presets(spark, sf_dir):
    c = records(spark, sf_dir, "torque_connection")["torque_connection"].withColumn("iso_flange_number", F.lit("x")).withColumn("verdict", F.when(F.col("wrench_id_raw").isNull(), "unknown").otherwise("valid"))
    parts = [access.torque_preset(c, p, q).select(F.lit(p).alias("preset"), "id") for p, q in (("uninspected", " 7-GA "), ("wrench_issue", "1-acm"), ("cp", "B1"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@bound("p20_library_search", "SELECT p_partkey FROM part WHERE p_size % 7 <> 0 AND (contains(lower(p_name), 'a1') OR contains(lower(p_brand), 'a1') OR contains(regexp_replace(upper('h-a' || p_partkey), '[^A-Z0-9]', '', 'g'), 'A1'))")
def library_search(spark, sf_dir):
    from ..functions.keys import heat_key

    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("material_description"), F.col("p_brand").alias("mill_name"), heat_key(F.concat(F.lit("h-a"), F.col("p_partkey"))).alias("heat_key"), (F.col("p_size") % 7 == 0).alias("is_deleted"))
    return access.library_search(p, " a1").select("p_partkey")


@bound("p22_capabilities", """WITH c(role, capability) AS (VALUES ('BUILDING', 'write'), ('BUILDING', 'comment'), ('MACHINERY', 'comment'), ('FURNITURE', 'read'))
SELECT c_custkey AS person, capability FROM customer JOIN c ON role = c_mktsegment UNION SELECT o_custkey, 'comment' FROM orders WHERE o_orderkey % 5 = 0 AND (o_orderkey % 10 = 0 OR o_orderdate::DATE >= DATE '1997-01-01')""")
def capabilities(spark, sf_dir):
    people = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"), F.col("c_mktsegment").alias("role"))
    table = spark.createDataFrame([("BUILDING", "write"), ("BUILDING", "comment"), ("MACHINERY", "comment"), ("FURNITURE", "read")], "role string, capability string")
    o = read(spark, sf_dir, "orders").where("o_orderkey % 5 = 0")
    grants = o.select(F.col("o_custkey").alias("person"), F.lit("comment").alias("capability"), F.when(F.col("o_orderkey") % 10 != 0, day("o_orderdate")).alias("expires_on"))
    return access.capable(people, table, grants, F.lit("1997-01-01").cast("date"))


@bound("p23_competency_gaps", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'cannot be named Custodian; cannot perform a Tier 2 peer audit' WHEN 1 THEN 'cannot be named Custodian; cannot perform a Tier 2 peer audit' WHEN 2 THEN 'cannot perform a Tier 2 peer audit' ELSE '' END AS gaps FROM customer")
def competency_gaps(spark, sf_dir):
    level = F.element_at(F.array(*[F.lit(x) for x in (None, "JB-1", "JB-2", "JB-3", "JB-4")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(access.competency_gaps(level), "; ").alias("gaps"))


_BOOKS = """b AS (SELECT c_custkey AS k FROM customer), l AS (SELECT o_custkey AS k, CASE o_orderkey % 9 WHEN 0 THEN '' ELSE 'FL' || (o_orderkey % 97) END AS code, o_orderkey % 40 AS n FROM orders), sc AS (SELECT o_custkey AS k, (o_orderkey % 13)::VARCHAR AS s, o_orderkey % 300 - 3 AS n FROM orders WHERE o_orderkey % 3 <> 1),
la AS (SELECT k, count(*) FILTER (code = '') AS un, count(*) FILTER (code <> '') - count(DISTINCT code) FILTER (code <> '') AS ag, sum(n) AS j FROM l GROUP BY 1), sa AS (SELECT k, count(*) FILTER (n < 0) AS neg, count(*) FILTER (n > 0) AS pos, max(n) FILTER (s = '12') AS w FROM sc GROUP BY 1),
z AS (SELECT b.k, coalesce(un, 0) AS un, coalesce(ag, 0) AS ag, coalesce(j, 0) AS j, coalesce(neg, 0) AS neg, coalesce(pos, 0) AS pos, coalesce(w, 0) AS w FROM b LEFT JOIN la USING (k) LEFT JOIN sa USING (k))"""


@bound("p25_new_books", f"""WITH {_BOOKS} SELECT k AS book, 'error' AS severity, 'jobNumber' AS field FROM z WHERE k % 10 = 0 UNION ALL SELECT k, 'error', 'clientOrgId' FROM z WHERE k % 11 = 0 UNION ALL SELECT k, 'error', 'division' FROM z WHERE k % 4 = 3 UNION ALL SELECT k, 'error', 'constructionEnd' FROM z WHERE k % 6 = 1
UNION ALL SELECT k, 'error', 'scope' FROM z WHERE neg > 0 UNION ALL SELECT k, 'error', 'weldLines.code' FROM z WHERE un > 0 UNION ALL SELECT k, 'error', 'weldLines.duplicate' FROM z WHERE ag > 0 UNION ALL SELECT k, 'warning', 'scope' FROM z WHERE pos = 0 UNION ALL SELECT k, 'warning', 'constructionWindow' FROM z WHERE k % 6 = 2 UNION ALL SELECT k, 'warning', 'weldLines' FROM z WHERE j > 0 AND w > 0 AND abs(j - w) / w > 0.1""")
def new_books(spark, sf_dir):
    c, o, k = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders"), F.col("c_custkey")
    books = c.select(
        k.alias("book"), F.when(k % 10 == 0, " ").otherwise("AB1").alias("job_number"), F.when(k % 11 != 0, k).alias("client_org_id"), F.element_at(F.array(*[F.lit(x) for x in ("Facilities", "Flowlines", None, "Space")]), (k % 4 + 1).cast("int")).alias("division"),
        F.lit("2024-05-01").cast("date").alias("construction_start"), F.when(k % 6 == 1, F.lit("2024-01-01").cast("date")).when(k % 6 != 2, F.lit("2024-09-01").cast("date")).alias("construction_end"),
    )
    key = F.col("o_orderkey")
    lines = o.select(F.col("o_custkey").alias("book"), F.when(key % 9 == 0, " ").otherwise(F.concat(F.lit(" fl"), key % 97)).alias("line_code"), (key % 40).alias("expected"))
    scope = o.where(key % 3 != 1).select(F.col("o_custkey").alias("book"), (key % 13).cast("string").alias("section"), (key % 300 - 3).alias("expected"))
    return access.new_book_issues(books, lines, scope, ["Facilities", "Flowlines"])


@bound("j18_pulled_cards", f"WITH {ctes('nde_report')}, s AS (SELECT DISTINCT job_book_id, technician_id FROM nde_report WHERE technician_id IS NOT NULL) SELECT c_custkey AS card_id, job_book_id FROM customer JOIN s ON technician_id = 'n' || (c_custkey % 50) WHERE c_custkey % 3 = 0 AND NOT (c_custkey % 2 = 0 AND job_book_id = (c_custkey % 25)::VARCHAR)")
def pulled_cards(spark, sf_dir):
    from ..functions.keys import record_id

    space = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    k = F.col("c_custkey")
    cards = read(spark, sf_dir, "customer").select(k.alias("card_id"), F.when(k % 3 == 0, "ndt_technician").otherwise("cwi").alias("subject_type"), F.concat(F.lit("n"), k % 50).alias("subject_id"))
    there = read(spark, sf_dir, "customer").where(k % 2 == 0).select(record_id(space, F.lit("certificate"), (k % 25).cast("string"), k.cast("string")).alias("id"))
    t = records(spark, sf_dir, "weld", "nde_report")
    return access.pulled_cards(cards, t["weld"].withColumn("cwi_id", F.lit(None).cast("string")), t["nde_report"], there, space).select("card_id", "job_book_id")


@bound("u9_withdrawn_copies", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN o_orderdate WHEN o_custkey % 4 = 0 THEN TIMESTAMP '1998-01-01' END AS deleted_at FROM orders")
def withdrawn_copies(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("credential_library_id"), F.when(F.col("o_orderkey") % 9 == 0, F.col("o_orderdate")).alias("deleted_at"))
    kind = dict(o.dtypes)["deleted_at"]
    cards = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("card_id"), F.when(F.col("c_custkey") % 4 == 0, F.lit("1998-01-01").cast(kind)).alias("deleted_at"))
    every = o.select("credential_library_id").where("credential_library_id % 4 = 0").distinct().select(F.col("credential_library_id").alias("card_id"), F.lit("1998-01-01").cast(kind).alias("deleted_at"))
    return access.withdrawn_copies(o, every.unionByName(cards.where("card_id % 4 <> 0"))).select("o_orderkey", "deleted_at")


@bound("a35_backup_health", "WITH r AS (SELECT o_orderdate AS at_, o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT at_ AS last_run_at, o_orderstatus AS last_status, round(epoch(TIMESTAMP '2000-01-01' - at_) / 3600, 1) AS hours_since, (SELECT count(*) FROM documents WHERE doc_id % 6 <> 1) AS files, (SELECT sum(n_chars)::BIGINT FROM documents WHERE doc_id % 6 <> 1) AS bytes FROM r")
def backup_health(spark, sf_dir):
    runs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("started_at"), F.col("o_orderstatus").alias("status"))
    objects = read(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 6 == 1, F.current_timestamp()).alias("superseded_at"), F.col("n_chars").alias("byte_size"))
    out = access.backup_health(runs.withColumn("started_at", F.col("started_at").cast("timestamp")), objects, F.lit("2000-01-01 00:00:00").cast("timestamp"))
    return out.withColumn("last_run_at", F.col("last_run_at").cast("timestamp_ntz"))
