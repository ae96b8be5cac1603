"""Versions, diffs, change logs, sequences and archives over orders, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, rollup
from .bound import bound, day, read


@bound("w5_document_versions", """WITH d AS (SELECT doc_id, source AS name, sha256(text) AS digest FROM documents), m AS (SELECT *, row_number() OVER (PARTITION BY name, digest ORDER BY doc_id) > 1 AS duplicate FROM d)
SELECT doc_id, name, duplicate, CASE WHEN NOT duplicate THEN row_number() OVER (PARTITION BY name, duplicate ORDER BY doc_id) END::INTEGER AS version, CASE WHEN NOT duplicate THEN lag(digest) OVER (PARTITION BY name, duplicate ORDER BY doc_id) END AS supersedes FROM m""")
def document_versions(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("name"), F.sha2("text", 256).alias("digest"))
    return history.versions(d, ["name"], "digest", ["doc_id"]).drop("digest")


@bound("w4_superseded_in_batch", """SELECT o_orderkey, newest_before, coalesce(d < newest_before, false) AS superseded FROM (SELECT o_orderkey, o_orderdate::DATE AS d,
max(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest_before FROM orders)""")
def superseded(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("d", day("o_orderdate"))
    return history.superseded_in_batch(o, ["o_custkey"], ["o_orderkey"], "d", F.col("o_orderstatus") != "P").select("o_orderkey", "newest_before", "superseded")


@bound("w6_certificate_history", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END DESC NULLS LAST, o_orderkey)::INTEGER AS rank FROM orders")
def certificate_history(spark, sf_dir):
    issued = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate"))
    return history.ranked(read(spark, sf_dir, "orders"), ["o_custkey"], [issued.desc_nulls_last(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "rank")


@bound("w7_sequence_gaps", "WITH s AS (SELECT DISTINCT o_custkey % 50 AS book, o_orderkey % 400 AS n FROM orders), g AS (SELECT book, n, lead(n) OVER (PARTITION BY book ORDER BY n) AS nx FROM s) SELECT book, unnest(generate_series(n + 1, nx - 1)) AS missing FROM g WHERE nx > n + 1")
def gaps(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("book"), (F.col("o_orderkey") % 400).alias("n"))
    return history.sequence_gaps(o, ["book"], "n")


@bound("w9_continuation_pages", "SELECT o_custkey, o_orderkey, coalesce(o_orderstatus = lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), false) AS continues FROM orders")
def continuation(spark, sf_dir):
    return history.continuations(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderstatus").select("o_custkey", "o_orderkey", "continues")


@bound("w10_report_segments", """WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 <> 1 THEN role END AS id FROM conversations), b AS (SELECT *, last_value(id IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t)
SELECT conv_id, turn, sum((id IS NOT NULL AND id IS DISTINCT FROM before)::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS segment, last_value(id IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS identity FROM b""")
def report_segments(spark, sf_dir):
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 != 1, F.col("role")).alias("who"))
    return history.segments(t, ["conv_id"], ["turn"], "who").select("conv_id", "turn", "segment", "identity")


@bound("w11_position_clusters", """SELECT event_id, sum((v - p > 0.4)::INTEGER) OVER (PARTITION BY user_id ORDER BY v, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster
FROM (SELECT event_id, user_id, value AS v, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id), value) AS p FROM events)""")
def position_clusters(spark, sf_dir):
    return history.clusters(read(spark, sf_dir, "events"), ["user_id"], "value", 0.4, ["event_id"]).select("event_id", F.col("cluster").cast("long"))


@bound("w12_dominant_pitch", """WITH s AS (SELECT book, o_orderkey - lag(o_orderkey) OVER (PARTITION BY book ORDER BY o_orderkey) AS st FROM (SELECT o_custkey % 30 AS book, o_orderkey FROM orders)), n AS (SELECT book, st, count(*) AS n FROM s WHERE st > 0 GROUP BY ALL)
SELECT book, least(100.0, greatest(1.0, st::DOUBLE)) AS pitch FROM n QUALIFY row_number() OVER (PARTITION BY book ORDER BY n DESC, st) = 1""")
def dominant_pitch(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 30).alias("book"), F.col("o_orderkey").cast("double").alias("y"))
    return history.pitch(o, ["book"], "y", grain=1.0)


@bound("w14_copy_budget", """SELECT * FROM (SELECT source, doc_id, coalesce(sum(n_chars) OVER w, 0)::BIGINT AS bytes_before, count(*) OVER w AS files_before FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE bytes_before < 40000 AND files_before < 30""")
def copy_budget(spark, sf_dir):
    return history.within_budget(read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], "n_chars", 40_000, 30).drop("n_chars")


@bound("u1_event_stream", """SELECT kind, date_trunc('month', d)::DATE AS month, count(*) AS n FROM (SELECT 'order' AS kind, o_orderdate AS d FROM orders UNION ALL SELECT 'ship', l_shipdate FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'event', ts FROM events WHERE event_type = 'error') GROUP BY ALL""")
def event_stream(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderdate").alias("d"))
    s = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.lit("ship").alias("kind"), F.col("l_shipdate").alias("d"))
    e = read(spark, sf_dir, "events").where("event_type = 'error'").select(F.lit("event").alias("kind"), F.col("ts").cast("timestamp").alias("d"))
    return o.unionByName(s).unionByName(e).groupBy("kind", F.trunc(F.to_date("d"), "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@bound("u2_reference_union", "SELECT l_partkey AS ref FROM lineitem WHERE l_quantity > 48 UNION SELECT p_partkey FROM part WHERE p_size < 5")
def reference_union(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("ref")).union(read(spark, sf_dir, "part").where("p_size < 5").select("p_partkey")).distinct()


_OLD = "old AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_custkey AS who, CAST(NULL AS VARCHAR) AS gone FROM orders WHERE o_orderkey % 10 <> 0)"
_NEW = "new AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE o_custkey END AS who, CASE WHEN o_orderkey % 21 = 0 THEN 'y' END AS gone FROM orders WHERE o_orderkey % 15 <> 1)"


def _snapshots(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    old = o.where(k % 10 != 0).select(k.alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("who"), F.lit(None).cast("string").alias("gone"))
    new = o.where(k % 15 != 1).select(k.alias("id"), F.when(k % 6 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.when(k % 14 != 0, F.col("o_custkey")).alias("who"), F.when(k % 21 == 0, "y").alias("gone"))
    return old, new


@bound("u5_import_diff", f"""WITH {_OLD}, {_NEW} SELECT id, CASE WHEN old.id IS NULL THEN 'added' WHEN new.id IS NULL THEN 'removed' WHEN c = '' THEN 'unchanged' ELSE 'updated' END AS status, CASE WHEN old.id IS NOT NULL AND new.id IS NOT NULL AND c <> '' THEN c END AS changes
FROM (SELECT coalesce(old.id, new.id) AS id, old, new, concat_ws(',', CASE WHEN old.status IS DISTINCT FROM new.status THEN 'status:' || coalesce(old.status, '') || '>' || coalesce(new.status, '') END, CASE WHEN old.who IS DISTINCT FROM new.who THEN 'who:' || coalesce(old.who::VARCHAR, '') || '>' || coalesce(new.who::VARCHAR, '') END) AS c FROM old FULL JOIN new ON old.id = new.id)""")
def import_diff(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    said = F.transform("changes", lambda c: F.concat(c.field, F.lit(":"), F.coalesce(c.before, F.lit("")), F.lit(">"), F.coalesce(c.after, F.lit(""))))
    return history.diff(old, new, ["id"], ["status", "who"]).withColumn("changes", F.array_join(said, ","))


@bound("u6_change_log", f"""WITH {_OLD}, {_NEW} SELECT coalesce(old.id, new.id) AS id, CASE WHEN old.id IS NULL THEN 'create' WHEN new.id IS NULL THEN 'hard_delete' WHEN new.gone IS NOT NULL THEN 'soft_delete' ELSE 'update' END AS action FROM old FULL JOIN new ON old.id = new.id
WHERE old.id IS NULL OR new.id IS NULL OR old.status IS DISTINCT FROM new.status OR old.who IS DISTINCT FROM new.who OR new.gone IS NOT NULL""")
def change_log(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return history.change_log(old, new, ["id"], ["status", "who", "gone"], "gone").select("id", "action")


@bound("u7_upsert_plan", f"WITH {_OLD}, {_NEW} SELECT plan, count(*) AS n FROM (SELECT CASE WHEN old.id IS NULL THEN 'create' ELSE 'update' END AS plan FROM new LEFT JOIN old ON old.id = new.id) GROUP BY plan")
def upsert_plan(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return history.upsert_plan(new, old, ["id"]).groupBy("plan").agg(F.count(F.lit(1)).alias("n"))


_FIND = "fnd AS (SELECT 'r' || (l_linenumber % 5) AS rule_id, CASE WHEN l_linenumber % 5 = 0 THEN 'critical' WHEN l_linenumber % 5 < 3 THEN 'warning' ELSE 'info' END AS severity, l_orderkey % 4 AS book, l_orderkey AS record_id FROM lineitem WHERE l_quantity > 40)"


def _findings(spark, sf_dir):
    n = F.col("l_linenumber") % 5
    return read(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.concat(F.lit("r"), n).alias("rule_id"), F.when(n == 0, "critical").when(n < 3, "warning").otherwise("info").alias("severity"), (F.col("l_orderkey") % 4).alias("book"), F.col("l_orderkey").alias("record_id"))


@bound("u3_first_by_fingerprint", f"WITH {_FIND} SELECT book, record_id, min(rule_id) AS rule_id FROM fnd GROUP BY ALL")
def first_by_fingerprint(spark, sf_dir):
    return history.first_by_fingerprint(_findings(spark, sf_dir), ["book", "record_id"], ["rule_id"]).select("book", "record_id", "rule_id")


@bound("u4_ledger_merge", f"""WITH {_FIND}, a AS (SELECT DISTINCT book, record_id FROM fnd), s AS (SELECT o_orderkey % 4 AS book, o_orderkey AS record_id, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS state FROM orders WHERE o_orderkey % 3 = 0)
SELECT book, record_id, change FROM (SELECT coalesce(a.book, s.book) AS book, coalesce(a.record_id, s.record_id) AS record_id, CASE WHEN a.book IS NOT NULL AND s.book IS NOT NULL THEN 'unchanged' WHEN a.book IS NOT NULL THEN 'new' WHEN state = 'open' THEN 'disappeared' END AS change FROM a FULL JOIN s ON a.book = s.book AND a.record_id = s.record_id) WHERE change IS NOT NULL""")
def ledger_merge(spark, sf_dir):
    fresh = _findings(spark, sf_dir).select("book", "record_id").distinct()
    k = F.col("o_orderkey")
    stored = read(spark, sf_dir, "orders").where(k % 3 == 0).select((k % 4).alias("book"), k.alias("record_id"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("state"))
    return history.merged_ledger(fresh, stored, ["book", "record_id"], "state")


_AGG = f"""{_FIND}, agg AS (SELECT book, rule_id, count(*) AS n, min(severity) AS severity FROM fnd GROUP BY book, rule_id)"""


def aggregated(spark, sf_dir):
    return rollup.aggregated_findings(_findings(spark, sf_dir), ["book"], most=20)


@bound("a12_aggregated_findings", f"WITH {_AGG} SELECT book, rule_id, n, severity, (SELECT string_agg(r, ',' ORDER BY r::BIGINT) FROM (SELECT record_id::VARCHAR AS r FROM fnd WHERE fnd.book = agg.book AND fnd.rule_id = agg.rule_id ORDER BY record_id LIMIT 20)) AS records, n > 20 AS truncated FROM agg")
def aggregated_findings(spark, sf_dir):
    return aggregated(spark, sf_dir).withColumn("records", F.array_join(F.transform("records", lambda r: r.cast("string")), ","))


@bound("a11_severity_counts", f"""WITH {_AGG} SELECT book, count(*) FILTER (severity = 'critical') AS critical_findings, coalesce(sum(n) FILTER (severity = 'critical'), 0)::BIGINT AS critical_records, count(*) FILTER (severity = 'warning') AS warning_findings,
coalesce(sum(n) FILTER (severity = 'warning'), 0)::BIGINT AS warning_records, count(*) FILTER (severity = 'info') AS info_findings, coalesce(sum(n) FILTER (severity = 'info'), 0)::BIGINT AS info_records FROM agg GROUP BY book""")
def severity_counts(spark, sf_dir):
    return rollup.severity_counts(aggregated(spark, sf_dir), ["book"], ["critical", "warning", "info"])


@bound("u8_archive_plan", """WITH f AS (SELECT doc_id, sha256(text) AS digest, source || '/' || doc_id AS path FROM documents), a AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE sha256(text) END AS digest FROM documents WHERE doc_id % 3 <> 0)
SELECT f.doc_id, path, CASE WHEN length(path) > 9 THEN 'too_long' WHEN a.digest IS NULL THEN 'copy' WHEN a.digest = f.digest THEN 'skip' ELSE 'supersede' END AS action FROM f LEFT JOIN a ON a.doc_id = f.doc_id""")
def archive_plan(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    files = d.select("doc_id", F.sha2("text", 256).alias("digest"), F.concat_ws("/", "source", "doc_id").alias("path"))
    archived = d.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.sha2("text", 256)).alias("digest"))
    return history.archive_plan(files, archived, ["doc_id"], "digest", "path", most_path=9).drop("digest")


@bound("u10_already_filed", "SELECT doc_id FROM documents d WHERE doc_id % 2 = 0 AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 1)")
def already_filed(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("digest", F.sha2("text", 256))
    return d.where("doc_id % 2 = 0").join(d.where("doc_id % 2 = 1").select("digest"), "digest", "left_semi").select("doc_id")
