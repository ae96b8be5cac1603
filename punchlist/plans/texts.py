"""Keys, normal forms, faults and digests over part names, order keys, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, keys
from ..operators import notify
from .bound import bound, day, read


@bound("f4_loose_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 7 THEN NULL ELSE o_orderdate::DATE END AS parsed FROM orders")
def loose_date(spark, sf_dir):
    d, k = day("o_orderdate"), F.col("o_orderkey") % 9
    typed = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "M/d/yyyy")).when(k == 2, F.date_format(d, "MM-dd-yy")).when(k == 3, F.date_format(d, "M.d.yyyy"))
        .when(k == 4, F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string")).when(k == 5, F.date_format(d, "MMMM d, yyyy")).when(k == 6, F.concat(F.lit(" "), F.date_format(d, "d MMM yyyy"))).when(k == 7, "2/31/24").otherwise(F.concat(F.datediff(d, F.lit("1899-12-30").cast("date")), F.lit(".73")))
    )
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.loose_date(typed).alias("parsed"))


@bound("f6_heat_keys", "SELECT p_partkey, nullif(regexp_replace(upper(p_name || '-' || p_partkey), '[^A-Z0-9]', '', 'g'), '') AS heat_key, regexp_replace(upper(trim('  ' || p_name || '   x ')), '\\s+', ' ', 'g') AS stored, lower(p_brand) || CASE p_partkey % 3 WHEN 0 THEN ' #' WHEN 1 THEN ' % smys' ELSE '' END AS header, trim(regexp_replace(lower(p_brand) || CASE p_partkey % 3 WHEN 1 THEN ' smys' ELSE '' END, '[^a-z0-9]+', ' ', 'g')) AS plain FROM part")
def heat_keys(spark, sf_dir):
    n, k = F.col("p_name"), F.col("p_partkey") % 3
    typed = F.concat(F.lit(" "), F.col("p_brand"), F.when(k == 0, "   #").when(k == 1, " % SMYS:").otherwise("."))
    return read(spark, sf_dir, "part").select("p_partkey", keys.heat_key(F.concat_ws("-", n, "p_partkey")).alias("heat_key"), keys.squeezed(F.concat(F.lit("  "), n, F.lit("   x "))).alias("stored"), keys.header_key(typed).alias("header"), keys.plain_header_key(typed).alias("plain"))


@bound("f7_heat_from_filename", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'A' || p_partkey WHEN 1 THEN 'HT' || p_partkey WHEN 2 THEN CASE WHEN p_partkey >= 10000 THEN p_partkey::VARCHAR END WHEN 3 THEN NULL WHEN 4 THEN 'B7X' || p_partkey ELSE NULL END AS heat FROM part""")
def heat_from_filename(spark, sf_dir):
    k = F.col("p_partkey")
    name = (
        F.when(k % 6 == 0, F.concat(F.lit("ce3ff815-4 SCH 40 ELBOW A"), k, F.lit(".pdf"))).when(k % 6 == 1, F.concat(F.lit("MTR_ht"), k, F.lit(" FLG CL600.pdf"))).when(k % 6 == 2, F.concat(F.lit("pipe-"), k, F.lit(".PDF")))
        .when(k % 6 == 3, F.lit("Scan 0012.pdf")).when(k % 6 == 4, F.concat(F.lit("Cap_b7x"), k, F.lit("_CERT_.75.pdf"))).otherwise("CERT-CL900.pdf")
    )
    return read(spark, sf_dir, "part").select("p_partkey", keys.heat_from_filename(name).alias("heat"))


@bound("f8_weld_number_keys", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN o_orderkey || '.5' ELSE o_orderkey::VARCHAR END AS key FROM orders WHERE o_orderkey > 0")
def weld_number_keys(spark, sf_dir):
    k = F.col("o_orderkey")
    typed = F.when(k % 4 == 0, F.concat(F.lit("NP-00"), k)).when(k % 4 == 1, F.concat(F.lit(" W "), k, F.lit("A "))).when(k % 4 == 2, F.concat(k, F.lit(".5"))).otherwise("toolongprefix12")
    return read(spark, sf_dir, "orders").where("o_orderkey > 0").select("o_orderkey", keys.weld_number_key(typed).alias("key"))


@bound("f9_pipe_and_tool_keys", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size || 'SCH40' ELSE '3/4XS' END AS pipe, CASE WHEN p_partkey < 1000 THEN lpad(p_partkey::VARCHAR, 4, '0') ELSE p_partkey::VARCHAR END AS tool FROM part")
def pipe_keys(spark, sf_dir):
    typed = F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size"), F.lit('" sch-40'))).otherwise(' 3/4" xs ')
    return read(spark, sf_dir, "part").select("p_partkey", keys.pipe_key(typed).alias("pipe"), keys.tool_key(F.col("p_partkey").cast("string")).alias("tool"))


@bound("f17_split_lists", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = o_orderkey % 5 THEN 'H' || (o_orderkey % 7) ELSE 'H' || (o_orderkey % 7) || '+H' || (o_orderkey % 5) END || '+A&B' AS heats, CASE WHEN o_orderkey % 3 <> 0 THEN 'CT' END AS root,
CASE WHEN o_orderkey % 4 = 0 THEN 'NP-1' ELSE 'NP-1+' || (o_orderkey % 4 + 1) END AS welds, 'KZ9' || CASE WHEN o_orderkey % 6 > 0 THEN '+KZ9' || (o_orderkey % 6) ELSE '' END AS typed_heats FROM orders""")
def split_lists(spark, sf_dir):
    k = F.col("o_orderkey")
    listed = F.concat(F.lit(" H"), k % 7, F.lit(" , |H"), k % 5, F.lit(";H"), k % 7, F.lit("/A&B|"))
    passes = F.when(k % 3 == 0, "CT/CT/HS2").otherwise("CT/CT/HS2/ ")
    welds, heats = F.concat(F.lit("NP-1 01,"), k % 4 + 1, F.lit("; x-toolong")), F.concat(F.lit("kz9, KZ-9;--\n"), F.when(k % 6 > 0, F.concat(F.lit("kz9"), k % 6)).otherwise("kz9"))
    joined = lambda c: F.array_join(c, "+")
    return read(spark, sf_dir, "orders").select("o_orderkey", joined(keys.split_list(listed)).alias("heats"), F.element_at(keys.four_passes(passes), 1).alias("root"), joined(keys.weld_number_list(welds)).alias("welds"), joined(keys.heat_list(heats)).alias("typed_heats"))


@bound("f20_folders_and_types", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN NULL WHEN c_custkey % 5 = 3 THEN 'S' || (c_custkey % 9) ELSE (c_custkey % 30 + 1)::VARCHAR END AS section, CASE c_custkey % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' ELSE 'application/octet-stream' END AS mime FROM customer")
def folders(spark, sf_dir):
    k = F.col("c_custkey")
    folder = F.when(k % 5 == 4, "Correspondence").when(k % 5 == 3, F.concat(F.lit("S"), k % 9, F.lit(" - extra"))).otherwise(F.concat(F.lit("0"), k % 30 + 1, F.lit(" - Welding")))
    name = F.when(k % 3 == 0, "a.b.PDF").when(k % 3 == 1, "x.png").otherwise("noext")
    return read(spark, sf_dir, "customer").select("c_custkey", keys.section_of_folder(folder).alias("section"), keys.mime_of(name).alias("mime"))


@bound("f22_foreign_job_numbers", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'DP-' || (100 + o_orderkey % 50) ELSE '' END AS foreign_jobs FROM orders")
def foreign_jobs(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("report ab-777 "), F.when(k % 4 == 0, F.concat(F.lit("dp-"), k % 50 + 100)).otherwise(""), F.lit(".pdf"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(keys.foreign_job_numbers(name, F.lit("AB-777")), ",").alias("foreign_jobs"))


@bound("f23_normalisers", """SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (0, 1, 3) THEN 'pass' WHEN o_orderkey % 8 = 2 THEN 'fail' END AS result, CASE WHEN o_orderkey % 8 IN (0, 1, 3, 7) THEN 'pass' WHEN o_orderkey % 8 = 2 THEN 'fail' END AS facility_result, o_orderkey % 2 = 0 AS flag,
CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN (o_orderkey % 100) / 100.0::DOUBLE WHEN 2 THEN NULL ELSE (o_orderkey % 500)::DOUBLE END AS number, 130.0::DOUBLE AS least, CASE WHEN o_orderkey % 3 = 2 THEN 130.0 ELSE 200 + o_orderkey % 9 END::DOUBLE AS most,
CASE o_orderkey % 3 WHEN 0 THEN 'RT' WHEN 1 THEN 'UT' END AS method, CASE o_orderkey % 4 WHEN 0 THEN 'Butt' WHEN 1 THEN 'O-let' WHEN 2 THEN 'Socket' END AS joint, CASE o_orderkey % 4 WHEN 0 THEN 'Butt' WHEN 1 THEN 'O-Let' END AS weld FROM orders""")
def normalisers(spark, sf_dir):
    k = F.col("o_orderkey")
    word = F.element_at(F.array(*[F.lit(x) for x in (" Accept ", "OK:", "REJECTED", "p", "PENDING", "Partial", "Fit-up", "yes")]), (k % 8 + 1).cast("int"))
    range_ = F.when(k % 3 == 0, F.concat(F.lit("130 - "), k % 9 + 200)).when(k % 3 == 1, F.concat(k % 9 + 200, F.lit("–130"))).otherwise("130 ft lb")
    number = F.when(k % 5 == 0, "N/A").when(k % 5 == 1, F.concat(k % 100, F.lit(" %"))).when(k % 5 == 2, "12-14").when(k % 5 == 3, F.concat(F.lit("$"), k % 500, F.lit(".0"))).otherwise(F.concat(k % 500, F.lit(" ft lb")))
    joint = F.when(k % 4 == 0, "Butt weld").when(k % 4 == 1, "o-let").when(k % 4 == 2, "Sock.").otherwise("tee")
    r = keys.torque_range(range_)
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", keys.pass_fail(word).alias("result"), keys.pass_fail(word, ("yes",)).alias("facility_result"), keys.yes_no(F.when(k % 4 == 0, "x").when(k % 2 == 0, " Yes").when(k % 4 == 1, "no")).alias("flag"),
        keys.number_of(number).alias("number"), r["least"].alias("least"), r["most"].alias("most"), keys.method_of(F.when(k % 3 == 0, "ut/rt").when(k % 3 == 1, "phased UT").otherwise("--")).alias("method"),
        keys.joint_type(joint).alias("joint"), keys.weld_type(F.when(k % 4 == 0, "BUTT ").when(k % 4 == 1, "O-let").otherwise("Butt weld")).alias("weld"),
    )


@bound("f24_us_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate::DATE END AS day, o_orderkey % 3 <> 2 AS same FROM orders")
def us_dates(spark, sf_dir):
    k, d = F.col("o_orderkey"), day("o_orderdate")
    typed = F.when(k % 4 < 3, F.concat(F.lit("Exam date: "), F.date_format(d, "M/d/yyyy"), F.lit(" 06:00"))).otherwise("25/14/2024")
    logged = F.when(k % 3 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(d, "MM/d/yyyy")).otherwise(F.date_format(F.date_add(d, 1), "M/d/yyyy"))
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.us_date(typed).alias("day"), dates.same_day(logged, d).alias("same"))


@bound("f25_initials_and_stamps", "SELECT p_partkey, upper(left(split_part(p_name, ' ', 1), 1)) || upper(left(split_part(p_name, ' ', 2), 1)) AS initials, p_partkey % 5 < 4 AS combined FROM part")
def initials(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", keys.initials(F.col("p_name")).alias("initials"), keys.is_combined_stamp(F.element_at(F.array(*[F.lit(x) for x in ("CT/HS", "MR LC", "A+B", "A&B", " ANDY ")]), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("combined"))


@bound("f26_record_ids", """WITH h AS (SELECT o_orderkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('weld|' || o_orderkey)) AS d FROM orders)
SELECT o_orderkey, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab', ((instr('0123456789abcdef', substr(d, 17, 1)) - 1) % 4 + 1)::INTEGER, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS id FROM h""")
def record_ids(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", keys.record_id("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.lit("weld"), F.col("o_orderkey").cast("string")).alias("id"))


# The rule for references, told token by token: a run of letters, digits and hyphens with both a letter and a digit, of three or more.
_TOKEN = "array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z0-9][A-Za-z0-9-]*|[^A-Za-z0-9]+'), lambda t: CASE WHEN regexp_matches(t, '[0-9]') AND regexp_matches(t, '[A-Za-z]') AND length(rtrim(t, '-')) >= 3 THEN '<ref>' || repeat('-', length(t) - length(rtrim(t, '-'))) ELSE t END), '')"
_REPORT = "('order ' || o_orderkey || ' of ' || o_orderdate::DATE || ' in ''' || o_orderpriority || ''' at RT-' || (o_custkey % 90) || ', AB' || (o_custkey % 7) || ' or A' || o_custkey || '-x failed (' || sha1(o_orderkey::VARCHAR) || ') ' || (o_orderkey % 50) || '.5 x: ' || o_orderstatus)"
_BEFORE = f"regexp_replace(regexp_replace(regexp_replace({_REPORT}, '[0-9a-f]{{40}}', '<hash>', 'g'), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', '<date>', 'g'), '''[^'']*''', '''<value>''', 'g')"
_NORMAL = f"regexp_replace({_TOKEN.replace('{x}', _BEFORE)}, '\\b[0-9]+([.][0-9]+)?\\b', '<n>', 'g')"


def _reports(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    said = F.concat(F.lit("order "), k, F.lit(" of "), day("o_orderdate"), F.lit(" in '"), F.col("o_orderpriority"), F.lit("' at RT-"), c % 90, F.lit(", AB"), c % 7, F.lit(" or A"), c, F.lit("-x failed ("), F.sha1(k.cast("string")), F.lit(") "), k % 50, F.lit(".5 x: "), F.col("o_orderstatus"))
    return read(spark, sf_dir, "orders").select("o_orderkey", said.alias("message"), day("o_orderdate").alias("seen"))


@bound("f27_normal_messages", f"SELECT o_orderkey, {_NORMAL} AS shape, 'at f (src/lib/' || (o_orderkey % 9) || '.ts:' || (o_orderkey % 40) || ')' AS frame FROM orders")
def normal_messages(spark, sf_dir):
    k = F.col("o_orderkey")
    stack = F.concat(F.lit("Error: at x\n  at lib (/var/node_modules/a.js:1)\n noise\n   at f (/var/task/build/src/lib/"), k % 9, F.lit(".ts:"), k % 40, F.lit(")\n at g (/app/b.ts:2)"))
    return _reports(spark, sf_dir).select("o_orderkey", keys.normal_message(F.col("message")).alias("shape"), keys.top_frame(stack).alias("frame"))


@bound("f28_fault_codes", f"""WITH f AS (SELECT o_orderkey, substr(sha256(CASE WHEN o_orderkey % 2 = 0 THEN 'TypeError' ELSE 'Error' END || chr(0) || {_NORMAL} || chr(0) || chr(0) || '/books'), 1, 12) AS fp FROM orders)
SELECT o_orderkey, fp, array_to_string(list_transform(range(6), lambda i: substr('23456789ABCDEFGHJKLMNPQRSTVWXYZ', (('0x' || substr(fp, (2 * i + 1)::INTEGER, 2))::INTEGER % 31 + 1)::INTEGER, 1)), '') AS code FROM f""")
def fault_codes(spark, sf_dir):
    name = F.when(F.col("o_orderkey") % 2 == 0, "TypeError").otherwise("")
    r = _reports(spark, sf_dir).select("o_orderkey", keys.fault_fingerprint(name, F.col("message"), F.lit(None).cast("string"), F.lit("/books")).alias("fp"))
    return r.select("o_orderkey", "fp", keys.reference_code(F.col("fp")).alias("code"))


@bound("a32_fault_groups", f"SELECT shape, count(*) AS n, min(d) AS first_seen, max(d) AS last_seen, substr(sha256(shape), 1, 12) AS fingerprint FROM (SELECT {_NORMAL} AS shape, o_orderdate::DATE AS d FROM orders) GROUP BY shape")
def fault_groups(spark, sf_dir):
    return notify.faults(_reports(spark, sf_dir), "message", "seen")


@bound("f29_safe_segments", r"""SELECT page_id, coalesce(nullif(rtrim(left(trim(regexp_replace(regexp_replace(url, '[\\/:*?"<>|#%\x00-\x1f]', ' ', 'g'), '\s+', ' ', 'g')), 80)), ''), 'untitled') AS segment FROM pages""")
def safe_segments(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", keys.safe_segment(F.col("url")).alias("segment"))


@bound("f30_redacted_excerpts", """SELECT conv_id, turn, CASE WHEN length(t) <= 60 THEN t ELSE regexp_replace(left(t, 60), '\\s+\\S*\\z', '') || '…' END AS excerpt FROM (SELECT conv_id, turn, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS t FROM conversations)""")
def excerpts(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", keys.excerpt(keys.escaped_html(F.col("text")), 60).alias("excerpt"))


@bound("f1_f2_scoped_percent", "SELECT l_suppkey, round(least(1.0, r / greatest(n, 620)) * 100, 2) AS pct FROM (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_suppkey)")
def scoped_percent(spark, sf_dir):
    g = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    return g.select("l_suppkey", F.round(keys.percent(F.col("r"), keys.scoped(F.lit(620), F.col("n"))), 2).alias("pct"))


@bound("o1_section_order", "SELECT section, row_number() OVER (ORDER BY CASE WHEN section LIKE 'S%' THEN 1083 ELSE split_part(section, '-', 1)::INTEGER END, section)::INTEGER AS place FROM (SELECT DISTINCT CASE WHEN p_size > 40 THEN 'S' || (p_size - 40) WHEN p_size = 19 THEN '19-22' ELSE p_size::VARCHAR END AS section FROM part)")
def section_order(spark, sf_dir):
    from pyspark.sql import Window

    s = F.when(F.col("p_size") > 40, F.concat(F.lit("S"), F.col("p_size") - 40)).when(F.col("p_size") == 19, "19-22").otherwise(F.col("p_size").cast("string"))
    sections = read(spark, sf_dir, "part").select(s.alias("section")).distinct()  # a table of section names, not of documents
    return sections.withColumn("place", F.row_number().over(Window.orderBy(keys.collation_key(F.col("section")), "section")))


@bound("j25_note_fan_out", """SELECT DISTINCT o_orderkey AS note, s_suppkey AS person FROM orders JOIN supplier ON o_custkey % 25 = s_nationkey WHERE (s_suppkey % 4 = 0 OR (s_suppkey % 4 = 1 AND o_orderpriority <> '5-LOW')) AND s_suppkey <> o_custkey % 100""")
def note_fan_out(spark, sf_dir):
    notes = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("note"), (F.col("o_custkey") % 25).cast("int").alias("book"), (F.col("o_custkey") % 100).alias("author"), F.when(F.col("o_orderpriority") == "5-LOW", "info").otherwise("warning").alias("severity"))
    people = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("book"), F.col("s_suppkey").alias("person"), F.when(F.col("s_suppkey") % 4 == 0, "custodian").when(F.col("s_suppkey") % 4 == 1, "assignee").otherwise("reader").alias("role"))
    return notify.fan_out(notes, people, "note", "book", "author", "person", "role", "severity")


@bound("a33_digests", "SELECT person, sum(n)::BIGINT AS n_notes, count(*) AS n_books, min(worst) AS worst FROM (SELECT o_custkey AS person, o_orderpriority AS book, count(*) AS n, min(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) AS worst FROM orders GROUP BY ALL) GROUP BY person")
def digests(spark, sf_dir):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), F.col("o_orderpriority").alias("book"), rank.alias("rank"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("note"))
    return notify.digests(rows, "person", "book", "rank")


@bound("o8_digest_order", """WITH r AS (SELECT o_custkey AS person, o_orderpriority AS book, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS rank, o_orderdate AS at_, o_orderkey AS note FROM orders), b AS (SELECT person, book, row_number() OVER (PARTITION BY person ORDER BY min(rank), book) AS bp FROM r GROUP BY person, book)
SELECT person, book, note, bp::INTEGER AS book_place, (row_number() OVER (PARTITION BY person, book ORDER BY rank, at_, note))::INTEGER AS place FROM r JOIN b USING (person, book)""")
def digest_order(spark, sf_dir):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), F.col("o_orderpriority").alias("book"), rank.alias("rank"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("note"))
    return notify.digest_order(rows, "person", "book", "rank", "at", "note").select("person", "book", "note", "book_place", "place")


@bound("f31_f32_decisions", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'not_imported' ELSE 'imported' END AS after_upload, CASE o_orderkey % 4 WHEN 0 THEN '10' WHEN 1 THEN '13' WHEN 2 THEN '17' END AS section, o_orderkey % 5 <> 0 AS interrupts, o_orderkey % 7 = 0 OR o_orderkey % 7 >= 3 AS due, CASE o_orderkey % 6 WHEN 0 THEN 8 WHEN 1 THEN 25 WHEN 2 THEN 50 WHEN 3 THEN 85 WHEN 4 THEN 98 ELSE 100 END AS planned FROM orders")
def decisions(spark, sf_dir):
    from ..operators import gates, scoring

    k = F.col("o_orderkey")
    now = F.lit("1999-01-01 12:00:00").cast("timestamp")
    last = F.when(k % 7 != 0, now - F.make_dt_interval(F.lit(0), F.lit(0), (k % 7 * 20).cast("int")))
    status = F.when(k % 3 == 0, "not_imported").when(k % 3 == 1, "unknown")
    kind = F.when(k % 4 == 0, "nde_report").when(k % 4 == 1, "calibration_certificate").when(k % 4 == 2, "pressure_recorder_certificate").otherwise("letter")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", scoring.after_upload(status).alias("after_upload"), scoring.source_section(kind).alias("section"), notify.interrupts(F.when(k % 5 == 0, "info").otherwise("warning")).alias("interrupts"), notify.notify_due(last, now, "60 MINUTES").alias("due"),
        gates.planned_minimum(F.concat(F.lit("G"), k % 6)).alias("planned"),
    )


@bound("a34_badges", "SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'F') AS badge, min(CASE WHEN o_orderstatus <> 'F' THEN substr(o_orderpriority, 1, 1)::INTEGER END) AS loudest FROM orders GROUP BY o_custkey")
def badges(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("rank", F.substring("o_orderpriority", 1, 1).cast("int"))
    return notify.badges(o, "o_custkey", F.col("o_orderstatus") != "F", "rank")
