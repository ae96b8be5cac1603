"""What the logs owe against what is on file: examinations, isometric drawings, test packages, flanges, report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import natural_key, percent, weld_number_key
from .completeness import examined
from .pairs import LISTS, all_pairs, lists
from .reconcile import membership

BOOK = "job_book_id"
#: The mark of a checked drawing, and what stands in drawing names beside the line number.
CHECK = "[✔✓]︎?"
NOISE = [CHECK, r"\bFLG\b", r"\(THRD\)", r"-\s*COPY\b", r"\bUPDATED\b", r"(?:_|\b)REV\s*\d+", "_"]


def countable(welds: DataFrame) -> DataFrame:
    return welds.where("status IS DISTINCT FROM 'not_used'")


def live_reports(reports: DataFrame) -> DataFrame:
    return reports.where("NOT coalesce(is_superseded, false)")


# Examinations


def evidenced_welds(reports: DataFrame, lines: DataFrame) -> DataFrame:
    """(job_book_id, id) of the welds that a live report has a line for."""
    live = live_reports(reports).select(BOOK, F.col("id").alias("nde_report_id"))
    found = lines.where("weld_id IS NOT NULL").join(live, [BOOK, "nde_report_id"], "left_semi")
    return found.select(BOOK, F.col("weld_id").alias("id")).distinct()


def marked_welds(welds: DataFrame, reports: DataFrame, lines: DataFrame) -> DataFrame:
    """Countable welds with whether they are marked examined, and whether a report evidences it."""
    there = evidenced_welds(reports, lines).withColumn("evidenced", F.lit(True))
    out = countable(welds).withColumn("examined", examined(F.col("ndt_method"), F.col("xray_number"))).join(there, [BOOK, "id"], "left")
    return out.withColumn("evidenced", F.coalesce("evidenced", F.lit(False)))


def examination_coverage(marked: DataFrame, books: DataFrame) -> DataFrame:
    """Per book: countable, examined, evidenced, examined without a report, evidenced without a mark, and whether either
    satisfies a flat requirement; without such a requirement that is NULL."""
    own = books.select(F.col("id").alias(BOOK), F.when(F.col("rule_kind") == "flat", F.col("required_nde_pct")).alias("required_pct"))
    n = marked.groupBy(BOOK).agg(
        F.count(F.lit(1)).alias("countable"), F.count_if("examined").alias("examined"), F.count_if("evidenced").alias("evidenced"),
        F.count_if(F.col("examined") & ~F.col("evidenced")).alias("unevidenced"), F.count_if(F.col("evidenced") & ~F.col("examined")).alias("unlogged"),
    )
    out = n.join(own, BOOK).withColumn("required", F.ceil(F.col("countable") * F.col("required_pct") / 100))
    share = lambda c: F.round(percent(F.col(c), F.col("countable")), 2)
    return out.select(
        "*", share("examined").alias("examined_pct"), share("evidenced").alias("evidenced_pct"), (F.col("examined") >= F.col("required")).alias("meets_on_examined"), (F.col("evidenced") >= F.col("required")).alias("meets_on_evidenced")
    )


def unevidenced(marked: DataFrame) -> DataFrame:
    """Welds marked examined without a report, with their ``place`` in their book by the order of their numbers."""
    order = Window.partitionBy(BOOK).orderBy(natural_key(F.col("weld_number")), "id")
    return marked.where(F.col("examined") & ~F.col("evidenced")).withColumn("place", F.row_number().over(order))


def claims_without_report(marked: DataFrame) -> DataFrame:
    """Examined welds that neither link a report nor are on a line of one."""
    return marked.where(F.col("examined") & F.col("ndt_report_id").isNull() & ~F.col("evidenced"))


def orphan_lines(reports: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of live reports that name a weld which the log does not have."""
    live = live_reports(reports).select(BOOK, F.col("id").alias("nde_report_id"), "report_date")
    return lines.where("weld_id IS NULL AND weld_number <> ''").join(live, [BOOK, "nde_report_id"]).select(BOOK, "nde_report_id", "report_date", "weld_number")


def ticket_of(ticket: Column, xray: Column) -> Column:
    """The ticket a weld was examined under, whichever column has it."""
    return F.coalesce(F.nullif(F.trim(ticket), F.lit("")), F.nullif(F.trim(xray), F.lit("")))


def welds_of_tickets(welds: DataFrame, reports: DataFrame) -> DataFrame:
    """(job_book_id, report_id, weld_id): welds whose ticket is the number of a report, by the loose key of both.

    Every pair is a row of the result, so rows grow with the square of a ticket's. Lists of ids meet, not single rows, and are unfolded where
    they meet: the join makes a row for every two lists, and a task holds no more than lists. The lists of a ticket meet in blocks, so the
    pairs of one ticket are made in many tasks.
    """
    key = weld_number_key(ticket_of(F.col("ndt_ticket_number"), F.col("xray_number")))
    probes = reports.select(BOOK, F.col("id").alias("report_id"), weld_number_key(F.col("report_number")).alias("_k")).where("_k IS NOT NULL")
    targets = countable(welds).select(BOOK, F.col("id").alias("weld_id"), key.alias("_k")).where("_k IS NOT NULL")
    by = [BOOK, "_k"]
    both = all_pairs(lists(probes, by, "report_id", "_reports"), lists(targets, by, "weld_id", "_welds"), by, "_reports", "_welds", LISTS, LISTS)
    return both.select(BOOK, F.explode("_reports").alias("report_id"), "_welds").select(BOOK, "report_id", F.explode("_welds").alias("weld_id"))


# Flanges and test packages


def flange_points(connections: DataFrame, points: DataFrame) -> DataFrame:
    """Both directions: flagged flanges without a point (``awaiting``), and points of flanges that are not flagged (``orphan``)."""
    flagged = connections.where("cp_test_on_flange")
    own = points.where("torque_connection_id IS NOT NULL")
    awaiting = flagged.join(own.select(BOOK, F.col("torque_connection_id").alias("id")), [BOOK, "id"], "left_anti").select(BOOK, F.lit("awaiting").alias("gap"), "id")
    orphans = own.join(flagged.select(BOOK, F.col("id").alias("torque_connection_id")), [BOOK, "torque_connection_id"], "left_anti").select(BOOK, F.lit("orphan").alias("gap"), "id")
    return awaiting.unionByName(orphans)


def test_coverage(welds: DataFrame, packages: DataFrame, number: str = "test_identifier") -> DataFrame:
    """(job_book_id, key, in_referenced, in_disk, in_result): tests that welds name, packages on file, and those with a result."""
    key = F.nullif(F.trim(number), F.lit(""))
    sets = {"referenced": (welds, F.nullif(F.trim("pressure_test_ref"), F.lit(""))), "disk": (packages, key), "result": (packages.where("result_document_id IS NOT NULL"), key)}
    return membership(sets, [BOOK])


# Isometric drawings


def isometric_number(name: Column) -> Column:
    """The line number in a drawing's name, such as ``2-GA-104-ACM``, upper-cased; NULL where there is none."""
    text = F.upper(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""))
    for noise in NOISE:
        text = F.regexp_replace(text, noise, " ")
    return F.nullif(F.regexp_extract(text, r"\b\d+(?:-\d+/\d+)?-[A-Z]{2}-[A-Z0-9]+-[A-Z]{3,4}\b", 0), F.lit(""))


def revision(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(?i)\bRev\s*(\d+)", 1), F.lit(""))


def markup(path: Column) -> Column:
    """What a drawing's path says: the number of check marks, stamped, completed, threaded, and who signed."""
    owner = F.nullif(F.regexp_extract(path, CHECK + r"\s*([A-Z][A-Za-z]{1,20})\b", 1), F.lit(""))
    return F.struct(
        F.regexp_count(path, F.lit(CHECK)).alias("checks"), path.rlike("(?i)(^|/)stamped(/|$)").alias("stamped"), path.rlike(r"(?i)\bcompleted\b").alias("completed"),
        path.rlike(r"(?i)\(thrd\)").alias("threaded"), F.when(~F.lower(owner).isin("completed", "stamped", "thrd"), owner).alias("signed_by"),
    )


def attributed(documents: DataFrame) -> DataFrame:
    """Drawings with the isometric they show (by tag, else by name) and by which of the two; neither: unattributable."""
    tag = F.when(F.col("record_type") == "isometric", F.nullif(F.upper(F.trim("record_id")), F.lit("")))
    by_name = isometric_number(F.col("original_filename"))
    kind = F.when(tag.isNotNull(), "tagged").when(by_name.isNotNull(), "filename").otherwise("unattributable")
    return documents.withColumn("isometric", F.coalesce(tag, by_name)).withColumn("attribution", kind)


def drawings_against_logs(welds: DataFrame, connections: DataFrame, drawings: DataFrame) -> DataFrame:
    """(job_book_id, section, isometric, in_welds, in_torque, n_drawings, n_marked) of every isometric that a log names or a
    drawing shows. ``drawings``: attributed, with their section; those of one section count for it alone.

    Section 21 needs one check mark on a drawing, 22 two.
    """
    name = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    no = F.lit(0)
    referenced = (
        countable(welds).select(BOOK, name("isometric_number").alias("isometric"), F.lit(1).alias("w"), no.alias("t"))
        .unionByName(connections.select(BOOK, name("iso_number").alias("isometric"), no.alias("w"), F.lit(1).alias("t")))
        .where("isometric IS NOT NULL").groupBy(BOOK, "isometric").agg(F.max("w").alias("w"), F.max("t").alias("t"))
    )
    owed = referenced.select(BOOK, F.explode(F.array(F.lit("21"), F.lit("22"))).alias("section"), "isometric", "w", "t", no.alias("n"), no.alias("m"))
    marked = F.coalesce(F.col("checks"), no) >= F.when(F.col("section") == "21", 1).otherwise(2)
    on_file = drawings.where("isometric IS NOT NULL").select(BOOK, "section", "isometric", no.alias("w"), no.alias("t"), F.lit(1).alias("n"), marked.cast("int").alias("m"))
    both = owed.unionByName(on_file).groupBy(BOOK, "section", "isometric")
    return both.agg((F.max("w") > 0).alias("in_welds"), (F.max("t") > 0).alias("in_torque"), F.sum("n").alias("n_drawings"), F.sum("m").alias("n_marked"))


def isometric_coverage(matched: DataFrame) -> DataFrame:
    """Per book and section: referenced (by each log), covered, missing, extraneous and awaiting markup (once marks are in use)."""
    owed = F.col("in_welds") | F.col("in_torque")
    out = matched.groupBy(BOOK, "section").agg(
        F.count_if(owed).alias("referenced"), F.count_if("in_welds").alias("from_welds"), F.count_if("in_torque").alias("from_torque"), F.count_if(owed & (F.col("n_drawings") > 0)).alias("covered"),
        F.count_if(owed & (F.col("n_drawings") == 0)).alias("missing"), F.count_if(~owed).alias("extraneous"), F.count_if(owed & (F.col("n_drawings") > 0) & (F.col("n_marked") == 0)).alias("unmarked"), (F.sum("n_marked") > 0).alias("marks_in_use"),
    )
    awaiting = F.when(F.col("marks_in_use"), F.col("unmarked")).otherwise(0)
    return out.withColumn("awaiting_markup", awaiting).drop("unmarked").withColumn("covered_pct", F.round(percent(F.col("covered"), F.col("referenced")), 2))
