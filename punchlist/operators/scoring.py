"""Weighted completion: sections against declared scope, books as weighted means, and stamped caches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import collation_key, percent, scoped
from . import completeness, evidence, validity


def section_scores(sections: DataFrame, facts: DataFrame, keys: list[str], declared: str, done: str = "done", entered: str = "entered") -> DataFrame:
    """Each section's percent of the larger of declared and entered counts; sections without facts score 0."""
    joined = sections.join(facts, keys, "left")
    whole = scoped(F.col(declared), F.coalesce(F.col(entered), F.lit(0)))
    return joined.withColumn("scope", whole).withColumn("pct", F.round(percent(F.coalesce(F.col(done), F.lit(0)), whole), 2))


BOOK = "job_book_id"
#: The section that a kind of source document belongs to.
SOURCE_SECTION = {"nde_report": "10", "weld_log_overview": "11", "weld_log": "12", "calibration_certificate": "13", "torque_log": "14", "pressure_test": "17", "pressure_recorder_certificate": "17", "cwi_certificate": "7", "ndt_certificate": "8"}


def source_section(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in SOURCE_SECTION.items() for x in pair])[kind]


def after_upload(status: Column) -> Column:
    """A section's state after a file arrives: one known to have a backlog keeps it, every other is imported."""
    return F.when(status == "not_imported", "not_imported").otherwise("imported")


def _complete(df: DataFrame, missing: Column, kind: str) -> DataFrame:
    return df.groupBy(BOOK).agg(F.lit(kind).alias("kind"), F.count_if(F.size(missing) == 0).alias("done"), F.count(F.lit(1)).alias("entered"))


def _covered(work: DataFrame, certificates: DataFrame, kind: str) -> DataFrame:
    """People (or tools) of (job_book_id, subject_id, day) whose every day of work a certificate covers."""
    days = work.where("subject_id IS NOT NULL AND day IS NOT NULL").select(BOOK, "subject_id", "day").distinct()
    own = certificates.where(F.col("subject_type") == kind).select(BOOK, "subject_id", F.col("issue_date").alias("s"), F.col("expiry_date").alias("e"))
    valid = validity.covered_days(days, own.dropna(subset=[BOOK, "subject_id"]), [BOOK, "subject_id"], "day", "s", "e")
    per = valid.groupBy(BOOK, "subject_id").agg(F.bool_and("live").alias("ok"))
    return per.groupBy(BOOK).agg(F.lit(kind).alias("kind"), F.count_if("ok").alias("done"), F.count(F.lit(1)).alias("entered"))


def record_facts(t: dict[str, DataFrame]) -> DataFrame:
    """(job_book_id, kind, done, entered, extra): for each kind of section how many records are complete of how many there are;
    ``extra`` are wanted beyond the declared scope (examined welds). Kinds whose tables are not loaded are left out."""
    parts = []
    has = lambda *names: all(n in t for n in names)
    if has("weld"):
        parts.append(_complete(evidence.countable(t["weld"]), completeness.weld_missing(), "weld"))
        if has("certificate"):
            passes = F.explode(F.array_distinct(F.array_compact(F.array(*[F.col(f"{p}_welder_id") for p in ("root", "hot", "fill", "cap")]))))
            parts.append(_covered(evidence.countable(t["weld"]).select(BOOK, passes.alias("subject_id"), F.col("weld_date").alias("day")), t["certificate"], "welder"))
    if has("torque_connection"):
        parts.append(_complete(t["torque_connection"], completeness.torque_missing(), "torque_connection"))
    if has("torque_connection", "torque_wrench"):
        codes = t["torque_wrench"].select("id", F.col("wrench_id").alias("code"), "cert_on_file")
        c = t["torque_connection"].select(BOOK, F.col("wrench_id").alias("id"), "wrench_id_raw").join(codes.select("id", F.col("code").alias("own")), "id", "left")
        used = c.select(BOOK, F.coalesce("wrench_id_raw", "own").alias("code")).where("code IS NOT NULL").distinct().join(codes.groupBy("code").agg(F.bool_or("cert_on_file").alias("f")), "code", "left")
        parts.append(used.groupBy(BOOK).agg(F.lit("equipment").alias("kind"), F.count_if(F.coalesce("f", F.lit(False))).alias("done"), F.count(F.lit(1)).alias("entered")))
    if has("weld", "material_heat"):
        used = evidence.countable(t["weld"]).select(BOOK, F.explode("heat_numbers").alias("h")).select(BOOK, F.trim("h").alias("key")).where("key <> ''").distinct()
        done = t["material_heat"].withColumn("key", F.trim("heat_number")).join(used, [BOOK, "key"], "left_semi").groupBy(BOOK).agg(F.count_if(F.size(completeness.heat_missing()) == 0).alias("done"))
        parts.append(used.groupBy(BOOK).agg(F.count(F.lit(1)).alias("entered")).join(done, BOOK, "left").select(BOOK, F.lit("material_heat").alias("kind"), F.coalesce("done", F.lit(0)).alias("done"), "entered"))
    if has("pressure_test", "certificate"):
        parts.append(_complete(completeness.pressure_missing(t["pressure_test"], t["certificate"]), F.col("missing"), "pressure_test"))
    if has("torque_connection", "cp_test_point"):
        flagged = t["torque_connection"].groupBy(BOOK).agg(F.count_if("cp_test_on_flange").alias("flagged"))
        points = t["cp_test_point"].groupBy(BOOK).agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("baseline_potential_v").isNotNull() & F.col("reading_date").isNotNull()).alias("done"))
        owed = F.when(F.coalesce("flagged", F.lit(0)) > 0, F.col("flagged")).otherwise(F.coalesce("points", F.lit(0)))
        parts.append(flagged.join(points, BOOK, "full").select(BOOK, F.lit("cp_test_point").alias("kind"), F.coalesce("done", F.lit(0)).alias("done"), owed.alias("entered")))
    if has("nde_report", "certificate"):
        live = evidence.live_reports(t["nde_report"])
        parts.append(_covered(live.select(BOOK, F.col("technician_id").alias("subject_id"), F.col("report_date").alias("day")), t["certificate"], "ndt_technician"))
    out = reduce(DataFrame.unionByName, [p.withColumn("extra", F.lit(0).cast("long")) for p in parts])
    if has("nde_report", "weld"):
        reports = evidence.live_reports(t["nde_report"]).groupBy(BOOK).agg(F.count(F.lit(1)).alias("entered"), F.count("document_id").alias("filed"))
        seen = evidence.countable(t["weld"]).where("ndt_method IS NOT NULL").groupBy(BOOK).agg(F.count(F.lit(1)).alias("extra"), F.count("ndt_report_id").alias("linked"))
        zero = lambda c: F.coalesce(c, F.lit(0))
        out = out.unionByName(reports.join(seen, BOOK, "full").select(BOOK, F.lit("nde_report").alias("kind"), (zero("filed") + zero("linked")).alias("done"), zero("entered").alias("entered"), zero("extra").alias("extra")))
    return out


def scored_sections(sections: DataFrame, facts: DataFrame, documents: DataFrame, isometrics: DataFrame | None = None) -> DataFrame:
    """Each section's percent and whether it counts, by its kind; the scope is the larger of what was declared and entered.

    Sections that were not imported score 0 and count; those that do not apply, supplemental and derived ones do not count.
    ``facts``: ``record_facts``; ``documents``: those that are live, by ``section_id``; ``isometrics``: ``isometric_coverage``.
    """
    docs = documents.groupBy(BOOK, F.col("section_id").alias("id")).agg(F.count(F.lit(1)).alias("n_docs"))
    out = sections.join(docs, [BOOK, "id"], "left").join(facts.withColumnRenamed("kind", "scored_by"), [BOOK, "scored_by"], "left")
    if isometrics is not None:
        own = isometrics.select(BOOK, F.col("section").alias("section_number"), F.col("covered").alias("i_done"), F.col("referenced").alias("i_entered"))
        out = out.join(own, [BOOK, "section_number"], "left").withColumn("done", F.when(F.col("scored_by") == "isometric", F.col("i_done")).otherwise(F.col("done"))).withColumn("entered", F.when(F.col("scored_by") == "isometric", F.col("i_entered")).otherwise(F.col("entered")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    wanted = F.greatest(F.lit(1), F.coalesce("expected_count", "min_documents"))
    of_documents = F.when(F.col("scored_by") == "supplemental", F.when(zero("n_docs") > 0, 100.0).otherwise(0.0)).otherwise(percent(zero("n_docs"), wanted))
    of_records = percent(zero("done"), scoped(F.col("expected_count"), zero("entered")) + zero("extra"))
    pct = (
        F.when((F.col("ingestion_status") == "not_imported") | (F.col("status") == "na") | (F.col("scored_by") == "derived"), 0.0)
        .when(F.col("scored_by").isin("document", "supplemental"), of_documents).otherwise(of_records)
    )
    unread = F.coalesce(F.col("ingestion_status") == "not_imported", F.lit(False))
    counts = unread | ((F.col("status") != "na") & ~F.col("scored_by").isin("supplemental", "derived"))
    return out.select(*sections.columns, F.round(pct, 2).alias("pct"), counts.alias("counts"))


def applicable_sections(books: DataFrame, template: DataFrame, sections: DataFrame) -> DataFrame:
    """The template's sections that apply to a book's type, less those marked as not applicable; ``template`` (section_number,
    applies_to: both or a type) is some dozens of rows."""
    own = sections.join(template, "section_number").join(books.select(F.col("id").alias(BOOK), "book_type"), BOOK)
    return own.where("(applies_to = 'both' OR applies_to = book_type) AND status <> 'na'")


def unscaffolded(books: DataFrame, template: DataFrame, sections: DataFrame) -> DataFrame:
    """(job_book_id, section_number): sections of the template that apply to a book's type, or to both types, and that the book lacks; a
    section that is marked as not applicable is there. A book whose type is NULL is asked for what applies to both."""
    asked = books.select(F.col("id").alias(BOOK), F.explode(F.array_distinct(F.array(F.lit("both"), F.col("book_type")))).alias("applies_to"))
    wanted = asked.join(template, "applies_to").select(BOOK, "section_number").distinct()
    return wanted.join(sections.select(BOOK, "section_number"), [BOOK, "section_number"], "left_anti")


def missing_sections(scored: DataFrame, book: list[str]) -> DataFrame:
    """Counted sections at 0 that were read, with their place by weight: what to fetch first."""
    empty = scored.where("counts AND pct = 0 AND ingestion_status IS DISTINCT FROM 'not_imported'")
    order = Window.partitionBy(*book).orderBy(F.desc("weight"), collation_key(F.col("section_number")), "section_number")
    return empty.withColumn("place", F.row_number().over(order))


def book_scores(scored: DataFrame, book: list[str], weight: str = "weight", counted: Column | None = None, read: Column | None = None) -> DataFrame:
    """The weighted mean over counted sections; a lower bound if a counted section was never read."""
    ok = counted if counted is not None else F.lit(True)
    known = read if read is not None else F.lit(True)
    w = F.when(ok, F.col(weight))
    out = scored.groupBy(*book).agg(
        F.round(F.sum(w * F.col("pct")) / F.sum(w), 2).alias("score"), F.count_if(ok).alias("n_counted"),
        F.round(percent(F.sum(F.when(known, w)), F.sum(w)), 2).alias("evidence_pct"), F.coalesce(F.bool_or(ok & ~known), F.lit(False)).alias("lower_bound"),
    )
    return out.withColumn("band", score_band(F.col("score")))


def score_band(score: Column) -> Column:
    return F.when(score >= 95, "complete").when(score >= 75, "near").when(score >= 50, "partial").otherwise("early")


def weight_loss(scored: DataFrame, weight: str = "weight") -> DataFrame:
    """How much of the book's score each section costs; order by loss descending, then section."""
    return scored.withColumn("loss", F.round(F.col(weight) * (100 - F.col("pct")) / 100, 4))


def stale(cached: DataFrame, fresh: DataFrame, keys: list[str], cached_pct: str, fresh_pct: str, tolerance: float = 0.005) -> DataFrame:
    """Cached scores that differ from what they would be now, or that nothing backs any more."""
    both = cached.join(fresh, keys, "full_outer")
    gap = F.abs(F.col(cached_pct) - F.col(fresh_pct))
    return both.where(gap.isNull() | (gap > tolerance))
