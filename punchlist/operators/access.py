"""Searches, visible rows, validations, and what linking a certificate changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def searched(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows of which some column contains the text, in any case; an empty query finds all."""
    q = query.strip().lower()
    hits = [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(q)) for c in columns]
    return df.where(reduce(Column.__or__, hits)) if q else df


#: How severe a finding can be.
SEVERITIES = ("critical", "warning", "info")


def library(documents: DataFrame, section: str | None = None, query: str = "") -> DataFrame:
    """A document library: one section, or all of them, and a text in a document's own name, its conforming name or its section's title."""
    own = documents if not section else documents.where(F.col("section_number") == section)
    return searched(own, ["original_filename", "normalized_filename", "section_title"], query)


def of_severity(findings: DataFrame, severity: str = "all") -> DataFrame:
    """Findings of one severity, or all of them, the severest first, then by rule: ``place`` is their order in a book."""
    if severity not in ("all", *SEVERITIES):
        raise ValueError(f"no such severity: {severity}")
    rank = F.array_position(F.array(*[F.lit(x) for x in SEVERITIES]), F.col("severity"))
    kept = findings if severity == "all" else findings.where(F.col("severity") == severity)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("job_book_id").orderBy(rank, "rule_id")))


def visible(rows: DataFrame, book: str, assigned: DataFrame, own_org: DataFrame, granted: DataFrame, person: str) -> DataFrame:
    """(row, person) pairs of the books that each person may read: assigned, of their organisation, or granted; each once."""
    pairs = reduce(DataFrame.unionByName, [d.select(book, person) for d in (assigned, own_org, granted)]).distinct()
    return rows.join(pairs, book)


def unexpired(granted: DataFrame, as_of: Column, expires: str = "expires_at") -> DataFrame:
    """Grants that hold on a day: those without an end, and those that end after it."""
    return granted.where(F.col(expires).isNull() | (F.col(expires) > as_of))


def problems(df: DataFrame, key: list[str], checks: list[tuple[str, Column]]) -> DataFrame:
    """Every problem of every row: a check that is not known to hold is a problem."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(label)) for label, ok in checks]))
    return df.select(*key, F.explode(found).alias("problem"))


def library_links(heats: DataFrame, library: DataFrame, key: str, status: str, withdrawn: Column) -> DataFrame:
    """Heats against a shared library by a loose key: ``missing`` becomes ``on_file`` where a live certificate has the key, and
    what hung on a withdrawn one goes back; other states stay."""
    found = library.groupBy(key).agg(F.bool_or(~withdrawn).alias("_live"), F.bool_or(withdrawn).alias("_gone"))
    joined = heats.join(found, key, "left")
    moved = F.when((F.col(status) == "missing") & F.col("_live"), "on_file").when((F.col(status) == "on_file") & F.col("_gone") & ~F.col("_live"), "missing").otherwise(F.col(status))
    return joined.withColumn("status_after", moved).drop("_live", "_gone")


def effect(before: DataFrame, after: DataFrame, event: str, verdict: str = "verdict", good: str = "valid") -> DataFrame:
    """What a change does to verdicts: how many become good, how many stop being so."""
    both = before.select(event, F.col(verdict).alias("_b")).join(after.select(event, F.col(verdict).alias("_a")), event)
    return both.groupBy().agg(F.count_if((F.col("_b") != good) & (F.col("_a") == good)).alias("resolved"), F.count_if((F.col("_b") == good) & (F.col("_a") != good)).alias("exposed"), F.count_if(F.col("_b") == F.col("_a")).alias("unchanged"))


def work_after_expiry(certs: DataFrame, work: DataFrame, cert: str, subject: str, expires: str, at: str) -> DataFrame:
    """Per certificate the work of its subject after it lapsed. Work is counted by day first, so that neither a busy subject nor
    one with many certificates makes more rows than it has days."""
    days = work.select(subject, F.col(at).alias("_d")).where("_d IS NOT NULL").groupBy(subject, "_d").agg(F.count(F.lit(1)).alias("_n"))
    joined = certs.select(cert, subject, expires).join(days, subject, "left")
    late = F.col("_d") > F.col(expires)
    return joined.groupBy(cert).agg(F.coalesce(F.sum(F.when(late, F.col("_n"))), F.lit(0)).alias("n_after"), F.max(F.when(late, F.col("_d"))).alias("last_after"))


#: Roles of readers outside the company, and the columns of welds and sections that they may see.
EXTERNAL = ["client_user", "third_party_inspector"]
CLIENT_WELD = ["job_book_id", "id", "weld_number", "weld_date", "joint_type", "component_description", "heat_numbers", "cwi_visual_result", "ndt_method", "ndt_result", "status"]
CLIENT_SECTION = ["job_book_id", "id", "section_number", "status", "na_reason", "computed_pct"]


def redacted_documents(documents: DataFrame, role: str) -> DataFrame:
    """What a role sees of a book's documents: outside the company, approved ones that are not internal."""
    return documents.where("is_approved AND visibility IS DISTINCT FROM 'internal'") if role in EXTERNAL else documents


def projected(df: DataFrame, role: str, columns: list[str]) -> DataFrame:
    """The columns of a view for readers outside the company; scores stay those that were stamped, never computed anew."""
    return df.select(*columns) if role in EXTERNAL else df


PRESETS = ("all", "uninspected", "wrench_issue", "cp")


def torque_preset(rows: DataFrame, preset: str, query: str = "") -> DataFrame:
    """One of four presets over a torque log (inspection_date, verdict, cp_test_on_flange), then a search by flange, isometric and wrench."""
    if preset not in PRESETS:
        raise ValueError(f"no preset {preset}")
    kept = {"all": F.lit(True), "uninspected": F.col("inspection_date").isNull(), "wrench_issue": F.col("verdict") != "valid", "cp": F.coalesce(F.col("cp_test_on_flange"), F.lit(False))}[preset]
    return searched(rows.where(kept), ["iso_flange_number", "iso_number", "wrench_id_raw"], query)


def library_search(library: DataFrame, query: str) -> DataFrame:
    """Live certificates by the loose key of a heat, or text in the description or the mill's name."""
    from ..functions.keys import heat_key

    live = library.where("NOT coalesce(is_deleted, false)")
    q = query.strip()
    if not q:
        return live
    text = reduce(Column.__or__, [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(q.lower())) for c in ("material_description", "mill_name")])
    return live.where(text | F.coalesce(F.contains("heat_key", heat_key(F.lit(q))), F.lit(False)))


def capable(people: DataFrame, capabilities: DataFrame, grants: DataFrame, on: Column) -> DataFrame:
    """(person, capability): those of the person's role, and those of grants that have not expired on a day; each once.
    ``capabilities`` (role, capability) is a table of some dozens of rows."""
    own = people.join(capabilities, "role").select("person", "capability")
    live = grants.where(F.col("expires_on").isNull() | (F.col("expires_on") >= on)).select("person", "capability")
    return own.unionByName(live).distinct()


def competency_gaps(level: Column) -> Column:
    """What a level of competency keeps a person from; an unknown one keeps from everything."""
    custodian = F.coalesce(level != "JB-1", F.lit(False))
    peer = F.coalesce(level.isin("JB-3", "JB-4"), F.lit(False))
    return F.array_compact(F.array(F.when(~custodian, F.lit("cannot be named Custodian")), F.when(~peer, F.lit("cannot perform a Tier 2 peer audit"))))


def new_book_issues(books: DataFrame, lines: DataFrame, scope: DataFrame, divisions: list[str]) -> DataFrame:
    """(book, severity, field): every fault of a declaration. ``lines``: book, line_code, expected; ``scope``: book, section, expected.

    Per-line joints that differ from the scope of section 12 by more than a tenth are a warning, as are a missing scope and window.
    """
    code = F.upper(F.trim("line_code"))
    of_lines = lines.groupBy("book").agg(F.count_if(F.coalesce(F.trim("line_code"), F.lit("")) == "").alias("uncoded"), (F.count(F.nullif(code, F.lit(""))) - F.count_distinct(F.nullif(code, F.lit("")))).alias("again"), F.coalesce(F.sum("expected"), F.lit(0)).alias("joints"))
    of_scope = scope.groupBy("book").agg(F.count_if(F.col("expected") < 0).alias("negative"), F.count_if(F.col("expected") > 0).alias("scoped"), F.max(F.when(F.col("section") == "12", F.col("expected"))).alias("welds"))
    b = books.join(of_lines, "book", "left").join(of_scope, "book", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    off = (zero("joints") > 0) & (zero("welds") > 0) & (F.abs(zero("joints") - zero("welds")) / zero("welds") > 0.1)
    checks = [
        ("error", "jobNumber", blank("job_number")), ("error", "clientOrgId", F.col("client_org_id").isNull()), ("error", "division", ~F.col("division").isin(divisions)), ("error", "constructionEnd", F.col("construction_start") > F.col("construction_end")),
        ("error", "scope", zero("negative") > 0), ("error", "weldLines.code", zero("uncoded") > 0), ("error", "weldLines.duplicate", zero("again") > 0), ("warning", "scope", zero("scoped") == 0),
        ("warning", "constructionWindow", F.col("construction_start").isNull() | F.col("construction_end").isNull()), ("warning", "weldLines", off),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(there, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(f).alias("field"))) for s, f, there in checks]))
    return b.select("book", F.explode(found).alias("f")).select("book", "f.*")


def pulled_cards(cards: DataFrame, welds: DataFrame, reports: DataFrame, existing: DataFrame, namespace: str) -> DataFrame:
    """Personal cards for every book in which the person signed something, with an id that the same card gets again; cards that
    a book already has are left out. ``cards``: card_id, subject_type, subject_id and whatever else a certificate carries."""
    from ..functions.keys import record_id

    signed = welds.where("cwi_id IS NOT NULL").select("job_book_id", F.lit("cwi").alias("subject_type"), F.col("cwi_id").alias("subject_id"))
    signed = signed.unionByName(reports.where("technician_id IS NOT NULL").select("job_book_id", F.lit("ndt_technician").alias("subject_type"), F.col("technician_id").alias("subject_id"))).distinct()
    pulled = cards.join(signed, ["subject_type", "subject_id"]).withColumn("id", record_id(namespace, F.lit("certificate"), F.col("job_book_id"), F.col("card_id").cast("string")))
    return pulled.join(existing.select("id"), "id", "left_anti")


def withdrawn_copies(certificates: DataFrame, library: DataFrame) -> DataFrame:
    """Certificates with the time they were withdrawn: their own, else that of the card they were pulled from."""
    gone = library.where("deleted_at IS NOT NULL").select(F.col("card_id").alias("credential_library_id"), F.col("deleted_at").alias("_gone"))
    out = certificates.join(gone, "credential_library_id", "left")
    return out.withColumn("deleted_at", F.coalesce("deleted_at", "_gone")).drop("_gone")


def backup_health(runs: DataFrame, objects: DataFrame, now: Column) -> DataFrame:
    """The last run with its state and age in hours, and the files and bytes that are live in the archive; one row."""
    last = runs.agg(F.max_by(F.struct("started_at", "status"), F.struct("started_at", "id")).alias("r"))
    live = objects.where("superseded_at IS NULL").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes"))
    both = last.withColumn("one", F.lit(1)).join(live.withColumn("one", F.lit(1)), "one")  # one row each
    hours = F.round((F.unix_timestamp(now) - F.unix_timestamp("r.started_at")) / 3600, 1)
    return both.where("r IS NOT NULL").select(F.col("r.started_at").alias("last_run_at"), F.col("r.status").alias("last_status"), hours.alias("hours_since"), "files", "bytes")
