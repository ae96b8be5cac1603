"""Overview sheets of weld logs: register rows from positioned tokens, the sheet held against itself, and the import of its people.

A sheet is (sheet, line_no, x, text): tokens with their place on a line. Nothing counts columns, as a missing value would shift all that
follow; what a token is follows from its shape, and what a row is from the kinds of its tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import us_date
from ..sources.shared import written
from .identity import identities, name_key, ranked_names

#: What the printed form calls its joint types, its totals, the headings above its tables, and qualifications of inspectors.
JOINT_TYPES = r"(?i)^(butt|o-?let|socket|seal)\s+we?lds?$"
TOTALS = r"(?i)^project totals$"
HEADINGS = r"(?i)^(welder|stamp|expires|submitted|user input|seal)"
QUALIFICATIONS = ["CWI", "NDT", "RT", "UT", "MT", "PT"]
#: Labels of the form's heading, each followed by its value to the right.
HEADER_LABELS = {"location": r"(?i)^location name:$", "sheet_date": r"(?i)^date:$", "representative": r"(?i)QA/QC representative:$", "welding_company": r"(?i)^welding company:$", "operator_pic": r"(?i)\bPIC:$"}
#: How far right of the last heading of the left tables they may reach, and where they end on a sheet without headings.
MARGIN, NO_HEADINGS = 40.0, 460.0

COUNT, PERCENT, DATE, DASH = r"^\d[\d,]*$", r"^[\d.]+\s*%$", r"^\d{1,2}/\d{1,2}/\d{2,4}$", r"^-{1,3}$"
#: One name for a stamp of several people: blanks inside, or a conjunction.
COMBINED = r"(?i)\S\s+\S|\b(and|&|/|\+)\b"


def _number(text: Column) -> Column:
    return F.regexp_replace(text, r"[,%\s]", "").try_cast("double")


def _of_kind(cells: Column, shape: str) -> Column:
    return F.filter(cells, lambda c: c.rlike(shape))


def sheet_lines(runs: DataFrame) -> DataFrame:
    """(sheet, line_no, side, cells): the tokens of each line in order, left and right of where the left tables end."""
    tokens = runs.select("sheet", "line_no", "x", F.trim("text").alias("text")).where("text <> ''")
    by_line = tokens.groupBy("sheet", "line_no").agg(F.array_sort(F.collect_list(F.struct("x", "text"))).alias("tokens"))
    text = F.array_join(F.transform("tokens", lambda t: t.text), " ")
    ends = F.when(text.rlike(r"\bWelds\b") & text.rlike(r"\bVisuals\b"), F.struct(F.col("line_no"), F.array_max(F.transform("tokens", lambda t: t.x)).alias("x")))
    cut = by_line.groupBy("sheet").agg(F.coalesce(F.min(ends)["x"] + MARGIN, F.lit(NO_HEADINGS)).alias("cut"))
    placed = by_line.join(cut, "sheet")
    side = lambda keep: F.transform(F.filter("tokens", keep), lambda t: t.text)
    both = F.array(F.struct(F.lit("left").alias("side"), side(lambda t: t.x < F.col("cut")).alias("cells")), F.struct(F.lit("right").alias("side"), side(lambda t: t.x >= F.col("cut")).alias("cells")))
    return placed.select("sheet", "line_no", F.explode(both).alias("s")).select("sheet", "line_no", "s.side", "s.cells").where(F.size("cells") > 0)


def overview_rows(runs: DataFrame) -> DataFrame:
    """One row per line that says something: role (welder, joint_type, total, inspector), label, stamp, dates, counts and percentages.

    A dash is not recorded, never zero. A welder's stamp stands before the expiry date, or before the word for submitted where no date
    was written; without either it is unknown.
    """
    first, rest = F.get("cells", F.lit(0)), F.slice("cells", 2, 1000)
    counts = F.transform(_of_kind(rest, COUNT), _number)
    shares = F.transform(_of_kind(rest, PERCENT), _number)
    submitted = F.exists(rest, lambda c: F.lower(c) == "submitted")
    anchors = F.filter(F.sequence(F.lit(1), F.size(rest)), lambda i: F.get(rest, i - 1).rlike(DATE) | (F.lower(F.get(rest, i - 1)) == "submitted"))
    anchor = F.when(F.size(rest) > 0, F.get(anchors, F.lit(0)))
    qualification = F.upper(F.get("cells", F.lit(1)))
    a_name = first.rlike(r"^[A-Z][A-Za-z.'\- ]{2,}$") & ~first.rlike(HEADINGS)
    left = (F.col("side") == "left") & (F.size("cells") >= 2)
    role = (
        F.when((F.col("side") == "right") & qualification.isin(QUALIFICATIONS), "inspector")
        .when(left & first.rlike(JOINT_TYPES), "joint_type")
        .when(left & first.rlike(TOTALS), "total")
        .when(left & a_name & (F.size(counts) > 0), "welder")
    )
    rows = sheet_lines(runs).select("sheet", "line_no", role.alias("role"), first.alias("label"), qualification.alias("q"), rest.alias("rest"), counts.alias("counts"), shares.alias("shares"), submitted.alias("submitted"), anchor.alias("anchor"))
    welder, inspector = F.col("role") == "welder", F.col("role") == "inspector"
    numbers = ~inspector
    dashes = F.size(_of_kind(F.col("rest"), DASH)) > 0
    whole = lambda c: F.when(numbers, c).cast("long")
    return rows.where("role is not null").select(
        "sheet", "line_no", "role", F.when(F.col("role") == "total", "Project Totals").otherwise(F.col("label")).alias("label"),
        F.when(welder, F.when(F.col("anchor") > 1, F.get("rest", F.col("anchor") - 2)).otherwise("")).alias("stamp"),
        F.when(welder, us_date(F.get(_of_kind(F.col("rest"), DATE), F.lit(0)))).alias("wpq_expires"),
        F.when(welder | inspector, F.col("submitted")).alias("submitted"), F.when(inspector, F.col("q")).alias("qualification"),
        whole(F.get("counts", F.lit(0))).alias("weld_count"), F.when(numbers, F.get("shares", F.lit(0))).alias("visual_pct"), F.when(numbers, F.get("shares", F.lit(1))).alias("ndt_pct"),
        whole(F.when(~dashes, F.get("counts", F.lit(1)))).alias("failed_visuals"), whole(F.get("counts", F.size("counts") - 1)).alias("failed_ndt"),
    )


def overview_headers(runs: DataFrame) -> DataFrame:
    """One row per sheet: the labelled values of its heading, the operator that the form is branded to, and the stated requirement."""
    tokens = runs.select("sheet", "line_no", "x", F.trim("text").alias("text")).where("text <> ''")
    lines = tokens.groupBy("sheet", "line_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda t: t.text).alias("cells"))
    pairs = F.transform("cells", lambda c, i: F.struct(c.alias("label"), F.get("cells", i + 1).alias("value")))
    pairs = F.filter(pairs, lambda p: p.label.endswith(":") & p.value.isNotNull() & ~p.value.endswith(":"))
    exploded = lines.select("sheet", "line_no", F.posexplode_outer(pairs).alias("i", "p"))
    place = F.struct("line_no", "i")
    named = [F.max_by("p.value", F.when(F.col("p.label").rlike(r), place)).alias(n) for n, r in HEADER_LABELS.items()]
    brand = F.max_by("p.label", F.when(F.col("p.label").rlike(HEADER_LABELS["operator_pic"]), place))
    head = exploded.groupBy("sheet").agg(*named, F.nullif(F.trim(F.regexp_replace(brand, r"(?i)\s*PIC:$", "")), F.lit("")).alias("operator_label"))
    # The requirement wraps over lines with a caption between its halves.
    texts = lines.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("line_no", F.array_join("cells", " ").alias("t")))).alias("ls"))
    stated = r"(?is)Requirement-\s*([\d.]+)%.{0,40}?visual\s*&\s*([\d.]+)%\s*NDE"
    flat = F.array_join(F.transform("ls", lambda x: x.t), " ")
    wanted = texts.select("sheet", *[F.regexp_extract(flat, stated, i).try_cast("double").alias(n) for i, n in ((1, "required_visual_pct"), (2, "required_nde_pct"))])
    return head.join(wanted, "sheet").withColumn("sheet_date", us_date(F.col("sheet_date")))


def overview_findings(rows: DataFrame, headers: DataFrame, books: DataFrame) -> DataFrame:
    """(sheet, rule_id, severity, subject, amount): a sheet's three accounts of the same welds against each other, and what its rows lack.

    ``books``: (sheet, construction_end, recorded_operator), either of them null where it is not known. ``amount`` is what the finding
    counts: welds without a welder, inspections beyond the welds, examinations owed.
    """
    of = lambda role: F.col("role") == role
    subject = F.when(of("welder"), F.concat("label", F.lit(" ("), F.when(F.col("stamp") == "", "no stamp").otherwise(F.col("stamp")), F.lit(")"))).otherwise(F.col("label"))
    sheets = headers.select("sheet", "operator_label", "required_nde_pct").join(books, "sheet", "left")

    totals = rows.groupBy("sheet").agg(
        *[F.coalesce(F.sum(F.when(of(r), F.col("weld_count"))), F.lit(0)).alias(f"by_{r}") for r in ("welder", "joint_type")], F.max(F.when(of("total"), F.col("weld_count"))).alias("stated")
    )
    gap = F.col("by_joint_type") - F.col("by_welder")
    rolled = (F.col("by_welder") > 0) & (F.col("by_joint_type") > 0)
    both = F.array_compact(F.array(
        F.when(rolled & (gap != 0), F.struct(F.lit("overview.rollups_disagree").alias("rule_id"), gap.alias("amount"))),
        F.when((F.col("by_welder") > 0) & ~F.col("stated").isin(F.col("by_welder"), F.col("by_joint_type")), F.struct(F.lit("overview.total_matches_neither").alias("rule_id"), F.col("stated").alias("amount"))),
    ))
    sums = totals.select("sheet", F.explode(both).alias("f")).select("sheet", "f.rule_id", F.lit("critical").alias("severity"), F.lit("Project Totals").alias("subject"), "f.amount")

    n, done, owed = F.col("weld_count"), F.round(F.col("ndt_pct") / 100 * F.col("weld_count")), F.ceil(F.col("required_nde_pct") / 100 * F.col("weld_count"))
    entry = lambda id, severity, amount: F.struct(F.lit(id).alias("rule_id"), F.lit(severity).alias("severity"), amount.cast("long").alias("amount"))
    above = lambda pct: F.when(F.col("role").isin("joint_type", "total") & (pct > 100), entry("overview.coverage_above_100", "critical", F.round(pct / 100 * n) - n))
    each = F.array_compact(F.array(
        above(F.col("visual_pct")), above(F.col("ndt_pct")),
        F.when(of("welder") & F.col("wpq_expires").isNull(), entry("overview.welder_without_wpq_expiry", "critical", n)),
        F.when(of("welder") & F.trim("stamp").rlike(COMBINED), entry("overview.combined_stamp", "critical", n)),
        F.when(of("welder") & (F.col("wpq_expires") < F.col("construction_end")), entry("overview.wpq_expires_in_window", "warning", n)),
        F.when(F.col("role").isin("welder", "joint_type") & (n > 0) & (F.col("ndt_pct") < F.col("required_nde_pct")), entry("overview.nde_below_requirement", "critical", owed - done)),
        F.when(of("inspector") & ~F.col("submitted"), entry("overview.inspector_documentation_missing", "warning", F.lit(None))),
    ))
    own = rows.join(sheets, "sheet", "left").select("sheet", subject.alias("subject"), F.explode(each).alias("f")).select("sheet", "f.rule_id", "f.severity", "subject", "f.amount")

    brand, known = F.lower("operator_label"), F.lower("recorded_operator")
    stale = sheets.where((known != "") & (brand != "") & ~F.contains(brand, known) & ~F.contains(known, brand))
    stale = stale.select("sheet", F.lit("overview.operator_branding_stale").alias("rule_id"), F.lit("warning").alias("severity"), F.concat("operator_label", F.lit(" PIC")).alias("subject"), F.lit(None).cast("long").alias("amount"))
    return sums.unionByName(own).unionByName(stale)


def people_plan(rows: DataFrame, register: DataFrame) -> DataFrame:
    """What importing sheets' welders into their books' registers would do: (book, row_id, stamp, name, wpq_expires, action, matched_by,
    person_id, skip_reason).

    ``rows``: (book, row_id, stamp, name, wpq_expires). ``register``: (book, person_id, initials, full_name, name_aliases). A stamp
    decides before a name, a name before an alias, the smallest id of equals. Rows that match no entry but share a stamp or a name with
    each other, directly or through others, are one person: the first row creates the entry, named by its own row id, the others match it
    (``batch``). An entry made from them knows all their names, so the same rows match it the next time.
    """
    spark = rows.sparkSession
    combined = F.trim("stamp").rlike(COMBINED)
    reason = F.when(F.coalesce(F.trim("stamp"), F.lit("")) == "", "no_stamp").when(combined, "combined_stamp")
    keyed = rows.withColumns({"skip_reason": reason, "stamp_key": name_key("stamp"), "name_key": name_key("name")})
    known = ranked_names(register, ["book"])
    known = written(spark, known.groupBy("book", F.least("rank", F.lit(2)).alias("by"), "key").agg(F.min(F.struct("rank", "person_id")).alias("hit")), "known-names")
    # Rows with the same two keys are decided alike, so each pair of keys is decided once, by its smallest row.
    pair = ["book", "stamp_key", "name_key"]
    pairs = written(spark, keyed.where("skip_reason is null").groupBy(*pair).agg(F.min("row_id").alias("least_id")), "name-pairs")
    probes = pairs.select("book", "least_id", F.explode(F.array(F.struct(F.lit(1).alias("by"), F.col("stamp_key").alias("key")), F.struct(F.lit(2).alias("by"), F.col("name_key").alias("key")))).alias("p"))
    hits = probes.select("book", "least_id", "p.by", "p.key").join(known, ["book", "by", "key"]).groupBy("book", "least_id").agg(F.min("hit").alias("hit"))
    found = written(spark, pairs.join(hits, ["book", "least_id"], "left"), "pairs-found")
    same = identities(found.where("hit is null").select("book", "least_id", "stamp_key", "name_key"), ["book"], "least_id", ["stamp_key", "name_key"])
    decided = written(spark, found.join(same, ["book", "least_id"], "left").select(*[F.col(c).alias(f"_{c}") for c in pair], "hit", "identity"), "pairs-decided")
    joined = keyed.join(decided, [F.col("skip_reason").isNull(), F.col("book") == F.col("_book"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in pair[1:]]], "left")
    action = F.when(F.col("skip_reason").isNotNull(), "skip").when(F.col("hit").isNotNull(), "match").when(F.col("identity") == F.col("row_id"), "create").otherwise("match")
    by = F.when(F.col("hit").isNotNull(), F.element_at(F.array(*[F.lit(x) for x in ("stamp", "name", "alias")]), F.col("hit.rank"))).when(F.col("identity") != F.col("row_id"), "batch")
    return joined.select("book", "row_id", "stamp", "name", "wpq_expires", action.alias("action"), by.alias("matched_by"), F.coalesce("hit.person_id", "identity").alias("person_id"), "skip_reason")


def entries_of(plan: DataFrame) -> DataFrame:
    """The register entries that a plan creates: (book, person_id, initials, full_name, name_aliases), with all the names of their rows."""
    own = plan.where("action = 'create'").select("book", "person_id", F.col("stamp").alias("initials"), F.col("name").alias("full_name"))
    names = plan.where("action = 'create' or matched_by = 'batch'").groupBy("book", "person_id").agg(F.collect_set("name").alias("names"))
    return own.join(names, ["book", "person_id"]).select("book", "person_id", "initials", "full_name", F.array_sort(F.array_except("names", F.array("full_name"))).alias("name_aliases"))


def qualifications_of(plan: DataFrame) -> DataFrame:
    """The qualifications a plan records: the sheet gives an expiry and no start, so the start stays unknown and certifies nothing."""
    kept = plan.where("action <> 'skip' and wpq_expires is not null")
    return kept.select("book", "person_id", F.lit(None).cast("date").alias("qualification_date"), F.col("wpq_expires").alias("expiry_date")).distinct()
