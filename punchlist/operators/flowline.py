"""What committing the flowline weld logs of books would create, update and leave open.

A log's sheet is a line, and weld numbers count within their line, so a weld's key has its line in it even where that line is new: the
line's id, known or to be, is settled first, and the welds' ids follow from it. A second import finds what the first created.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import heat_key, record_id
from .identity import ranked_names

PASSES = ["root", "hot", "fill", "cap"]
#: Fixed value: the namespace of names in version-5 ids.
NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def _norm(name: str) -> Column:
    return F.upper(F.trim(name))


def planned_lines(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """(book, code, line_key, line_id, action, welds) of every sheet of the logs. ``lines``: (book, line_id, line_code)."""
    own = rows.groupBy("book", _norm("sheet").alias("line_key")).agg(F.min("sheet").alias("code"), F.count(F.lit(1)).alias("welds"))
    known = lines.groupBy("book", _norm("line_code").alias("line_key")).agg(F.min("line_id").alias("known_id"))
    made = record_id(NAMESPACE, F.lit("weld_line"), F.col("book"), F.col("line_key"))
    out = own.join(known, ["book", "line_key"], "left")
    return out.select("book", "code", "line_key", F.coalesce("known_id", made).alias("line_id"), F.when(F.col("known_id").isNull(), "create").otherwise("match").alias("action"), "welds")


def planned_welds(rows: DataFrame, planned: DataFrame, welds: DataFrame) -> DataFrame:
    """(book, line_id, weld_number, weld_id, action) of every accepted row. ``welds``: (book, line_id, weld_number) there are."""
    keyed = rows.withColumn("line_key", _norm("sheet")).join(planned.select("book", "line_key", "line_id"), ["book", "line_key"])
    there = welds.select("book", "line_id", _norm("weld_number").alias("number_key")).distinct().withColumn("there", F.lit(True))
    out = keyed.withColumn("number_key", _norm("weld_number")).join(there, ["book", "line_id", "number_key"], "left")
    weld_id = record_id(NAMESPACE, F.lit("weld"), F.col("line_id"), F.trim("weld_number"))
    return out.select("book", "line_id", "weld_number", weld_id.alias("weld_id"), F.when(F.col("there"), "update").otherwise("create").alias("action"))


def planned_heats(rows: DataFrame, heats: DataFrame) -> DataFrame:
    """(book, heat_key, heat_number, welds, action) of every heat that the logs name. ``heats``: (book, heat_number) there are."""
    named = rows.select("book", "sheet", "row_no", F.explode("heat_numbers").alias("heat_number")).withColumn("heat_key", heat_key(F.col("heat_number"))).where("heat_key is not null")
    own = named.groupBy("book", "heat_key").agg(F.min("heat_number").alias("heat_number"), F.count_distinct("sheet", "row_no").alias("welds"))
    known = heats.select("book", heat_key(F.col("heat_number")).alias("heat_key")).distinct().withColumn("there", F.lit(True))
    return own.join(known, ["book", "heat_key"], "left").select("book", "heat_key", "heat_number", "welds", F.when(F.col("there"), "match").otherwise("create").alias("action"))


def planned_stamps(rows: DataFrame, welders: DataFrame) -> DataFrame:
    """(book, stamp, welds, welder_id, action): who the passes name, each once per weld, and whom the register knows by initials, name
    or alias, in that order. ``welders``: (book, person_id, initials, full_name, name_aliases)."""
    named = rows.select("book", F.explode(F.array_distinct(F.array_compact(F.array(*[F.nullif(F.trim(p), F.lit("")) for p in PASSES])))).alias("stamp"))
    own = named.groupBy("book", "stamp").agg(F.count(F.lit(1)).alias("welds")).withColumn("key", _norm("stamp"))
    known = ranked_names(welders, ["book"]).groupBy("book", "key").agg(F.min(F.struct("rank", "person_id")).alias("hit"))
    out = own.join(known, ["book", "key"], "left")
    return out.select("book", "stamp", "welds", F.col("hit.person_id").alias("welder_id"), F.when(F.col("hit").isNull(), "unresolved").otherwise("match").alias("action"))


def flowline_findings(rows: DataFrame, stamps: DataFrame) -> DataFrame:
    """(book, rule_id, severity, n): welds that name no welder, welders that the register lacks, welds without a heat. Numbers that were
    not used (``not_used``) owe neither."""
    used = ~F.coalesce(F.col("not_used"), F.lit(False))
    bare = F.coalesce(F.trim("passes"), F.lit("")) == ""
    per = rows.groupBy("book").agg(F.count_if(used & bare).alias("bare"), F.count_if(used & (F.size(F.coalesce("heat_numbers", F.array().cast("array<string>"))) == 0)).alias("cold"))
    open_ = stamps.where("action = 'unresolved'").groupBy("book").agg(F.count(F.lit(1)).alias("unknown"))
    both = per.join(open_, "book", "left")
    entry = lambda id, severity, n: F.struct(F.lit(id).alias("rule_id"), F.lit(severity).alias("severity"), F.coalesce(n, F.lit(0)).cast("long").alias("n"))
    entries = F.array(
        entry("weldlog.weld_without_stamp", "critical", F.col("bare")),
        entry("weldlog.stamp_not_in_register", "critical", F.col("unknown")),
        entry("weldlog.weld_without_heat", "warning", F.col("cold")),
    )
    return both.select("book", F.explode(entries).alias("f")).select("book", "f.*").where("n > 0")
