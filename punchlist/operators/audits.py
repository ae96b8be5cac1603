"""Sampling plans, who may audit, and what a book's audits come to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest lot of each code letter, and the letter's sample.
LOTS = [(8, "A", 2), (15, "B", 3), (25, "C", 5), (50, "D", 8), (90, "E", 13), (150, "F", 20), (280, "G", 32), (500, "H", 50), (1200, "J", 80), (3200, "K", 125), (10000, "L", 200), (35000, "M", 315), (150000, "N", 500), (500000, "P", 800), (None, "Q", 1250)]


def sample_plan(lot: Column, doubled: Column) -> Column:
    """(letter, size): how many records of a lot to read; an empty lot has neither, and no sample is larger than its lot."""
    letter, size = F.lit(None).cast("string"), F.lit(0)
    for most, code, n in reversed(LOTS):
        inside = F.lit(True) if most is None else lot <= most
        letter, size = F.when(inside, code).otherwise(letter), F.when(inside, n).otherwise(size)
    return F.struct(F.when(lot > 0, letter).alias("letter"), F.when(lot > 0, F.least(lot, size * F.when(doubled, 2).otherwise(1))).otherwise(0).cast("long").alias("size"))


def lot_sizes(tables: list[DataFrame], book: str = "job_book_id") -> DataFrame:
    """How many records each book has in all tables that an audit samples."""
    counted = reduce(DataFrame.unionByName, [t.groupBy(book).agg(F.count(F.lit(1)).alias("n")) for t in tables])
    return counted.groupBy(book).agg(F.sum("n").alias("lot"))


def may_audit(auditors: DataFrame, custodian: Column, person: Column, competency: Column) -> DataFrame:
    """Why a person may not audit a book as its peer, NULL if they may."""
    why = F.when(custodian == person, "custodian of the book").when(~F.coalesce(competency.isin("JB-3", "JB-4"), F.lit(False)), "competency below JB-3")
    return auditors.withColumn("refused", why)


def audit_summary(audits: DataFrame, findings: DataFrame, book: str = "job_book_id") -> DataFrame:
    """Per book: completed audits of the first two tiers, the latest peer audit with its critical findings, and when the third
    tier verified. Of audits completed at one time the larger id counts."""
    done = audits.where("outcome <> 'in_progress' AND completed_at IS NOT NULL")
    critical = findings.where("classification = 'critical'").groupBy("audit_id").agg(F.count(F.lit(1)).alias("criticals"))
    done = done.join(critical, F.col("id") == F.col("audit_id"), "left")
    tier = lambda t: F.col("tier") == t
    of = lambda t, *c: F.max_by(F.when(tier(t), F.struct(*c)), F.when(tier(t), F.struct("completed_at", "id")))
    peer = of("tier_2_peer", "score", F.coalesce("criticals", F.lit(0)).alias("criticals"), "double_sample")
    out = done.groupBy(book).agg(F.count_if(tier("tier_1_self")).alias("self_audits"), F.count_if(tier("tier_2_peer")).alias("peer_audits"), peer.alias("p"), F.max(F.when(tier("tier_3_manager"), F.col("completed_at"))).alias("verified_at"))
    return out.select(book, "self_audits", "peer_audits", F.col("p.score").alias("peer_score"), F.col("p.criticals").alias("peer_criticals"), F.coalesce("p.double_sample", F.lit(False)).alias("peer_doubled"), "verified_at")
