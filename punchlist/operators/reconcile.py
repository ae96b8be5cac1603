"""Do two or more registers agree? Membership of keys in each, in one aggregation; matches with multiplicity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import percent


def membership(sets: dict[str, tuple[DataFrame, Column]], book: list[str] | None = None) -> DataFrame:
    """One row per key found in any set: ``in_<name>`` and ``n_<name>`` for each. Null keys are in no set.

    A union and one aggregation in place of a chain of full outer joins: one shuffle, with partial aggregation.
    """
    book = book or []
    tagged = [df.select(*book, key.alias("key"), F.lit(name).alias("set")).where(F.col("key").isNotNull()) for name, (df, key) in sets.items()]
    counts = [F.count_if(F.col("set") == name).alias(f"n_{name}") for name in sets]
    found = reduce(DataFrame.unionByName, tagged).groupBy(*book, "key").agg(*counts)
    return found.select("*", *[(F.col(f"n_{name}") > 0).alias(f"in_{name}") for name in sets])


def coverage(members: DataFrame, needed: str, evidence: str, book: list[str] | None = None, empty: float = 100.0) -> DataFrame:
    """Both gaps and the share of needed keys that have evidence."""
    n, e = F.col(f"in_{needed}"), F.col(f"in_{evidence}")
    agg = members.groupBy(*(book or [])).agg(F.count_if(n).alias("needed"), F.count_if(n & e).alias("covered"), F.count_if(n & ~e).alias("missing"), F.count_if(~n & e).alias("extraneous"))
    return agg.withColumn("covered_pct", F.round(percent(F.col("covered"), F.col("needed"), empty), 2))


def multiplicity(probes: DataFrame, probe_key: Column, targets: DataFrame, target_key: Column, probe_id: str, target_id: str) -> DataFrame:
    """unique, ambiguous or unknown for each probe, the number of candidates, and the candidate of a unique match."""
    p = probes.select(probe_id, probe_key.alias("_k"))
    per_key = targets.select(target_key.alias("_k"), F.col(target_id).alias("_t")).where(F.col("_k").isNotNull()).groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.min("_t").alias("first"))
    n = F.coalesce("n", F.lit(0))
    return p.join(per_key, "_k", "left").select(
        probe_id, F.when(n == 0, "unknown").when(n == 1, "unique").otherwise("ambiguous").alias("verdict"), n.alias("n_candidates"), F.when(n == 1, F.col("first")).alias("match")
    )


def resolve(probes: DataFrame, probe_id: str, probe: Column, register: DataFrame, register_id: str, keys: list[Column], ambiguous_is_null: bool = False) -> DataFrame:
    """The register's entry that a name means, by keys in strict precedence; the smallest id of equals, or none if ambiguous.

    A name is answered once in the register, before probes meet it, so a probe never makes more than one row.
    """
    ranked = register.select(F.col(register_id).alias("_id"), F.posexplode(F.array(*keys)).alias("_rank", "_k")).where(F.col("_k").isNotNull() & (F.col("_k") != ""))
    per_rank = ranked.groupBy("_k", "_rank").agg(F.min("_id").alias("_id"), F.max("_id").alias("_last"))
    best = per_rank.groupBy("_k").agg(F.min(F.struct("_rank", "_id", "_last")).alias("best"))
    if ambiguous_is_null:
        best = best.where(F.col("best._id") == F.col("best._last"))
    return probes.select(probe_id, probe.alias("_k")).join(best, "_k", "left").select(probe_id, F.col("best._id").alias("resolved"), F.col("best._rank").alias("rank"))


def band(value: Column, bands: list[tuple[float, float | None, str]]) -> Column:
    """The label of the first band with least <= value < most; a missing most is open."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for least, most, label in bands:
        inside = value >= least if most is None else (value >= least) & (value < most)
        chain = chain.when(inside, label)
    return chain


def typo_suggestions(unknown: DataFrame, u: str, known: DataFrame, k: str, order: str) -> DataFrame:
    """For each unknown code the first known one of its length that differs in one place, else the first with the same characters.

    Candidates meet on a key: the code with one place masked, or its sorted characters; never all against all.
    """

    def keyed(df: DataFrame, c: str, *more: str) -> DataFrame:
        chars = F.split(F.col(c), "")
        masked = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.lit("1:"), F.substring(F.col(c), F.lit(1), i - 1), F.lit("\0"), F.substring(F.col(c), i + 1, F.length(c))))
        return df.where(F.length(c) > 0).select(c, *more, F.explode(F.array_append(masked, F.concat(F.lit("2:"), F.array_join(F.array_sort(chars), "")))).alias("_key"))

    # A known code counts once, with its first place in the order: registers repeat codes.
    each = known.groupBy(F.col(k).alias("_known")).agg(F.min(order).alias(order))
    pairs = keyed(unknown.select(u).distinct(), u).join(keyed(each, "_known", order), "_key").where(F.col(u) != F.col("_known"))
    best = pairs.groupBy(u).agg(F.min(F.struct(F.substring("_key", 1, 1), F.col(order), F.col("_known").alias("suggestion"))).alias("b"))
    return unknown.select(u).distinct().join(best, u, "left").select(u, F.col("b.suggestion").alias("suggestion"))
