"""Identities: rows that share a key, directly or through other rows, are the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def name_key(name: str) -> Column:
    """A name for comparison: blanks squeezed, in capitals; NULL for an empty one."""
    return F.nullif(F.upper(F.trim(F.regexp_replace(name, r"\s+", " "))), F.lit(""))


def ranked_names(register: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, person_id, rank, key): all that people of a register go by: 1 initials, 2 full name, 3 aliases.

    ``register``: (scope, person_id, initials, full_name, name_aliases).
    """
    entry = lambda rank, name: F.struct(F.lit(rank).alias("rank"), name.alias("name"))
    aliases = F.transform(F.coalesce("name_aliases", F.array().cast("array<string>")), lambda a: entry(3, a))
    names = F.concat(F.array(entry(1, F.col("initials")), entry(2, F.col("full_name"))), aliases)
    each = register.select(*scope, "person_id", F.explode(names).alias("n"))
    return each.select(*scope, "person_id", "n.rank", name_key("n.name").alias("key")).where("key is not null")


def identities(rows: DataFrame, scope: list[str], id_col: str, keys: list[str]) -> DataFrame:
    """(scope, id, identity): the smallest id that is reachable over equal keys within a scope. A null key joins nothing.

    Every round hands each row the smallest label of its keys' rows, then follows labels of labels, so that chains take a number of
    rounds that grows with the logarithm of their length. Rounds are written tables: no lineage grows, and only whether anything
    changed reaches the driver. Ids are unique in their scope.
    """
    spark = rows.sparkSession
    links = rows.select(*scope, id_col, F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).alias("v")) for i, c in enumerate(keys)])).alias("key")).where("key.v is not null")
    links = written(spark, links, "identity-links")
    labels = written(spark, rows.select(*scope, id_col, F.col(id_col).alias("identity")), "identity-labels")
    while True:  # labels only get smaller, so it ends
        per_key = links.join(labels, [*scope, id_col]).groupBy(*scope, "key").agg(F.min("identity").alias("least"))
        near = links.join(per_key, [*scope, "key"]).groupBy(*scope, id_col).agg(F.min("least").alias("near"))
        lower = labels.join(near, [*scope, id_col], "left").select(*scope, id_col, F.col("identity").alias("was"), F.least("identity", F.coalesce("near", "identity")).alias("identity"))
        lower = written(spark, lower, "identity-labels")
        jump = lower.select(*scope, F.col(id_col).alias("identity"), F.col("identity").alias("further"))
        jumped = written(spark, lower.join(jump, [*scope, "identity"]).select(*scope, id_col, "was", F.least("identity", "further").alias("identity")), "identity-labels")
        labels = jumped.select(*scope, id_col, "identity")
        if jumped.where("identity <> was").isEmpty():
            return labels
