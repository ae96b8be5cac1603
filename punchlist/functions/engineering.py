"""Pipe dimensions, hoop stress, and the share of yield strength that a design uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .keys import pipe_key

#: Specified minimum yield strength in psi, by the letters and digits of a grade's spellings.
YIELD_PSI = {"GRB": 35_000, "GRADEB": 35_000, "B": 35_000, "X42": 42_000, "X52": 52_000}

#: Size and schedule, outside and inside diameter and wall in inches, as the field's dimension sheet has them.
DIMENSIONS = [
    ('1/2" - SCH 80. XS', 0.84, 0.546, 0.147), ('1/2" - SCH. 160', 0.84, 0.466, 0.187), ('1/2" - XX-STG.', 0.84, 0.252, 0.294),
    ('3/4" - SCH 80. XS', 1.05, 0.742, 0.154), ('3/4" - SCH. 160', 1.05, 0.614, 0.218), ('3/4" - XX-STG.', 1.05, 0.434, 0.308),
    ('1" - SCH 80. XS', 1.315, 0.957, 0.179), ('1" - SCH. 160', 1.315, 0.815, 0.25), ('1" - XX-STG.', 1.315, 0.599, 0.358),
    ('1-1/2" - SCH 80. XS', 1.9, 1.5, 0.2), ('1-1/2" - SCH. 160', 1.9, 1.338, 0.281), ('1-1/2" - XX-STG.', 1.9, 1.1, 0.4),
    ('2" - SCH. 40, STD', 2.375, 2.067, 0.154), ('2" - SCH 80. XS', 2.375, 1.939, 0.218), ('2" - SCH. 160', 2.375, 1.689, 0.343), ('2" - XX-STG.', 2.375, 1.503, 0.436),
    ('3" - SCH 40,STD', 3.5, 3.068, 0.216), ('3" - SCH 80. XS', 3.5, 2.9, 0.3), ('3" - SCH. 160', 3.5, 2.624, 0.438), ('3" - XX-STG.', 3.5, 2.3, 0.6),
    ('4" - SCH 40,STD', 4.5, 4.026, 0.237), ('4" - SCH 80. XS', 4.5, 3.826, 0.337), ('4" - SCH. 160', 4.5, 3.438, 0.531), ('4" - XX-STG.', 4.5, 3.152, 0.674),
    ('6" - SCH 40,STD', 6.625, 6.065, 0.28), ('6" - SCH 80. XS', 6.625, 5.761, 0.432), ('6" - SCH. 160', 6.625, 5.189, 0.718), ('6" - XX-STG.', 6.625, 4.897, 0.864),
    ('8" - SCH 40,STD', 8.625, 7.981, 0.322), ('8" - SCH. 60', 8.625, 7.813, 0.406), ('8" - SCH 80. XS', 8.625, 7.625, 0.5), ('8" - SCH. 160', 8.625, 6.813, 0.906), ('8" - XX-STG.', 8.625, 6.875, 0.875),
    ('10" - SCH 40,STD', 10.75, 10.02, 0.365), ('10" - SCH 60, XS', 10.75, 9.75, 0.5), ('10" - SCH. 80', 10.75, 9.564, 0.593), ('10" - SCH. 160', 10.75, 8.5, 1.125),
]


def grade_key(grade: Column) -> Column:
    """The letters and digits of a grade, whatever its spelling."""
    return F.regexp_replace(F.upper(grade), "[^A-Z0-9]", "")


def yield_table(spark: SparkSession) -> DataFrame:
    """(grade_key, smys_psi): a handful of rows; unknown grades are not in it."""
    return spark.createDataFrame(list(YIELD_PSI.items()), "grade_key string, smys_psi int")


def dimension_table(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """(nps_key, od_in, wall_in): the fixed values, or those of a book's own sheet; some dozens of rows."""
    rows = [(a, float(od), float(wall)) for a, od, _, wall in rows or DIMENSIONS]
    table = spark.createDataFrame(rows, "size string, od_in double, wall_in double")
    return table.groupBy(pipe_key(F.col("size")).alias("nps_key")).agg(F.first("od_in").alias("od_in"), F.first("wall_in").alias("wall_in"))


def hoop_stress_psi(pressure: Column, od: Column, wall: Column) -> Column:
    """Pressure times diameter over twice the wall; NULL without a wall or a diameter."""
    return F.when((wall > 0) & (od > 0), pressure * od / (2 * wall))


def with_stress(welds: DataFrame, size: str, grade: str, pressure: Column, bands: list[tuple[str, float, float | None, float]] | None = None, dimensions: DataFrame | None = None) -> DataFrame:
    """Welds with diameter, wall, hoop stress, share of yield, the band that the share is in, and why it cannot be said.

    Dimensions and grades are some dozens of rows whose size Spark does not know, so they are broadcast: joined by shuffle, all welds would
    meet in as many tasks as there are sizes of pipe. As a grade comes from a join, it is read once and not anew by every expression below.

    ``bands``: (tier, least, most, fraction to examine), in order, the first that fits counts; without bands there is no tier.
    """
    table = dimensions if dimensions is not None else dimension_table(welds.sparkSession)
    out = welds.withColumn("_key", pipe_key(F.col(size))).join(F.broadcast(table.withColumnRenamed("nps_key", "_key")), "_key", "left").drop("_key")
    grades = yield_table(welds.sparkSession).withColumnRenamed("grade_key", "_key")
    out = out.withColumn("_key", grade_key(F.col(grade))).join(F.broadcast(grades), "_key", "left").drop("_key").withColumn("_p", pressure)
    ready = F.col("od_in").isNotNull() & F.col("smys_psi").isNotNull()
    out = out.withColumn("hoop_stress_psi", F.when(ready, hoop_stress_psi(F.col("_p"), F.col("od_in"), F.col("wall_in")))).withColumn("pct_smys", F.col("hoop_stress_psi") / F.col("smys_psi"))
    tier, fraction = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, least, most, share in reversed(bands or []):
        inside = (F.col("pct_smys") >= least) & (F.lit(True) if most is None else F.col("pct_smys") < most)
        tier, fraction = F.when(inside, name).otherwise(tier), F.when(inside, share).otherwise(fraction)
    out = out.withColumn("tier", tier).withColumn("required_fraction", fraction)
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    reason = (
        F.when(F.col("od_in").isNull(), F.when(given(size), F.format_string('No NPS dimension for "%s"', F.col(size))).otherwise("No pipe size or schedule recorded"))
        .when(F.col("smys_psi").isNull(), F.when(given(grade), F.format_string('Unknown pipe grade "%s"', F.col(grade))).otherwise("No pipe grade recorded"))
        .when(F.col("_p").isNull(), "No design pressure recorded")
        .when(F.col("hoop_stress_psi").isNull(), "Wall thickness is zero or invalid")
    )
    if bands:
        reason = reason.when(F.col("tier").isNull(), F.format_string("No tier rule covers %.2f%% SMYS", F.col("pct_smys") * 100))
    return out.withColumn("uncomputable_reason", reason).drop("_p")


def requires_examination(fraction: Column) -> Column:
    return F.coalesce(fraction, F.lit(0.0)) > 0
