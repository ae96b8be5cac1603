"""Which fields of a record are missing, and what is missing most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import is_within


def blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value.cast("string")) == "")


def missing(spec: list[tuple[str, Column]]) -> Column:
    """The labels whose condition (the field is there) does not hold, in the order of the spec."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(there, F.lit(False)), F.lit(label)) for label, there in spec]))


def examined(method: Column, ticket: Column) -> Column:
    """Examined by any method: a method is recorded, or a ticket number is."""
    return method.isNotNull() | ~blank(ticket)


def single_stamp(welder: Column, stamp: Column, passes: Column) -> Column:
    return welder.isNotNull() | (~blank(stamp) & blank(passes))


def inspected(day: Column, initials: Column) -> Column:
    return day.isNotNull() & ~blank(initials)


def _there(*names: str) -> list[Column]:
    return [F.col(n).isNotNull() & (F.col(n).cast("string") != "") for n in names]


def facility_shape() -> Column:
    """A log that has one stamp for a weld, an area or an isometric is a facility's; others list four passes."""
    return F.coalesce(F.greatest(*[x.cast("int") for x in _there("welder_stamp", "welder_id", "construction_area", "isometric_number")]) > 0, F.lit(False))


def weld_missing() -> Column:
    """What a weld lacks, by the shape of its log; a weld that is not used lacks nothing, and the examination is asked for only
    where one was recorded."""
    facility = facility_shape()
    filled = lambda c: ~blank(F.col(c))
    seen = examined(F.col("ndt_method"), F.col("xray_number"))
    of_facility = [
        ("welder stamp", filled("welder_stamp") | F.col("welder_id").isNotNull()), ("isometric number", filled("isometric_number")), ("pipe size / schedule", filled("pipe_size_schedule")),
        ("pipe grade", filled("pipe_grade")), ("design pressure", F.col("design_pressure_psi").isNotNull()),
    ]
    of_flowline = [
        *[(f"{p} pass welder", F.col(f"{p}_welder_id").isNotNull()) for p in ("root", "hot", "fill", "cap")],
        ("component description", filled("component_description")), ("heat numbers", F.size("heat_numbers") > 0),
    ]
    spec = [
        ("weld date", F.col("weld_date").isNotNull()), *[(label, ~facility | there) for label, there in of_facility], *[(label, facility | there) for label, there in of_flowline],
        ("joint type", F.col("joint_type").isNotNull()), ("CWI initials", filled("cwi_initials")), ("CWI visual result", F.col("cwi_visual_result").isNotNull()),
        ("NDT method", ~seen | F.col("ndt_method").isNotNull()), ("NDT result", ~seen | F.col("ndt_result").isNotNull()),
        ("NDT ticket number", ~seen | ~facility | filled("ndt_ticket_number")), ("linked NDE report", ~seen | facility | F.col("ndt_report_id").isNotNull()),
    ]
    return F.when(F.col("status").eqNullSafe(F.lit("not_used")), F.array().cast("array<string>")).otherwise(missing(spec))


def torque_missing() -> Column:
    """What a connection lacks; the inspection is asked for only where one was begun."""
    selected = F.col("inspection_date").isNotNull() | F.coalesce(F.col("inspector_initials") != "", F.lit(False))
    return missing([
        ("required torque", F.col("required_torque_ft_lb").isNotNull()), ("actual torque", F.col("actual_torque_ft_lb").isNotNull()),
        ("wrench ID", F.col("wrench_id").isNotNull() | F.coalesce(F.col("wrench_id_raw") != "", F.lit(False))), ("torque date", F.col("torque_date").isNotNull()),
        ("employee initials", ~blank(F.col("employee_initials"))),
        ("inspection date", ~selected | F.col("inspection_date").isNotNull()), ("inspector initials", ~selected | ~blank(F.col("inspector_initials"))),
    ])


def heat_missing() -> Column:
    status = lambda s: ~F.col("mtr_status").eqNullSafe(F.lit(s))
    return missing([("MTR document", F.col("mtr_document_id").isNotNull()), ("legible MTR", status("illegible")), ("identified heat number on MTR", status("unidentified"))])


def pressure_missing(tests: DataFrame, certificates: DataFrame) -> DataFrame:
    """Tests with what they lack. The recorder's certificate has to cover the day; here a missing bound of it is open."""
    c = certificates.select(F.col("id").alias("recorder_cert_id"), F.col("issue_date").alias("_s"), F.col("expiry_date").alias("_e"), F.lit(True).alias("_there"))
    day = F.col("test_date")
    valid = F.col("_there").isNull() | day.isNull() | is_within(day, F.col("_s"), F.col("_e"))
    spec = [(label, F.col(c).isNotNull()) for label, c in (("test date", "test_date"), ("test pressure", "test_pressure_psi"), ("duration", "duration_minutes"), ("result", "result"), ("recorder chart", "chart_document_id"), ("recorder calibration certificate", "_there"))]
    joined = tests.join(c, "recorder_cert_id", "left")
    return joined.withColumn("missing", missing([*spec, ("recorder calibration valid on the test date", valid)])).select(*tests.columns, "missing")


def summary(df: DataFrame, book: list[str], fields: str = "missing") -> DataFrame:
    complete = F.size(fields) == 0
    return df.groupBy(*book).agg(F.count(F.lit(1)).alias("n"), F.count_if(complete).alias("n_complete"), F.round(F.avg(complete.cast("int")) * 100, 2).alias("complete_pct"))


def missing_histogram(df: DataFrame, book: list[str], fields: str = "missing") -> DataFrame:
    """How often each field is missing; order by n descending, then field."""
    return df.select(*book, F.explode(fields).alias("field")).groupBy(*book, "field").agg(F.count(F.lit(1)).alias("n"))


def most_missing(histogram: DataFrame, book: list[str], most: int = 4) -> DataFrame:
    """The fields that a book's records lack most often: a report's top few."""
    order = Window.partitionBy(*book).orderBy(F.desc("n"), "field")
    return histogram.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def within_tolerance(actual: Column, point: Column, least: Column, most: Column, percent: Column) -> Column:
    """Inside a range if there is one, else within percent of the point (a point of 0 exactly); NULL if it cannot be said."""
    low, high = F.coalesce(least, point), F.coalesce(most, point)
    return (
        F.when(actual.isNull() | low.isNull() | high.isNull(), F.lit(None).cast("boolean"))
        .when(high > low, actual.between(low, high))
        .when(low == 0, actual == 0)
        .otherwise(F.abs(actual - low) / low * 100 <= percent)
    )
