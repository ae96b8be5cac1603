"""Was a certificate valid on the day of the work? Interval joins on an equality key with tri-state answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import is_within


def covered_days(days: DataFrame, windows: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """(keys, at, live): whether some window of the keys has begun by that day and not ended before it; one without a start covers nothing.

    Days and windows never meet in pairs: both lie in one order per key, and the latest end so far says whether a day is covered. Windows
    of one start are one row, so a key holds no more rows than the calendar has days. ``days`` has each (keys, at) once.
    """
    begun = windows.where(F.col(start).isNotNull()).groupBy(*keys, F.col(start).alias(at)).agg(F.max(end).alias("_until"), F.bool_or(F.col(end).isNull()).alias("_open"))
    asked = days.select(*keys, at, F.lit(None).cast(begun.schema["_until"].dataType).alias("_until"), F.lit(False).alias("_open"), F.lit(True).alias("_asked"))
    so_far = Window.partitionBy(*keys).orderBy(at)
    live = F.max("_open").over(so_far) | F.coalesce(F.max("_until").over(so_far) >= F.col(at), F.lit(False))
    both = asked.unionByName(begun.withColumn("_asked", F.lit(False)))
    return both.select(*keys, at, "_asked", live.alias("live")).where("_asked").select(*keys, at, "live")


def qualification_verdicts(events: DataFrame, windows: DataFrame, keys: list[str], event_id: str, at: str, start: str, end: str) -> DataFrame:
    """One row per event: qualified, expired, not_yet, unverifiable or no_record.

    A window without a start certifies nothing, unless its end has passed. ``expired`` needs every record to have expired; an
    unknown start comes before ``not_yet``; what is mixed counts as expired. All but ``qualified`` follows from the extremes of a
    subject's windows, one row per subject; that one from ``covered_days``.
    """
    w = windows.select(*keys, F.col(start).alias("_start"), F.col(end).alias("_end")).dropna(subset=keys)
    day = F.col(at)
    per_key = w.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("_start").isNull()).alias("open_start"), F.bool_or(F.col("_end").isNull()).alias("open_end"), F.max("_end").alias("last_end"), F.max("_start").alias("last_start")
    )
    asked = events.select(event_id, *keys, at).distinct()
    live = covered_days(asked.dropna(subset=[*keys, at]).select(*keys, at).distinct(), w, keys, at, "_start", "_end").where("live")
    verdict = (
        F.when(F.col("n").isNull(), "no_record")
        .when(F.col("live"), "qualified")
        .when(~F.col("open_end") & (F.col("last_end") < day), "expired")
        .when(F.col("open_start"), "unverifiable")
        .when(F.col("last_start") > day, "not_yet")
        .otherwise("expired")
    )
    return asked.join(per_key, keys, "left").join(live, [*keys, at], "left").select(event_id, *keys, at, verdict.alias("verdict"))


def valid_on(events: DataFrame, windows: DataFrame, keys: list[str], event_id: str, at: str, start: str, end: str, strict: bool = True, extra: Column | None = None) -> DataFrame:
    """event, valid, and the window chosen: the latest start, then the latest end. ``strict``: no start certifies nothing."""
    w = windows.select(*keys, F.col(start).alias("_start"), F.col(end).alias("_end"), *[c for c in windows.columns if c not in (*keys, start, end)])
    ok = is_within(F.col(at), F.col("_start"), F.col("_end"))
    if strict:
        ok = ok & F.col("_start").isNotNull()
    if extra is not None:
        ok = ok & extra
    joined = events.select(event_id, *keys, at).join(w, keys, "left")
    chosen = F.max(F.when(ok, F.struct(F.col("_start").alias("start"), F.col("_end").alias("end")))).alias("chosen")
    return joined.groupBy(event_id).agg(F.coalesce(F.bool_or(ok), F.lit(False)).alias("valid"), chosen).select(event_id, "valid", F.col("chosen.start").alias("valid_from"), F.col("chosen.end").alias("valid_to"))


def method_coverage(events: DataFrame, certs: DataFrame, keys: list[str], event_id: str, at: str, method: str, start: str, end: str, methods: str) -> DataFrame:
    """covered, methods_unrecorded, method_not_covered or no_cert, and the methods that valid certificates name.

    Which methods are live is worked out per subject and day, by ``covered_days`` of each method that the subject's certificates name.
    """
    tag = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    none = F.lit(None).cast("string")
    tags = F.concat(F.array(tag("any", none)), F.when(F.col(methods).isNull(), F.array(tag("unrecorded", none))).otherwise(F.transform(methods, lambda m: tag("named", m))))
    c = certs.dropna(subset=keys).select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.explode(tags).alias("_m"))
    asked = events.select(event_id, *keys, at, method)
    days = asked.dropna(subset=[*keys, at]).select(*keys, at).distinct().join(c.select(*keys, "_m").distinct(), keys)
    live = covered_days(days, c, [*keys, "_m"], at, "_s", "_e").where("live")
    named = F.col("_m.kind") == "named"
    per_day = live.groupBy(*keys, at).agg(F.bool_or(F.col("_m.kind") == "unrecorded").alias("unrecorded"), F.collect_set(F.when(named, F.col("_m.name"))).alias("names"), F.bool_or(named & F.col("_m.name").isNull()).alias("blank"))
    names = F.array_sort("names")
    per_day = per_day.select(*keys, at, "unrecorded", F.when(F.col("blank"), F.concat(names, F.array(none))).otherwise(names).alias("names"))
    met = asked.join(per_day, [*keys, at], "left")
    per = met.groupBy(event_id).agg(
        F.bool_or(F.coalesce(F.array_contains("names", F.col(method)), F.lit(False))).alias("covered"),
        F.bool_or(F.coalesce("unrecorded", F.lit(False))).alias("unrecorded"),
        F.bool_or(F.col("names").isNotNull()).alias("any"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("covers"),
    )
    verdict = F.when(F.col("covered"), "covered").when(F.col("unrecorded"), "methods_unrecorded").when(F.col("any"), "method_not_covered").otherwise("no_cert")
    return per.select(event_id, verdict.alias("verdict"), "covers")


def calibration_verdicts(events: DataFrame, tools: DataFrame, event_id: str, tool_ref: str, raw_code: str, at: str, tool_id: str, code: str, start: str, end: str, on_file: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The tool by id, else by the code as written; then one of eight verdicts on its calibration at the day of use.

    ``code`` may repeat; the smallest id answers for it.
    """
    cols = [F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(on_file).alias("_f")]
    by_id = tools.select(F.col(tool_id).alias(tool_ref), F.struct(*cols).alias("by_id"))
    by_code = tools.groupBy(F.col(code).alias(raw_code)).agg(F.min_by(F.struct(*cols), F.col(tool_id)).alias("by_code"))
    joined = events.join(by_id, tool_ref, "left").join(by_code, raw_code, "left").withColumn("_t", F.coalesce("by_id", "by_code"))
    day = F.col(at)
    verdict = (
        F.when(F.col(tool_ref).isNull() & F.col(raw_code).isNull(), "no_wrench_recorded")
        .when(F.col("_t").isNull(), "unknown_wrench")
        .when(~F.coalesce(F.col("_t._f"), F.lit(False)), "no_certificate")
        .when(F.col("_t._s").isNull(), "certificate_unread")
        .when(day.isNull(), "no_torque_date")
        .when(day < F.col("_t._s"), "not_yet_issued")
        .when(day > F.col("_t._e"), "expired")
        .otherwise("valid")
    )
    return joined.select(event_id, *keep, verdict.alias("verdict"), F.col("_t._s").alias("calibrated"), F.col("_t._e").alias("due"))


def covered_throughout(validity: DataFrame, per: list[str], valid: str = "valid") -> DataFrame:
    """Whether every event of a subject was covered."""
    return validity.groupBy(*per).agg(F.bool_and(valid).alias("covered_throughout"), F.count_if(~F.col(valid)).alias("n_exposed"))


def certificate_status(expires: Column, as_of: Column, warning_days: int | Column) -> Column:
    """valid, expiring_soon or expired; no expiry is valid. A missing certificate is the caller's left join."""
    left = F.datediff(expires, as_of)
    return F.when(expires.isNull(), "valid").when(left < 0, "expired").when(left <= warning_days, "expiring_soon").otherwise("valid")


def expiry_calendar(certs: DataFrame, expires: str, as_of: Column, within_days: int) -> DataFrame:
    """Certificates that lapse within the horizon, soonest first by ``days_left``."""
    left = F.datediff(F.col(expires), as_of)
    return certs.where(left.between(0, within_days)).withColumn("days_left", left)


def continuity(events: DataFrame, subject: list[str], at: str, as_of: Column, window_days: int = 183) -> DataFrame:
    """The last day of work of each subject, the days since, and when its continuity lapses."""
    last = events.groupBy(*subject).agg(F.max(at).alias("last_day"))
    lapses = F.date_add("last_day", window_days)
    return last.select(*subject, "last_day", F.datediff(as_of, F.col("last_day")).alias("days_since"), lapses.alias("lapses_on"), F.coalesce(as_of > lapses, F.lit(False)).alias("lapsed"))
