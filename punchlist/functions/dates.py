"""Dates: windows with open ends, loose parsing, effective expiry, and business-day calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The work weeks a book can declare, and their days, Monday 0 to Sunday 6.
WORK_WEEKS = {"mon_fri": (0, 1, 2, 3, 4), "mon_sat": (0, 1, 2, 3, 4, 5), "all_days": (0, 1, 2, 3, 4, 5, 6)}


def is_before(a: Column, b: Column) -> Column:
    """Strictly before; an unknown date is never before another."""
    return F.coalesce(a < b, F.lit(False))


def is_after(a: Column, b: Column) -> Column:
    return F.coalesce(a > b, F.lit(False))


def is_within(day: Column, start: Column, end: Column) -> Column:
    """Inside a window whose missing ends are open; an unknown day is in no window."""
    return day.isNotNull() & (start.isNull() | (day >= start)) & (end.isNull() | (day <= end))


def effective_expiry(kind: Column, issued: Column, expires: Column, months: int | Column) -> Column:
    """The expiry on the certificate, else, for calibrations only, the issue date and an interval of months."""
    return F.coalesce(expires, F.when(kind == "calibration", F.add_months(issued, months)))


def expiry_is_derived(kind: Column, issued: Column, expires: Column) -> Column:
    return expires.isNull() & issued.isNotNull() & (kind == "calibration")


#: Two-digit years below this are 20xx, others 19xx; and the days that a spreadsheet's number can stand for.
PIVOT_YEAR, SERIALS, SERIAL_ZERO = 70, (1, 80_000), "1899-12-30"


def loose_date(text: Column) -> Column:
    """ISO, month/day/year with ``/ - .``, spreadsheet serials (a time of day is cut off), and month names in either order.

    A date that no calendar has (2/31) is NULL.
    """
    t = F.trim(text)
    at = lambda parts, i: F.get(parts, F.lit(i))

    def checked(year: Column, month: Column, day: Column, form: str) -> Column:
        return F.try_to_date(F.concat_ws(" ", year.cast("string"), month, day), form)

    # Guards look at a text once; its parts are cut without patterns, as every use of one is worked out anew.
    parts = F.translate(t, "/-", "..")
    first, last = F.substring_index(parts, ".", 1), F.substring_index(parts, ".", -1)
    year = last.try_cast("int")
    full = F.when(year < PIVOT_YEAR, year + 2000).when(year < 100, year + 1900).otherwise(year)
    by_number = F.when(t.rlike(r"^\d\d?[/.\-]\d\d?[/.\-]\d{2,4}$"), checked(F.lpad(full.cast("string"), 4, "0"), first, F.substring_index(F.substring_index(parts, ".", 2), ".", -1), "yyyy M d"))

    serial = F.when(t.rlike(r"^\d+(\.\d+)?$"), t.try_cast("double"))
    by_serial = F.when(serial.between(*SERIALS), F.date_add(F.lit(SERIAL_ZERO).cast("date"), F.floor(serial).cast("int")))

    words = F.split(F.trim(F.regexp_replace(t, "[, ]+", " ")), " ")
    is_month, is_day = (lambda w: w.rlike(r"^[A-Za-z]{3,9}\.?$")), (lambda w: w.rlike(r"^\d\d?(st|nd|rd|th)?$"))
    month = F.when(is_month(at(words, 0)) & is_day(at(words, 1)), at(words, 0)).when(is_day(at(words, 0)) & is_month(at(words, 1)), at(words, 1))
    day = F.when(is_day(at(words, 0)), at(words, 0)).otherwise(at(words, 1))
    named = F.when(t.rlike("[A-Za-z]") & (F.size(words) == 3) & at(words, 2).rlike(r"^\d{4}$") & month.isNotNull(), checked(at(words, 2), F.initcap(F.substring(month, 1, 3)), F.regexp_extract(day, r"\d+", 0), "yyyy MMM d"))
    return F.coalesce(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd")), by_number, named, by_serial)


def us_date(text: Column) -> Column:
    """The first month/day/year with slashes in a text; two-digit years are 20xx."""
    rx = r"(\d{1,2})/(\d{1,2})/(\d{2,4})"
    year = F.regexp_extract(text, rx, 3)
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(F.lpad(year, 4, "0"))
    return F.when(text.rlike(rx), F.try_to_date(F.concat_ws(" ", full, F.regexp_extract(text, rx, 1), F.regexp_extract(text, rx, 2)), "yyyy M d"))


def same_day(logged: Column, reported: Column) -> Column:
    """Whether a log's entry (``11/19/25`` or an ISO date) is the day of a report (a date); unknown days are not."""
    t = F.trim(logged)
    day = F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{2,4}$"), us_date(t)).otherwise(F.try_to_date(t, "yyyy-MM-dd"))
    return F.coalesce(day == reported, F.lit(False))


def calendar(spark: SparkSession, first: str, last: str, week: str = "mon_fri") -> DataFrame:
    """One row per day: day, working, and ``index``, the number of working days up to and including it.

    A calendar of a century has 36,525 rows, so its joins may broadcast it.
    """
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    # The index in closed form, so that no window has to hold all days: whole weeks, then the rest of the week.
    start = F.trunc(F.lit(first).cast("date"), "week")
    since = F.datediff("day", start)
    in_week, rest = WORK_WEEKS[week], since % 7
    partial = sum((F.when(rest >= d, 1).otherwise(0) for d in in_week), F.lit(0))
    return days.select("day", F.weekday("day").isin(list(in_week)).alias("working"), (F.floor(since / 7).cast("int") * len(in_week) + partial).alias("index"))


def business_index(day: Column, week: str) -> Column:
    """Working days from Monday 1900-01-01 up to and including ``day``: the calendar's index as plain arithmetic."""
    since = F.datediff(day, F.lit("1900-01-01").cast("date"))
    rest = F.pmod(since, F.lit(7))
    partial = sum((F.when(rest >= d, 1).otherwise(0) for d in WORK_WEEKS[week]), F.lit(0))
    return (F.floor((since - rest) / 7) * len(WORK_WEEKS[week]) + partial).cast("int")


def business_days_between(start: Column, end: Column, week: str) -> Column:
    """Working days after ``start`` up to ``end``; negative the other way round."""
    return business_index(end, week) - business_index(start, week)


def add_business_days(day: Column, n: int, week: str) -> Column:
    """The day ``n`` working days later; with 0, the day itself or the next working one."""
    days = WORK_WEEKS[week]
    target = business_index(day, week) + n
    if n == 0:
        ahead = F.least(*[F.pmod(F.lit(d) - F.weekday(day), F.lit(7)) for d in days], F.lit(7))
        return F.date_add(day, ahead)
    # The k-th working day since the origin: whole weeks, then the place in the week.
    place = F.element_at(F.array(*[F.lit(d) for d in days]), F.pmod(target - 1, F.lit(len(days))) + 1)
    return F.date_add(F.lit("1900-01-01").cast("date"), (F.floor((target - 1) / len(days)) * 7).cast("int") + place)
