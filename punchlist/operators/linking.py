"""Reports against welds, and calibration certificates against wrenches: which is meant, what speaks for it, what it would change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import same_day
from ..functions.keys import weld_number_key
from ..sources.shared import written
from .evidence import ticket_of

BOOK = "job_book_id"


def method_in(procedure: Column, number: Column) -> Column:
    """The method that a report's procedure or number names as a word."""
    found = F.regexp_extract(F.concat_ws(" ", F.coalesce(procedure, F.lit("")), F.coalesce(number, F.lit(""))), r"(?i)\b(RT|MT|PT|UT)\b", 1)
    return F.nullif(F.upper(found), F.lit(""))


def chosen_welds(lines: DataFrame, welds: DataFrame) -> DataFrame:
    """For each report line the weld it means: job_book_id, report_id, line, printed, weld_id, weld_number, status, n_candidates.

    ``lines``: job_book_id, report_id, line, report_date, welder_stamp, candidates (what may be a weld number, in order). The
    first candidate that the log corroborates, by the welder's stamp or the day of the ticket, is chosen; else the first one stands
    with its own verdict: ambiguous, unmatched, unchecked (nothing to compare) or unconfirmed.

    The numbers of the log are written, so their size is known: lines need not be shuffled to them, of which many may print one number.
    """
    key = [BOOK, "report_id", "line"]
    asked = lines.select(*key, "report_date", F.col("welder_stamp").alias("_stamp"), F.posexplode_outer("candidates").alias("pos", "printed"))
    asked = asked.withColumn("_k", weld_number_key(F.col("printed")))
    ticket = ticket_of(F.col("ndt_ticket_number"), F.col("xray_number"))
    log = welds.select(BOOK, weld_number_key(F.col("weld_number")).alias("_k"), F.struct("id", F.col("weld_number").alias("number"), F.col("welder_stamp").alias("stamp"), ticket.alias("ticket")).alias("w")).where("_k IS NOT NULL")
    per = written(lines.sparkSession, log.groupBy(BOOK, "_k").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("w")), "log-numbers")
    met = asked.join(per, [BOOK, "_k"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    given = lambda c: F.coalesce(c != "", F.lit(False))
    by_stamp, by_day = given(F.col("_stamp")) & given(F.col("w.stamp")), F.col("w.ticket").isNotNull() & F.col("report_date").isNotNull()
    agrees = (by_stamp & (F.upper("_stamp") == F.upper("w.stamp"))) | (by_day & same_day(F.col("w.ticket"), F.col("report_date")))
    status = F.when(F.col("n") == 0, "unmatched").when(F.col("n") > 1, "ambiguous").when(F.coalesce(agrees, F.lit(False)), "confirmed").when(~by_stamp & ~by_day, "unchecked").otherwise("unconfirmed")
    one = F.col("n") == 1
    judged = met.withColumn("status", status)
    entry = F.struct("printed", F.when(one, F.col("w.id")).alias("weld_id"), F.when(one, F.col("w.number")).when(F.col("n") > 1, F.col("_k")).alias("weld_number"), "status", "n")
    best = F.min_by(entry, F.when((F.col("status") == "confirmed") | F.coalesce(F.col("pos") == 0, F.lit(True)), F.struct(F.col("status") != "confirmed", "pos")))
    return judged.groupBy(*reversed(key)).agg(best.alias("b")).select(*key, F.coalesce("b.printed", F.lit("")).alias("printed"), "b.weld_id", "b.weld_number", "b.status", F.col("b.n").alias("n_candidates"))


def plan_counts(chosen: DataFrame, by: list[str]) -> DataFrame:
    """Rows by status; only confirmed ones may be written."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = chosen.groupBy(*by).agg(F.count_distinct("report_id").alias("reports"), F.count(F.lit(1)).alias("rows"), *[n(s) for s in ("confirmed", "unchecked", "unconfirmed", "ambiguous", "unmatched")])
    return out.withColumn("writable", F.col("confirmed"))


def evidenced_not_logged(chosen: DataFrame, welds: DataFrame) -> DataFrame:
    """Welds that a compared line means though the log marks no examination, each once."""
    unmarked = welds.where("ndt_method IS NULL AND coalesce(ndt_ticket_number, '') = '' AND coalesce(xray_number, '') = ''").select(BOOK, F.col("id").alias("weld_id"))
    return chosen.where("weld_id IS NOT NULL AND status <> 'unchecked'").join(unmarked, [BOOK, "weld_id"], "left_semi").select(BOOK, "weld_id", "weld_number").distinct()


# Calibration certificates


def calibration_plan(certificates: DataFrame, wrenches: DataFrame, connections: DataFrame) -> DataFrame:
    """Each certificate of a batch: match, disposition, writable, the wrench's newest date before it, and what the roster says.

    ``certificates``: file, place (order in the batch), wrench_id, date_calibrated, due, final_status. Only what is accepted moves
    a wrench's newest date, so what is not accepted is blank in the running maximum.
    """
    register = wrenches.groupBy("wrench_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.max("last_calibration_date").alias("on_file"), F.min("roster_claimed_calibration_date").alias("claimed"))
    by_id = connections.select(F.col("wrench_id").alias("id")).join(wrenches.select("id", F.col("wrench_id").alias("w")), "id").select("w")
    used = by_id.unionByName(connections.select(F.col("wrench_id_raw").alias("w"))).where("w IS NOT NULL").distinct().select(F.col("w").alias("wrench_id"), F.lit(True).alias("used"))
    c = certificates.join(register, "wrench_id", "left").join(used, "wrench_id", "left")
    match = (
        F.when(F.coalesce(F.col("wrench_id"), F.lit("")) == "", "no_serial").when(F.col("n") > 1, "ambiguous").when(F.col("n") == 1, "matched")
        .when(F.col("used"), "new_wrench").otherwise("unused")
    )
    c = c.withColumn("match", match)
    day, known = F.col("date_calibrated"), F.col("match").isin("matched", "new_wrench")
    sound = known & ~F.col("final_status").eqNullSafe(F.lit("fail")) & day.isNotNull() & F.coalesce(F.col("due") >= day, F.lit(True))
    so_far = Window.partitionBy("wrench_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("prior", F.greatest("on_file", F.max(F.when(sound, day)).over(so_far)))
    disposition = (
        F.when(F.col("match") == "no_serial", "unread").when(day < F.col("prior"), "superseded").when(F.col("final_status") == "fail", "failed").when(day.isNull(), "unread")
        .when(F.col("due") < day, "window_reversed").otherwise("calibration")
    )
    c = c.withColumn("disposition", disposition)
    writable = known & ~F.col("disposition").isin("superseded", "window_reversed")
    differs = F.coalesce(F.col("claimed") != day, F.lit(False)) & (F.col("match") == "matched")
    return c.select(*certificates.columns, "match", "disposition", writable.alias("writable"), "prior", differs.alias("roster_disagrees"), F.when(F.col("match") == "matched", F.col("id")).alias("matched_id"))


def _days_counted(connections: DataFrame, wrenches: DataFrame) -> DataFrame:
    """(_key, wrench_id, matched_id, day, n): connections of each wrench of a plan by day; the rows do not grow with a wrench's certificates.

    By the code as written, and by the wrench's id where that is not the same connection.
    """
    c = connections.groupBy(F.col("wrench_id").alias("c_ref"), F.col("wrench_id_raw").alias("c_raw"), F.col("torque_date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    by_raw = c.join(wrenches, F.col("c_raw") == F.col("wrench_id"))
    by_ref = c.join(wrenches, F.col("c_ref") == F.col("matched_id")).where("c_raw IS NULL OR c_raw <> wrench_id")
    own = ["wrench_id", "matched_id", "day"]
    return by_raw.select(*own, "n").unionByName(by_ref.select(*own, "n")).groupBy(*own).agg(F.sum("n").alias("n"))


def plan_effects(plan: DataFrame, wrenches: DataFrame, connections: DataFrame) -> DataFrame:
    """Per certificate: the connections of its wrench, and how many it would resolve and expose.

    Both are numbers of connections on days between dates of the certificate and of what is on file, so they are differences of counts up to
    a day. Those are worked out once per wrench and day that is asked for, and certificates never meet single connections.
    """
    spark, day = plan.sparkSession, F.col("day")
    w = wrenches.select(F.col("id").alias("matched_id"), F.col("cert_on_file").alias("f"), F.col("last_calibration_date").alias("s"), F.col("calibration_due_date").alias("e"))
    p = written(spark, plan.where("match <> 'no_serial'").select("file", "wrench_id", "matched_id", "writable", "disposition", F.col("date_calibrated").alias("d"), "due"), "plan")
    own = p.select("wrench_id", "matched_id").distinct().join(w, "matched_id", "left").withColumn("judged", F.coalesce("f", F.lit(False)) & F.col("s").isNotNull())
    counted = written(spark, _days_counted(connections, own.select("wrench_id", "matched_id")), "days-counted")
    key = [F.col("wrench_id").alias("k_wrench"), F.coalesce("matched_id", F.lit("")).alias("k_id")]
    # Connections up to a day, for every day that some certificate or the file of its wrench asks for.
    before = lambda c: F.date_sub(c, 1)
    asked = p.select(*key, F.explode(F.array(before(F.col("d")), F.col("due"))).alias("day")).unionByName(own.select(*key, F.explode(F.array(before(F.col("s")), F.col("e"))).alias("day"))).where(day.isNotNull()).distinct()
    steps = asked.withColumn("n", F.lit(0).cast("long")).unionByName(counted.where(day.isNotNull()).select(*key, "day", "n")).groupBy("k_wrench", "k_id", "day").agg(F.sum("n").alias("n"))
    upto = written(spark, steps.select("k_wrench", "k_id", "day", F.sum("n").over(Window.partitionBy("k_wrench", "k_id").orderBy("day")).alias("upto")), "upto")
    at = lambda df, c, name: df.join(upto.select("k_wrench", "k_id", day.alias("_day"), F.col("upto").alias(name)), (F.col("wrench_id") == F.col("k_wrench")) & (F.coalesce("matched_id", F.lit("")) == F.col("k_id")) & (c == F.col("_day")), "left").drop("k_wrench", "k_id", "_day")
    total = counted.groupBy("wrench_id", "matched_id").agg(F.sum("n").alias("connections"), F.sum(F.when(day.isNotNull(), F.col("n")).otherwise(0)).alias("dated"))
    own = own.join(total, own["wrench_id"].eqNullSafe(total["wrench_id"]) & own["matched_id"].eqNullSafe(total["matched_id"])).select(own["*"], "connections", "dated")
    own = at(at(own, before(F.col("s")), "to_s"), F.col("e"), "to_e").withColumn("to_e", F.when(F.col("e").isNull(), F.col("dated")).otherwise(F.col("to_e")))
    own = own.select(F.col("wrench_id").alias("o_wrench"), F.col("matched_id").alias("o_id"), "connections", "dated", "judged", "to_s", "to_e")
    rows = at(at(p, before(F.col("d")), "to_d"), F.col("due"), "to_due")
    rows = rows.join(own, (F.col("wrench_id") == F.col("o_wrench")) & F.col("matched_id").eqNullSafe(F.col("o_id")))
    to_due = F.when(F.col("due").isNull(), F.col("dated")).otherwise(F.col("to_due"))
    dated, to_d, to_s, to_e, zero = F.col("dated"), F.col("to_d"), F.col("to_s"), F.col("to_e"), F.lit(0).cast("long")
    positive, both = lambda n: F.greatest(n, zero), lambda n: F.when(F.col("judged"), n).otherwise(zero)
    # Newly valid: inside the certificate's window, but not inside that on file. Newly early or expired: likewise outside.
    resolved = positive(to_due - to_d) - both(positive(F.least(to_due, to_e) - F.greatest(to_d, to_s)))
    early = to_d - both(F.least(to_d, to_s))
    late = dated - F.greatest(to_due, to_d) - both(dated - F.greatest(to_due, to_d, to_e, to_s))
    changes = F.col("writable") & (F.col("disposition") == "calibration")
    exposed = F.when(changes, early + late).when(F.col("writable") & (F.col("disposition") == "failed"), dated).otherwise(zero)
    return rows.groupBy("file").agg(F.sum("connections").alias("connections"), F.sum(F.when(changes, resolved).otherwise(zero)).alias("resolved"), F.sum(exposed).alias("exposed"))


def calibration_counts(plan: DataFrame, effects: DataFrame) -> DataFrame:
    """The whole batch in one row."""
    both = plan.join(effects, "file", "left")
    w = F.col("writable")
    return both.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(w).alias("writes"), F.count_if(w & (F.col("disposition") == "calibration")).alias("calibrations"), F.count_if(w & (F.col("disposition") == "unread")).alias("unread"), F.count_if(~w).alias("held"),
        F.count_distinct(F.when(w & (F.col("match") == "new_wrench"), F.col("wrench_id"))).alias("created"), F.coalesce(F.sum(F.when(w, F.col("resolved"))), F.lit(0)).alias("resolved"), F.coalesce(F.sum(F.when(w, F.col("exposed"))), F.lit(0)).alias("exposed"),
    )
