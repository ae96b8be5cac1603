"""Versions, diffs, ledgers and sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import RANGE, in_ranges


def versions(uploads: DataFrame, name: list[str], digest: str, order: list[str]) -> DataFrame:
    """New bytes under a known name are the next version and supersede the last; bytes that were there before are duplicates.

    A name, or one content of it, may own most uploads: rows are numbered in ranges of ``order``, and each range starts from what the
    ranges before it hold of the name. ``order`` tells the uploads of a name apart; NULL bytes count as one content.
    """
    rows = in_ranges(uploads, [*name, *order])
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*name, digest, RANGE).orderBy(*order)))
    # The first of a content in each range meets those of the other ranges; the rest stay in theirs, as duplicates.
    meets = Window.partitionBy(*name, digest, F.when(F.col("_nth") == 1, -1).otherwise(F.col(RANGE))).orderBy(RANGE)
    rows = rows.withColumn("duplicate", (F.col("_nth") > 1) | (F.row_number().over(meets) > 1))
    kept = Window.partitionBy(*name, RANGE, "duplicate").orderBy(*order)
    rows = rows.withColumn("_at", F.row_number().over(kept)).withColumn("_last", F.lag(digest).over(kept))

    held = rows.where("NOT duplicate").groupBy(*name, RANGE).agg(F.count(F.lit(1)).alias("_n"), F.max_by(F.struct(digest), F.struct(*order)).alias("_d"))
    earlier = Window.partitionBy(*name).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(name)], F.col(RANGE).alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.last("_d", ignorenulls=True).over(earlier).alias("_d"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(name)], F.col(RANGE) == F.col("_of"))
    version = (F.col("_before") + F.col("_at")).cast("int")
    supersedes = F.when(F.col("_at") == 1, F.col(f"_d.{digest}")).otherwise(F.col("_last"))
    new = ~F.col("duplicate")
    return rows.join(held, same, "left").select(*uploads.columns, "duplicate", F.when(new, version).alias("version"), F.when(new, supersedes).alias("supersedes"))


def superseded_in_batch(batch: DataFrame, by: list[str], order: list[str], at: str, accepted: Column) -> DataFrame:
    """Older than the newest accepted before it in the batch; what was not accepted does not move the newest."""
    so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max(F.when(accepted, F.col(at))).over(so_far)
    return batch.withColumn("newest_before", newest).withColumn("superseded", F.coalesce(F.col(at) < newest, F.lit(False)))


def sequence_gaps(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """The numbers that are missing between those present."""
    seen = df.select(*by, number).where(F.col(number).isNotNull()).distinct()
    following = F.lead(number).over(Window.partitionBy(*by).orderBy(number))
    return seen.withColumn("_next", following).where(F.col("_next") > F.col(number) + 1).select(*by, F.explode(F.sequence(F.col(number) + 1, F.col("_next") - 1)).alias("missing"))


def attempts(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("attempt", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def within_budget(df: DataFrame, by: list[str], order: list[str], size: str, most_bytes: int, most_files: int) -> DataFrame:
    """What a run may copy: in order, until the bytes or files before a row reach the limit.

    No more than ``most_files`` rows of a group can be chosen, so rows past that rank within sixteenths of a group are dropped
    before the running sum, and no task holds a whole group.
    """
    salted = Window.partitionBy(*by, F.pmod(F.xxhash64(*order), F.lit(16))).orderBy(*order)
    df = df.withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= most_files).drop("_r")
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before, n = F.coalesce(F.sum(size).over(w), F.lit(0)), F.count(F.lit(1)).over(w)
    return df.withColumn("bytes_before", before).withColumn("files_before", n).where((F.col("bytes_before") < most_bytes) & (F.col("files_before") < most_files))


def first_by_fingerprint(findings: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    keep = [c for c in findings.columns if c not in by]
    return findings.groupBy(*by).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_f")).select(*by, "_f.*")


def merged_ledger(fresh: DataFrame, stored: DataFrame, keys: list[str], state: str) -> DataFrame:
    """unchanged, new or disappeared; only what is still open can disappear."""
    both = fresh.select(*keys, F.lit(True).alias("_f")).join(stored.select(*keys, state, F.lit(True).alias("_s")), keys, "full_outer")
    change = F.when(F.col("_f") & F.col("_s"), "unchanged").when(F.col("_f"), "new").when(F.col(state) == "open", "disappeared")
    return both.select(*keys, change.alias("change")).where(F.col("change").isNotNull())


def diff(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """added, updated (with its changes: field, before, after), unchanged or removed; equality counts two NULLs as equal."""
    o = old.select(*key, F.struct(*columns).alias("_o"))
    n = new.select(*key, F.struct(*columns).alias("_n"))
    both = o.join(n, key, "full_outer")
    text = lambda side, c: F.col(f"{side}.{c}").cast("string")
    changes = F.array_compact(F.array(*[F.when(~F.col(f"_o.{c}").eqNullSafe(F.col(f"_n.{c}")), F.struct(F.lit(c).alias("field"), text("_o", c).alias("before"), text("_n", c).alias("after"))) for c in columns]))
    status = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.size(changes) > 0, "updated").otherwise("unchanged")
    return both.select(*key, status.alias("status"), F.when(status == "updated", changes).alias("changes"))


def change_log(old: DataFrame, new: DataFrame, key: list[str], columns: list[str], deleted: str) -> DataFrame:
    """create, update, soft_delete or hard_delete with both images as JSON; rows that are the same say nothing."""
    o, n = old.select(*key, F.struct(*columns).alias("_o")), new.select(*key, F.struct(*columns).alias("_n"))
    both = o.join(n, key, "full_outer")
    soft = F.col(f"_o.{deleted}").isNull() & F.col(f"_n.{deleted}").isNotNull()
    action = F.when(F.col("_o").isNull(), "create").when(F.col("_n").isNull(), "hard_delete").when(soft, "soft_delete").otherwise("update")
    return both.where(~F.col("_o").eqNullSafe(F.col("_n"))).select(*key, action.alias("action"), F.to_json("_o").alias("before"), F.to_json("_n").alias("after"))


def upsert_plan(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    there = existing.select(*keys, F.lit(True).alias("_e")).distinct()
    return incoming.join(there, keys, "left").select(*[F.col(c) for c in incoming.columns], F.when(F.col("_e"), "update").otherwise("create").alias("plan"))


def archive_plan(files: DataFrame, archived: DataFrame, key: list[str], digest: str, path: str, most_path: int = 400) -> DataFrame:
    """skip what is archived with the same content, supersede what changed, copy what is new; too long a path is refused."""
    a = archived.groupBy(*key).agg(F.max(digest).alias("_a"))
    action = F.when(F.length(path) > most_path, "too_long").when(F.col("_a").isNull(), "copy").when(F.col("_a") == F.col(digest), "skip").otherwise("supersede")
    return files.join(a, key, "left").select(*key, digest, path, action.alias("action"))


def segments(lines: DataFrame, by: list[str], order: list[str], identity: str) -> DataFrame:
    """A new segment starts where the identity is a different one from the last seen; lines without one belong to the segment before."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.last(identity, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.col(identity).isNotNull() & ~F.col(identity).eqNullSafe(before)
    marked = lines.withColumn("_s", starts.cast("int"))
    return marked.withColumn("segment", F.sum("_s").over(w)).withColumn("identity", F.last(identity, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def carried_segments(rows: DataFrame, by: list[str], order: list[str], identities: list[str], name: str = "segment") -> DataFrame:
    """Rows with the number of their segment, from 1 on. A segment takes on each identity that its rows state; a row that states another
    one than its segment has begins the next, which knows only what that row states.

    What a segment knows depends on where it began, so the rows of a key are folded in order; a key's rows are the pages of one file.
    """
    row = F.struct(*order, *[F.col(i).cast("string").alias(i) for i in identities], F.struct(*rows.columns).alias("_row"))
    kept = rows.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    start = F.struct(F.lit(0).cast("long").alias("_count"), *[F.lit(None).cast("string").alias(i) for i in identities], F.array().cast("array<bigint>").alias("_numbers"))

    def step(seen: Column, r: Column) -> Column:
        other = F.coalesce(*[F.when(seen[i] != r[i], F.lit(True)) for i in identities], seen["_count"] == 0)
        n = seen["_count"] + F.when(other, 1).otherwise(0)
        known = [F.when(other, r[i]).otherwise(F.coalesce(seen[i], r[i])).alias(i) for i in identities]
        return F.struct(n.alias("_count"), *known, F.concat(seen["_numbers"], F.array(n)).alias("_numbers"))

    numbers = F.aggregate("_rows", start, step, lambda seen: seen["_numbers"])
    return kept.select(F.explode(F.arrays_zip("_rows", numbers.alias("_n"))).alias("x")).select("x._rows._row.*", F.col("x._n").alias(name))


def clusters(points: DataFrame, by: list[str], x: str, gap: float, tie: list[str]) -> DataFrame:
    """Positions in clusters: a new one wherever the step is larger than ``gap``."""
    w = Window.partitionBy(*by).orderBy(x, *tie)
    step = F.col(x) - F.lag(x).over(w)
    return points.withColumn("_n", F.when(step > gap, 1).otherwise(0)).withColumn("cluster", F.sum("_n").over(w)).drop("_n")


def pitch(points: DataFrame, by: list[str], y: str, grain: float = 0.5, least: float = 1.0, most: float = 100.0) -> DataFrame:
    """The step between positions that occurs most, in steps of ``grain``; the smaller of equals. Steps are taken in ranges of ``y``, and
    between the last position of a range and the first of the next, so a key may have any number of points."""
    rows = in_ranges(points.select(*by, y), [*by, y])
    within = rows.select(*by, (F.col(y) - F.lag(y).over(Window.partitionBy(*by, RANGE).orderBy(y))).alias("_step"))
    ends = rows.groupBy(*by, RANGE).agg(F.min(y).alias("_low"), F.max(y).alias("_high"))
    between = ends.select(*by, (F.col("_low") - F.lag("_high").over(Window.partitionBy(*by).orderBy(RANGE))).alias("_step"))
    steps = within.unionByName(between).select(*by, F.round(F.col("_step") / grain).alias("_b")).where(F.col("_b") > 0)
    n = steps.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    best = n.groupBy(*by).agg(F.max_by("_b", F.struct("_n", -F.col("_b"))).alias("_b"))
    return best.select(*by, F.least(F.lit(most), F.greatest(F.lit(least), F.col("_b") * grain)).alias("pitch"))


def continuations(pages: DataFrame, by: list[str], order: list[str], serial: str) -> DataFrame:
    """A page with the serial of the page before goes on with the same certificate."""
    return pages.withColumn("continues", F.coalesce(F.col(serial) == F.lag(serial).over(Window.partitionBy(*by).orderBy(*order)), F.lit(False)))
