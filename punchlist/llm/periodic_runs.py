"""Periodic runs of words: stretches that repeat with a smallest period, and texts with the repetitions taken out.

An online sparse diagonal dynamic program. Reading a text word by word, every earlier occurrence of the word that could belong to
a run stands for a lag (a diagonal of the text against itself); the lag's match length goes up by one while each further word
occurs at the same lag, and a diagonal that ends long enough emits its run at once. Only the lags that are active are held.

What keeps it sparse is exact. A run has at least ``max(shortest, repeats * q)`` words for its period q, so on its diagonal at
least ``(repeats - 1) * q`` words match in a row, and at least ``shortest - q``. An occurrence therefore counts only if the last k
words agree as well, where k is a width of 16, 32, 64, ... (``shortest`` and ``repeats`` set the first) for lags of up to k: in a
run, k >= q words in a row come back for the first time after exactly q words, or q would not be its smallest period. So at each
width just the nearest earlier occurrence is looked at, and each word has no more lags than there are widths that still repeat.
Nearest occurrences are found by sorting 64-bit hashes of k words; a stretch is emitted after its words have been compared.

Defined results: words are cut at space and ``[\\x09-\\x0D]`` alone and compared as they are. A null or empty text has no words, no
runs and an empty collapsed text. Of words in several runs, those that any run holds after its first period are dropped.
Rows that repeat an id each get a result, rows without id too; ids keep their type, other columns are ignored, and an empty table
gives no rows. Texts of any length are read whole; memory grows with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_sql, crc_mod, table

SHORTEST, REPEATS = 24, 3
#: Texts that a worker holds at a time, beside the batch that Spark sends.
ROWS = 500
MIXER = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start:long,length:long,period:long>>"


def first_width(shortest: int, repeats: int) -> int:
    """The largest power of two that any run's matches in a row reach, whatever its period."""
    least = min(max(shortest - q, (repeats - 1) * q) for q in range(1, shortest + 1))
    return 1 << (max(1, least).bit_length() - 1)


def _numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal exactly for equal words."""
    last = dict(zip(words, range(len(words))))
    return np.fromiter(map(last.__getitem__, words), np.int64, len(words)).view(np.uint64)


def nearest_lags(numbers: np.ndarray, shortest: int = SHORTEST, repeats: int = REPEATS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, ends, lags): for every width, the words at which its last ``width`` words occurred before, and how far back.

    A width ends the search once no stretch of that many words occurs twice: no longer one does then.
    """
    n = len(numbers)
    with np.errstate(over="ignore"):
        grams = (numbers + np.uint64(1)) * MIXER
        grams ^= grams >> np.uint64(29)
        factor, have, width = MIXER, 1, first_width(shortest, repeats)
        while have < width and have < len(grams):
            grams, factor, have = grams[:-have] * factor + grams[have:], factor * factor, have * 2
        below = 0
        while have == width and have < n:
            # Keys of equal grams stand side by side, by position, so that the one before is the nearest.
            order = np.argsort(grams, kind="stable")
            same = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
            if not len(same):
                return
            at, lag = order[same + 1], order[same + 1] - order[same]
            keep = (lag > below) & (lag <= width) & (repeats * lag <= n)
            order = np.argsort(at[keep])
            yield width, at[keep][order] + width - 1, lag[keep][order]
            below = width
            # A run of a larger period holds twice as many matches in a row.
            if repeats * (below + 1) > n or len(grams) <= have:
                return
            grams, factor, have, width = grams[:-have] * factor + grams[have:], factor * factor, have * 2, width * 2


def runs_of(words: list[bytes], shortest: int = SHORTEST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    if repeats < 3:
        raise ValueError("a stretch of fewer than three periods need not show its period at any width")
    if len(words) < max(shortest, repeats):
        return []
    levels = list(nearest_lags(_numbered(words), shortest, repeats))
    if not any(len(ends) for _, ends, _ in levels):
        return []
    ends = np.concatenate([e for _, e, _ in levels])
    order = np.argsort(ends, kind="stable")
    lags = np.concatenate([x for _, _, x in levels])[order].tolist()
    widths = np.repeat([w for w, _, _ in levels], [len(e) for _, e, _ in levels])[order].tolist()
    found: list[tuple[int, int, int]] = []
    active: dict[int, tuple[int, int]] = {}  # lag -> the last word that matched, words that have matched in a row

    def ended(lag: int, last: int, matched: int) -> None:
        start, length = last + 1 - matched - lag, matched + lag
        if length >= max(shortest, repeats * lag) and words[start + lag : last + 1] == words[start : last + 1 - lag]:
            found.append((start, length, lag))

    previous = -1
    for at, lag, width in zip(ends[order].tolist(), lags, widths):
        if at != previous and active:
            # Diagonals that the word before this one did not go on with have ended.
            for x in [x for x, (last, _) in active.items() if last < at - 1]:
                ended(x, *active.pop(x))
        previous = at
        last, matched = active.get(lag, (-1, 0))
        active[lag] = (at, matched + 1) if matched else (at, width)
    for lag, (last, matched) in active.items():
        ended(lag, last, matched)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, repeats: int = REPEATS) -> DataFrame:
    """``id_col``, runs (by start, then period), collapsed (the kept words joined by one space)."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                runs, texts = [], []
                for text in batch.column(1).cast(pa.binary()):
                    words = (text.as_py() or b"").split()  # bytes are split at the ASCII blanks only
                    found = runs_of(words, shortest, repeats)
                    runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                    texts.append(b" ".join(collapsed(words, found)))
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "runs", "collapsed"])
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(of_batches, f"id {kind}, runs {RUNS}, collapsed string").withColumnRenamed("id", id_col)


def with_repeating_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the tail of about a tenth of the texts made periodic, by crc32 of the id: h = crc32, g = floor(h / 10); where
    h % 10 = 0 and a text has n > 0 words, word i >= a becomes word a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    """
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    g = F.expr(f"crc32(cast(`{id_col}` as string)) div 10")
    rows = docs.select(id_col, text_col, F.when(crc_mod(F.col(id_col), 10) == 0, words).alias("words"))
    n = F.size("words").cast("long")
    rows = rows.withColumn("a", F.when(n > 0, g % n))
    rows = rows.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)).cast("long"))
    tail = F.transform(F.sequence("a", n - 1), lambda i: F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    edited = F.concat_ws(" ", F.slice("words", 1, F.col("a").cast("int")), tail)
    return rows.select(id_col, F.when(F.col("a").isNotNull(), edited).otherwise(F.col(text_col)).alias(text_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeating_tails(table(spark, sf_dir, "documents")))
    steeper = "(l, r) -> case when l.length * r.period > r.length * l.period then -1 when l.length * r.period < r.length * l.period then 1 when l.start <> r.start then cast(sign(l.start - r.start) as int) else cast(sign(l.period - r.period) as int) end"
    best = F.when(F.size("runs") > 0, F.get(F.expr(f"array_sort(runs, {steeper})"), F.lit(0)))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: A lag whose stretch is long enough has 16 words in a row that match, so stretches are looked for by four words together: c such
#: matches in a row are c + 3 words.
ORACLE_SQL = rf"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
h AS (SELECT doc_id, ws, len(ws)::BIGINT AS n, {crc32_sql("doc_id")} AS h FROM t),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) END AS ws FROM p),
g AS (SELECT doc_id, i, ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(n - 3)) AS i FROM d WHERE n >= 24)),
m AS (SELECT doc_id, x.i - y.i AS q, x.i AS i FROM g x JOIN g y USING (doc_id, g) WHERE x.i > y.i),
s AS (SELECT doc_id, q, min(i) - q AS start, count(*) + 3 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m) GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DECIMAL(38, 18) / period DESC, start, period) AS place FROM r),
o AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(n)) AS i FROM d WHERE n > 0),
k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM w ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period, (1000 * b.length // b.period)::BIGINT AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN o USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN b ON b.doc_id = d.doc_id AND b.place = 1
"""
