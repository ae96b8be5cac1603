"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; of each window of ``w`` consecutive hashes the smallest is chosen, the
rightmost of equal ones; chosen hashes keep their positions. Any common passage of at least ``k + w - 1`` code points shares
a chosen hash. A text shorter than a k-gram has one hash, of the whole text; one with fewer hashes than a window is one
window. A fingerprint is written as ``hash:position`` pairs, comma-joined; likeness of two is the Jaccard similarity of
their sets of hashes (two empty ones: 1).

Defined results: a null text is empty, and its fingerprint too. Documents follow each other by ascending ``doc_id``, then
hash of the text; a null ``doc_id`` comes first; after the last comes the first. Rows that repeat a ``doc_id`` each get a
result. Ids are whole numbers, others are an error; other columns are ignored; an empty table gives no rows. Texts of any length
are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_ids

K, W = 32, 64
#: Hashes are taken in blocks of so many, to bound memory in a long text; positions stay those of the whole text.
BLOCK = 1 << 20
#: Documents of one run of consecutive ids that a task reads in order, and the most runs there are. A run is sorted with spill
#: and read as a stream, one document at a time, so runs may grow: at 100 TB they have about a gigabyte each.
RUN, MAX_RUNS = 500, 100_000


def kgram_hashes(codes: np.ndarray, k: int = K) -> np.ndarray:
    """Mixed polynomial hashes of all k-grams (k a power of two): each step joins two neighbours of half the length."""
    h = codes.astype(np.uint64) + np.uint64(1)
    base, m = np.uint64(0x9E3779B97F4A7C15), 1
    while m < k:
        h = h[:-m] * base + h[m:]
        base, m = base * base, 2 * m
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _window_choice(h: np.ndarray, w: int) -> np.ndarray:
    """Positions chosen: of each window the smallest hash, of equal ones the rightmost."""
    # The low bits hold the position counted down, so the smallest key is the rightmost of equal hashes.
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    keys = (h >> bits << bits) | (np.uint64(len(h)) - np.arange(len(h), dtype=np.uint64))
    m = 1
    while m < min(w, len(h)):
        step = min(m, w - m, len(keys) - 1)
        keys = np.minimum(keys[:-step], keys[step:])
        m += step
    at = np.uint64(len(h)) - (keys & ((np.uint64(1) << bits) - np.uint64(1)))
    return np.unique(at.astype(np.int64))


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the fingerprint. Hashes keep 40 bits, by which they are also compared."""
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    with np.errstate(over="ignore"):
        if len(codes) < k:
            whole = np.concatenate([np.array([len(codes)], np.uint32), codes, np.zeros(k - 1 - len(codes), np.uint32)])
            return kgram_hashes(whole, k) >> np.uint64(24), np.zeros(1, np.int64)
        hashes, places = [], []
        for at in range(0, max(1, len(codes) - k + 1), BLOCK):  # blocks share a window less one hash
            h = kgram_hashes(codes[at : at + BLOCK + w - 1 + k - 1], k) >> np.uint64(24) << np.uint64(24)
            chosen = _window_choice(h, w)
            hashes.append(h[chosen] >> np.uint64(24))
            places.append(chosen + at)
        places, first = np.unique(np.concatenate(places), return_index=True)
        return np.concatenate(hashes)[first], places


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = set(a.tolist()), set(b.tolist())
    return len(a & b) / len(a | b) if a or b else 1.0


def written_form(fp: tuple[np.ndarray, np.ndarray]) -> str:
    return ",".join(f"{h:010x}:{p}" for h, p in zip(fp[0].tolist(), fp[1].tolist()))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(k: int, w: int):
    """For mapInPandas over runs in order: each document with the next; the last row of a run is the head of the next run."""

    def of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            rows = []
            for run, doc_id, text in zip(batch["run"], batch["doc_id"], batch["text"]):
                fp = winnow(text, k, w)
                if last is not None and last[0] == run:
                    _, own_id, own, own_fp = last
                    n = len(own) // 4
                    edited = own[: len(own) - n] + text[:n]
                    edited_fp = winnow(edited, k, w)
                    rows.append((own_id, len(own), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written_form(own_fp), written_form(edited_fp), likeness(own_fp[0], edited_fp[0]), likeness(own_fp[0], fp[0])))
                last = (run, None if pd.isna(doc_id) else int(doc_id), text, fp)
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return of_batches


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W, run: int = RUN, max_runs: int = MAX_RUNS) -> DataFrame:
    """The fingerprint of each document and of its edited text, with likenesses.

    Documents are cut into runs of consecutive ids at quantiles of the ids (rows without an id into runs of like hashes), and
    each run is read in order by one task; a copy of the head of the next run stands at its end. Texts are shuffled once. Only
    the bounds and heads of runs, ``max_runs`` of each kind at most and 40 bytes each, are known to the driver.
    """
    spark = docs.sparkSession
    whole_ids(docs, id_col)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n, with_id = base.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    if n == 0:
        return spark.createDataFrame([], SCHEMA)
    runs = min(max_runs, max(1, with_id // run))
    cuts = base.agg(F.percentile_approx("doc_id", [i / runs for i in range(1, runs)] or [0.5], max(10_000, 4 * runs))).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))
    without_id = min(max_runs, max(1, (n - with_id) // run))

    @F.pandas_udf("int")
    def run_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.fillna(0).astype("int64"), side="right")).astype("int32")

    by_hash = F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * without_id).cast("int")
    by_hash = F.least(F.lit(without_id - 1), F.greatest(F.lit(0), by_hash)) - without_id
    placed = base.withColumn("h", F.xxhash64("text")).withColumn("run", F.when(F.col("doc_id").isNull(), by_hash).otherwise(run_of("doc_id")))
    heads = sorted((r["run"], r["head"]) for r in placed.select("run", F.struct("doc_id", "h").alias("head")).groupBy("run").agg(F.min("head").alias("head")).collect())
    before = [(heads[i - 1][0], *head) for i, (_, head) in enumerate(heads)]
    copies = spark.createDataFrame(before, "run int, head_id long, head_hash long")
    firsts = base.withColumn("h", F.xxhash64("text")).join(F.broadcast(copies), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_hash")))
    firsts = firsts.dropDuplicates(["run"]).select("doc_id", "text", "run", "h", F.lit(True).alias("head"))
    ordered = placed.withColumn("head", F.lit(False)).unionByName(firsts).repartition("run").sortWithinPartitions("run", "head", F.col("doc_id").asc_nulls_first(), "h")
    return ordered.select("run", "doc_id", "text").mapInPandas(_pairs(k, w), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
