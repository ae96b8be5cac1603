"""Text features that the classifiers share: hashed words and statistics of a text's structure."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\W_]+")
EDGE = re.compile(r"[\x20\x09-\x0D]+")


class Codes(dict):
    """Word -> crc32, kept for words seen before; it starts anew at a quarter of a million words, so its memory has a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 250_000:
            self.clear()
        self[word] = out = crc32(word.encode("utf-8", "surrogatepass"))
        return out


def word_counts(text: str, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the lower-cased words, ordered by code."""
    counts = Counter(map(codes.__getitem__, WORDS.findall(text.lower())))
    at = np.fromiter(counts.keys(), np.int64, len(counts))
    n = np.fromiter(counts.values(), np.float64, len(counts))
    order = np.argsort(at)
    return at[order], n[order]


STATISTICS = ("log_chars", "upper", "digits", "marks", "blanks", "non_ascii", "word_chars", "distinct", "top_word", "log_lines", "short_lines", "same_lines", "one_char")


def structure(text: str) -> np.ndarray:
    """STATISTICS of a whole text, each in 0 to 1; all but the first are shares."""
    n = len(text)
    if not n:
        return np.zeros(len(STATISTICS))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.bincount(np.minimum(codes, 128), minlength=129) / n
    upper, digits, letters = low[65:91].sum(), low[48:58].sum(), low[65:91].sum() + low[97:123].sum()
    blanks = low[32] + low[9:14].sum()
    words = EDGE.split(text.strip("\x20\t\n\v\f\r"))
    counts = Counter(words)
    lines = text.split("\n")
    return np.array([
        min(1.0, np.log1p(n) / 12), upper, digits, max(0.0, 1 - letters - digits - blanks - low[128]), blanks, low[128],
        min(1.0, n / len(words) / 20), len(counts) / len(words), max(counts.values()) / len(words), min(1.0, np.log1p(len(lines)) / 8),
        sum(len(x) < 30 for x in lines) / len(lines), 1 - len(set(lines)) / len(lines), sum(len(w) == 1 for w in words) / len(words),
    ])


def stated(values: list[float | None]) -> np.ndarray:
    """Metadata in 0 to 1 by their magnitude; NaN where nothing is stated."""
    given = np.array([np.nan if v is None else v for v in values], float)
    return np.minimum(1.0, np.log1p(np.maximum(given, 0)) / 12)


SAMPLE = "id_hash long, y int, text_hash long, at array<long>, n array<float>, stats array<float>"


def featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (hash of the id, label, hash of the text, text, and metadata if any): the features of a training row."""
    codes = Codes()
    for batch in batches:
        at, n, stats = [], [], []
        metadata = batch.column(4).to_pylist() if batch.num_columns > 4 else [[]] * batch.num_rows
        for text, values in zip(batch.column(3).to_pylist(), metadata):
            a, b = word_counts(text or "", codes)
            at.append(a)
            n.append(b.astype(np.float32))
            stats.append(np.concatenate([structure(text or ""), stated(values)]).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1).cast(pa.int32()), batch.column(2), pa.array(at, pa.list_(pa.int64())), pa.array(n, pa.list_(pa.float32())), pa.array(stats, pa.list_(pa.float32()))],
            names=["id_hash", "y", "text_hash", "at", "n", "stats"],
        )


class Sample:
    """A bounded labelled sample in the driver's memory: rows of (code, count) pairs, statistics (and metadata behind them) and labels."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        lists = rows["at"].combine_chunks() if rows.num_rows else None
        self.y = rows["y"].to_numpy()
        self.sizes = np.diff(lists.offsets.to_numpy()) if rows.num_rows else np.zeros(0, np.int64)
        self.at = rows["at"].combine_chunks().flatten().to_numpy().astype(np.int64) if rows.num_rows else np.zeros(0, np.int64)
        self.n = rows["n"].combine_chunks().flatten().to_numpy().astype(np.float64) if rows.num_rows else np.zeros(0)
        self.stats = rows["stats"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1).astype(np.float64) if rows.num_rows else np.zeros((0, len(STATISTICS)))
        self.row = np.repeat(np.arange(len(self.y)), self.sizes)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed, most: int, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ()) -> Sample:
    """At most ``most`` labelled documents, taken by a hash of their ids among the labels that ``allowed`` admits.

    Labels are few columns of few bytes, of which only ``most`` rows are kept and broadcast; texts are not shuffled. An id that
    many rows repeat does not make the sample larger: it is limited again after the join.
    """
    usable = labels.select(F.col(id_col).alias("l_id"), F.col(label).cast("int").alias("y")).where(F.col("l_id").isNotNull() & F.col("y").isNotNull() & allowed(F.col("l_id")))
    taken = usable.orderBy(F.xxhash64("l_id"), "l_id", "y").limit(most)
    meta = [F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(metadata)]
    rows = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("text"), *meta).join(F.broadcast(taken), F.col("d_id") == F.col("l_id"))
    names = [f"m{i}" for i in range(len(meta))]
    values = [F.array(*names).alias("metadata")] if names else []
    featured = rows.select(F.xxhash64("l_id"), "y", F.xxhash64("text", *names), "text", *values).mapInArrow(featurised, SAMPLE)
    if rows.count() > most:  # reads ids alone; without repeated ids there is nothing to leave out, so nothing has to be sorted
        featured = featured.orderBy("id_hash", "y", "text_hash").limit(most)
    return Sample(featured.toArrow().sort_by([(c, "ascending") for c in ("id_hash", "y", "text_hash")]))
