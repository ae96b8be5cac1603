"""Quality scores by a factorisation machine.

A document is a sparse vector: hashed words (each by its share of the text, dampened), statistics of its structure, cut
into bands, and its metadata (the query's: the stated number of characters), cut into bands of magnitude, with one for what is not stated. The model adds a bias, a weight for every feature, and an inner product of two low-rank vectors for every pair
of features; the sum over pairs is had in linear time as half of (square of the sum less sum of the squares).

It is fitted on at most ``SAMPLE_ROWS`` labelled documents (a bounded sample by hash of the id), of those whose crc32 modulo
5 is not 0. Only the text and ``metadata`` go into a score; NULL metadata, or none at all, is a value like others.

Defined results: a null or empty text has only the statistics' lowest bands and gets a score. Without labels every score is
0.5. A null ``doc_id`` is never held out. Rows that repeat a ``doc_id`` each get a result, and labels that repeat each count.
Other columns are ignored; an empty table gives no rows. Whole texts are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table
from .features import STATISTICS, Codes, Sample, labelled_sample, stated, structure, word_counts

SAMPLE_ROWS, RANK, EPOCHS, BANDS, SEED = 8_000, 8, 12, 16, 7
#: Small samples are gone through more often, for as many steps at least.
MIN_STEPS = 600
#: Buckets of hashed words.
BUCKETS = 1 << 17
#: Columns of metadata, at most.
MOST_METADATA = 4
FEATURES = BUCKETS + (len(STATISTICS) + MOST_METADATA) * (BANDS + 1)


def _banded(stats: np.ndarray) -> np.ndarray:
    """The features of rows of statistics and metadata: one band for each, the last for what is not stated."""
    band = np.minimum((np.sqrt(np.clip(np.nan_to_num(stats), 0, 1)) * BANDS).astype(np.int64), BANDS - 1)
    return BUCKETS + np.arange(stats.shape[-1]) * (BANDS + 1) + np.where(np.isnan(stats), BANDS, band)


def _weights(counts: np.ndarray, total: float) -> np.ndarray:
    """Words' values: by the root of their share, so that a text's have unit length however long it is."""
    return np.sqrt(counts / max(total, 1.0))


class Machine:
    def __init__(self, rng: np.random.Generator):
        self.bias, self.w, self.v = 0.0, np.zeros(FEATURES, np.float32), rng.normal(0, 0.02, (FEATURES, RANK)).astype(np.float32)

    def raw(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic function, and the sums that gradients need; ``starts`` are those of non-empty rows."""
        xv = self.v[at] * x[:, None]
        total = np.add.reduceat(xv, starts, axis=0)
        squares = np.add.reduceat(xv * xv, starts, axis=0)
        return self.bias + np.add.reduceat(self.w[at] * x, starts) + 0.5 * (total * total - squares).sum(axis=1), total


def _rows(sample: Sample) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rows of a sample as one flat vector: features, values, and where rows start."""
    totals = np.bincount(sample.row, sample.n, minlength=len(sample.y))
    extra = _banded(sample.stats)
    sizes = sample.sizes + extra.shape[1]
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    at, x = np.empty(sizes.sum(), np.int64), np.empty(sizes.sum(), np.float32)
    inner = np.arange(len(sample.at)) - np.repeat(np.concatenate([[0], np.cumsum(sample.sizes)])[:-1], sample.sizes)
    place = starts[sample.row] + inner
    at[place], x[place] = sample.at % BUCKETS, np.sqrt(sample.n / np.maximum(totals[sample.row], 1))
    tail = (starts + sample.sizes)[:, None] + np.arange(extra.shape[1])
    at[tail], x[tail] = extra, 0.5
    return at, x, starts


def fit(sample: Sample, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.08, shrink: float = 1e-5) -> Machine:
    """Logistic loss, AdaGrad over minibatches."""
    rng = np.random.default_rng(SEED)
    model = Machine(rng)
    if not len(sample.y):
        model.v[:] = 0
        return model
    at, x, starts = _rows(sample)
    ends = np.concatenate([starts[1:], [len(at)]])
    share = np.clip(sample.y.mean(), 0.01, 0.99)
    model.bias = float(np.log(share / (1 - share)))
    seen_w, seen_v = np.full(FEATURES, 1e-2, np.float32), np.full((FEATURES, RANK), 1e-2, np.float32)
    for _ in range(max(epochs, -(-MIN_STEPS * batch // len(sample.y)))):
        order = rng.permutation(len(sample.y))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            sizes = ends[rows] - starts[rows]
            begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            flat = np.repeat(starts[rows] - begin, sizes) + np.arange(sizes.sum())
            a, xs, owner = at[flat], x[flat], np.repeat(np.arange(len(rows)), sizes)
            raw, total = model.raw(a, xs, begin)
            error = (1 / (1 + np.exp(-raw)) - sample.y[rows]).astype(np.float32) / len(rows)
            used, where = np.unique(a, return_inverse=True)
            g = error[owner] * xs
            gw = np.bincount(where, g, minlength=len(used)).astype(np.float32) + shrink * model.w[used]
            per = g[:, None] * (total[owner] - model.v[a] * xs[:, None])
            gv = np.stack([np.bincount(where, per[:, k], minlength=len(used)) for k in range(RANK)], axis=1).astype(np.float32) + shrink * model.v[used]
            seen_w[used] += gw * gw
            seen_v[used] += gv * gv
            model.w[used] -= rate * gw / np.sqrt(seen_w[used])
            model.v[used] -= rate * 0.3 * gv / np.sqrt(seen_v[used])
            model.bias -= rate * float(error.sum())
    return model


def _score(shared):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, codes = shared.value, Codes()
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first in range(0, batch.num_rows, 256):
                at, x, sizes = [], [], []
                for text, values in zip(batch.column(1).slice(first, 256).to_pylist(), batch.column(2).slice(first, 256).to_pylist()):
                    a, n = word_counts(text or "", codes)
                    b = _banded(np.concatenate([structure(text or ""), stated(values)]))
                    at += [a % BUCKETS, b]
                    x += [_weights(n, n.sum()), np.full(len(b), 0.5)]
                    sizes.append(len(a) + len(b))
                starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
                raw, _ = model.raw(np.concatenate(at), np.concatenate(x).astype(np.float32), starts)
                out[first : first + 256] = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    return of_batches


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "quality",
    folds: int = 5,
    sample_rows: int = SAMPLE_ROWS,
    threshold: float = 0.3,
    metadata: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, held_out, score, predicted. ``metadata``: at most MOST_METADATA columns of numbers."""
    if len(metadata) > MOST_METADATA:
        raise ValueError(f"{len(metadata)} columns of metadata, {MOST_METADATA} at most")
    sample = labelled_sample(docs, labels, label, lambda i: crc_mod(i, folds) != 0, sample_rows, id_col, text_col, metadata)
    model = docs.sparkSession.sparkContext.broadcast(fit(sample))
    kind = docs.schema[id_col].dataType.simpleString()
    values = F.array(*[F.col(c).cast("double") for c in metadata]).cast("array<double>")
    out = docs.select(id_col, text_col, values).mapInArrow(_score(model), f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), folds) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), metadata=("n_chars",))
