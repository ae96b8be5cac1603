"""Toxicity by cumulative-link ordinal regression.

Severity has grades 0 to 3. P(grade > k) = logistic(x . b - t_k) with one weight vector ``b`` that all thresholds
t_0 < t_1 < t_2 share; a document's severity is the expected grade. Its features are the dampened counts of those words whose
share of toxic and of clean documents in the training sample differs by ``MIN_Z`` standard errors or more.

Labels say toxic or not; toxic documents of the sample get a grade of 1 to 3 by the thirds of their evidence, the dampened
counts of words that speak for toxicity. The model is fitted on at most ``SAMPLE_ROWS`` labelled documents (a bounded sample by hash of the id) whose
crc32 modulo 5 is not 0; the rest are held out. A document is toxic if P(grade > 0) is at least ``threshold``.

Defined results: a null or empty text has no features and gets the score that this means. Without toxic or without clean
labels nothing is toxic and every severity is 0. A null ``doc_id`` is never held out. Rows that repeat a ``doc_id`` each get
a result. Other columns are ignored; an empty table gives no rows. Whole texts are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table
from .features import Codes, Sample, labelled_sample, word_counts

SAMPLE_ROWS, MIN_Z, GRADES, STEPS = 12_000, 4.5, 3, 400


class Ordinal:
    """Codes of the words that count (ordered), their weights, and the thresholds."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.words, self.weights, self.thresholds = words, weights, thresholds

    def above(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, of a document with words ``at``."""
        if not len(self.words):
            return 1 / (1 + np.exp(self.thresholds))
        place = np.minimum(np.searchsorted(self.words, at), len(self.words) - 1)
        hit = self.words[place] == at
        x = (np.log1p(n[hit]) * self.weights[place[hit]]).sum()
        return 1 / (1 + np.exp(np.clip(self.thresholds - x, -50, 50)))


def fit(sample: Sample, shrink: float = 1e-3) -> Ordinal:
    y = sample.y > 0
    toxic, clean = int(y.sum()), int((~y).sum())
    if not toxic or not clean:
        return Ordinal(np.zeros(0, np.int64), np.zeros(0), np.full(GRADES, 50.0))
    words, of = np.unique(sample.at, return_inverse=True)
    a = np.bincount(of, y[sample.row], minlength=len(words))
    b = np.bincount(of, ~y[sample.row], minlength=len(words))
    p = (a + b) / (toxic + clean)
    z = (a / toxic - b / clean) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / toxic + 1 / clean))
    chosen = np.flatnonzero((np.abs(z) >= MIN_Z) & (a + b >= 3))
    if not len(chosen):
        return Ordinal(np.zeros(0, np.int64), np.zeros(0), np.full(GRADES, 50.0))
    slot = np.full(len(words), -1)
    slot[chosen] = np.arange(len(chosen))
    used = slot[of] >= 0
    row, col, x = sample.row[used], slot[of][used], np.log1p(sample.n[used])

    speaks = (z[chosen] > 0)[col]
    evidence = np.bincount(row[speaks], x[speaks], minlength=len(y))
    cuts = np.quantile(evidence[y], [i / GRADES for i in range(1, GRADES)])
    grade = np.where(y, 1 + np.searchsorted(cuts, evidence, side="right"), 0)

    # Adam on the likelihood of the grades; thresholds are a first one and positive steps.
    d = len(chosen)
    theta = np.concatenate([np.zeros(d), [2.0], np.zeros(GRADES - 1)])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        gaps = np.exp(theta[d + 1 :])
        t = theta[d] + np.concatenate([[0], np.cumsum(gaps)])
        s = np.bincount(row, x * theta[col], minlength=len(y))
        above = 1 / (1 + np.exp(np.clip(t[None, :] - s[:, None], -50, 50)))  # P(grade > k)
        bounds = np.concatenate([np.ones((len(y), 1)), above, np.zeros((len(y), 1))], axis=1)
        upper, lower = bounds[np.arange(len(y)), grade], bounds[np.arange(len(y)), grade + 1]
        inverse = 1 / np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) * inverse, lower * (1 - lower) * inverse
        gs = -(du - dl) / len(y)
        gt = np.zeros(GRADES)
        np.add.at(gt, grade[grade > 0] - 1, du[grade > 0] / len(y))
        np.add.at(gt, grade[grade < GRADES], -dl[grade < GRADES] / len(y))
        g = np.concatenate([np.bincount(col, gs[row] * x, minlength=d) + shrink * theta[:d] / len(y), [gt.sum()], np.cumsum(gt[::-1])[::-1][1:] * gaps])
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return Ordinal(words[chosen], theta[:d], theta[d] + np.concatenate([[0], np.cumsum(np.exp(theta[d + 1 :]))]))


def _above(model: Ordinal, codes: Codes, texts: pa.Array) -> np.ndarray:
    above = np.zeros((len(texts), GRADES))
    for first in range(0, len(texts), 256):
        for i, text in enumerate(texts.slice(first, 256).to_pylist()):
            above[first + i] = model.above(*word_counts(text or "", codes))
    return above


def _score(shared):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            above = _above(shared.value, codes, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(axis=1)), pa.array(above[:, 0].copy())], names=["doc_id", "severity", "p_toxic"])

    return of_batches


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", folds: int = 5, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns; nothing is shuffled."""
    sample = labelled_sample(docs, labels, label, lambda i: crc_mod(i, folds) != 0, sample_rows, id_col, text_col)
    model, at = docs.sparkSession.sparkContext.broadcast(fit(sample)), docs.columns.index(text_col)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            yield batch.filter(pa.array(_above(model.value, codes, batch.column(at))[:, 0] < threshold))
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(of_batches, docs.schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", folds: int = 5, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, severity (0 to 3), p_toxic, toxic_pred."""
    sample = labelled_sample(docs, labels, label, lambda i: crc_mod(i, folds) != 0, sample_rows, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(fit(sample))
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(_score(model), f"doc_id {kind}, severity double, p_toxic double")
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), folds) == 0, F.lit(False)).alias("held_out"), "severity", "p_toxic", (F.col("p_toxic") >= threshold).alias("toxic_pred"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
