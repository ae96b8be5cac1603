"""Language identification with segmentation-marginalised unigrams.

Every language has probabilities for the pieces of one fixed public vocabulary (and one for any other single character). A
word's probability is the sum over all its segmentations into pieces, which a forward pass over its positions gives, in
logarithms; a text's is the product over its words. The pieces' probabilities are learned by expectation maximisation: every
round runs forward and backward passes over the words of the training sample as a Spark job, and only expected counts of pieces
(a row for each piece and language) reach the driver. The sample is documented and bounded: ``per_language`` training
documents of each language, in expectation.

Defined results: a null text or one without a letter is ``und`` with score 0. Words are maximal runs of letters, lower-cased,
of any length; other characters say nothing, so pieces that hold any can match no word and are left out. Training uses rows with
text and language outside the held-out part; with none, every text is ``und``. Rows that repeat a ``doc_id`` each get a result;
a null ``doc_id`` is never held out. Ties go to the language first in order. Ids keep their type; other columns are ignored; an
empty table gives no rows. Whole texts are scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table, written

PER_LANGUAGE, ROUNDS = 600, 4
#: Words of more letters are worked on one by one, in blocks of positions; shorter ones side by side.
LONG, BLOCK = 64, 1 << 16
#: Cells (words by positions) that are worked on together, and words that a worker remembers.
CELLS, REMEMBERED = 1 << 18, 400_000
RUNS = re.compile(r"[^\W\d_]+")
START = "\N{LOWER ONE EIGHTH BLOCK}"


def words_of(text: str) -> list[str]:
    """The maximal runs of letters, lower-cased; what the expression admits beside letters (such as superscripts) parts them."""
    found = []
    for run in RUNS.findall(text.lower()):
        found += [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()
    return found


def vocabulary(path: str | None = None) -> list[str]:
    """The lower-cased pieces of letters of the public SentencePiece vocabulary, a word's start marked as there."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    return sorted(p for p in pieces if p == START or (p.removeprefix(START).isalpha()))


MULT = np.uint64(0x9E3779B97F4A7C15)


def _codes(words: list[str]) -> np.ndarray:
    """Words, each after the start mark, as a matrix of code points; 0 fills the rest."""
    width = max(map(len, words)) + 1
    flat = np.frombuffer("".join((START + w).ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(words), width)


def _extend(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    h = (h ^ code.astype(np.uint64)) * MULT
    return h ^ (h >> np.uint64(29))


class Pieces:
    """Looks up pieces and their prefixes by hash; row ``n`` stands for a single character that is no piece."""

    def __init__(self, pieces: list[str]):
        known: dict[int, int] = {}
        with np.errstate(over="ignore"):
            for i, p in enumerate(pieces):
                h = np.zeros(1, np.uint64)
                for c in p:
                    h = _extend(h, np.array([ord(c)], np.uint32))
                    known.setdefault(int(h[0]), -1)
                known[int(h[0])] = i
        self.hashes = np.array(sorted(known), np.uint64)
        self.piece = np.array([known[int(h)] for h in self.hashes], np.int64)
        self.n, self.longest = len(pieces), max(map(len, pieces), default=1)

    def found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes a piece can begin with, and their pieces (-1: none)."""
        if not len(self.hashes):
            return np.zeros(len(h), bool), np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        return hit, np.where(hit, self.piece[at], -1)

    def edges(self, codes: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, words, pieces) for all substrings that are pieces, ordered by begin then end."""
        out, width = [], codes.shape[1]
        with np.errstate(over="ignore"):
            for begin in range(width):
                alive = np.flatnonzero(codes[:, begin])
                h = np.zeros(len(alive), np.uint64)
                for end in range(begin + 1, width + 1):
                    there = codes[alive, end - 1] != 0
                    alive, h = alive[there], h[there]
                    if not len(alive):
                        break
                    h = _extend(h, codes[alive, end - 1])
                    more, piece = self.found(h)
                    hit = piece >= 0
                    if end > begin + 1:
                        if hit.any():
                            out.append((begin, end, alive[hit], piece[hit]))
                    else:
                        out.append((begin, end, alive, np.where(hit, piece, self.n)))
                    alive, h = alive[more], h[more]
        return out

    def edges_of_one(self, codes: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begins, ends, pieces) of one word, for the begins from ``first`` up to ``last``, ordered by begin then end."""
        alive = np.arange(first, last)
        h, parts = np.zeros(len(alive), np.uint64), []
        with np.errstate(over="ignore"):
            for size in range(1, self.longest + 1):
                there = alive + size <= len(codes)
                alive, h = alive[there], h[there]
                if not len(alive):
                    break
                h = _extend(h, codes[alive + size - 1])
                more, piece = self.found(h)
                hit = (piece >= 0) | (size == 1)
                parts.append((alive[hit], alive[hit] + size, np.where(piece >= 0, piece, self.n)[hit]))
                alive, h = alive[more], h[more]
        begins, ends, pieces = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ends, begins))
        return begins[order], ends[order], pieces[order]


def forward(codes: np.ndarray, edges: list, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """alpha [width + 1, words, languages], the words' lengths, and the logarithms of their marginal probabilities."""
    n, width = codes.shape
    alpha = np.full((width + 1, n, logs.shape[1]), -np.inf)
    alpha[0] = 0
    for begin, end, at, piece in edges:
        alpha[end, at] = np.logaddexp(alpha[end, at], alpha[begin, at] + logs[piece])
    lengths = (codes != 0).sum(axis=1)
    return alpha, lengths, alpha[lengths, np.arange(n)]


def forward_one(codes: np.ndarray, index: Pieces, logs: np.ndarray) -> np.ndarray:
    """The logarithms of one long word's marginal probabilities; no more values are kept than the longest piece reaches."""
    size = index.longest + 1
    ring = np.full((size, logs.shape[1]), -np.inf)
    ring[0], last = 0, 0
    for at in range(0, len(codes), BLOCK):
        begins, ends, pieces = index.edges_of_one(codes, at, min(len(codes), at + BLOCK))
        for begin, end, step in zip(begins.tolist(), ends.tolist(), logs[pieces]):
            if begin != last:
                ring[last % size], last = -np.inf, begin
            ring[end % size] = np.logaddexp(ring[end % size], ring[begin % size] + step)
    return ring[len(codes) % size]


def marginals(words: list[str], index: Pieces, logs: np.ndarray) -> np.ndarray:
    """The logarithms [words, languages] of the words' probabilities."""
    out = np.zeros((len(words), logs.shape[1]))
    for place in _chunks(words):
        if len(words[place[0]]) > LONG:
            out[place[0]] = forward_one(_codes([words[place[0]]])[0], index, logs)
        else:
            codes = _codes([words[i] for i in place])
            out[place] = forward(codes, index.edges(codes), logs)[2]
    return out


def _chunks(words: list[str]) -> Iterator[list[int]]:
    """Places of words of like lengths, of no more than ``CELLS`` together; a long word stands alone."""
    place: list[int] = []
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        size = len(words[i])
        if place and (size > LONG or (len(place) + 1) * (size + 1) > CELLS):
            yield place
            place = []
        place.append(i)
    if place:
        yield place


def expected(words: list[str], n: np.ndarray, index: Pieces, logs: np.ndarray) -> np.ndarray:
    """How often each piece is used in ``n`` occurrences of each word, in expectation; ``logs``: [pieces + 1] of one language."""
    out = np.zeros(index.n + 1)
    for place in _chunks(words):
        if len(words[place[0]]) > LONG:
            codes = _codes([words[place[0]]])[0]
            alpha, beta = np.full(len(codes) + 1, -np.inf), np.full(len(codes) + 1, -np.inf)
            alpha[0] = beta[-1] = 0
            blocks = range(0, len(codes), BLOCK)
            for at in blocks:
                begins, ends, pieces = index.edges_of_one(codes, at, min(len(codes), at + BLOCK))
                for begin, end, step in zip(begins.tolist(), ends.tolist(), logs[pieces].tolist()):
                    alpha[end] = np.logaddexp(alpha[end], alpha[begin] + step)
            for at in reversed(blocks):
                begins, ends, pieces = index.edges_of_one(codes, at, min(len(codes), at + BLOCK))
                for begin, end, step in zip(begins[::-1].tolist(), ends[::-1].tolist(), logs[pieces][::-1].tolist()):
                    beta[begin] = np.logaddexp(beta[begin], beta[end] + step)
                np.add.at(out, pieces, n[place[0]] * np.exp(alpha[begins] + logs[pieces] + beta[ends] - alpha[-1]))
            continue
        codes, weight = _codes([words[i] for i in place]), n[place]
        edges = index.edges(codes)
        alpha, lengths, total = forward(codes, edges, logs[:, None])
        alpha, total = alpha[:, :, 0], total[:, 0]
        beta = np.full_like(alpha, -np.inf)
        beta[lengths, np.arange(len(place))] = 0
        for begin, end, at, piece in reversed(edges):
            through = logs[piece] + beta[end, at]
            beta[begin, at] = np.logaddexp(beta[begin, at], through)
            np.add.at(out, piece, weight[at] * np.exp(alpha[begin, at] + through - total[at]))
    return out


def maximised(counts: np.ndarray) -> np.ndarray:
    """Logarithms of the pieces' probabilities from expected counts [pieces + 1, languages], a little added to each."""
    return np.log((counts + 0.05) / (counts.sum(axis=0) + 0.05 * len(counts)))


def _expect(model):
    """For mapInArrow over (lang, word, n): the task's expected counts, as (lang, piece, n)."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs, pieces = model.value
        index, place = Pieces(pieces), {lang: j for j, lang in enumerate(langs)}
        out = np.zeros_like(logs)
        for batch in batches:
            by_lang: dict[str, tuple[list, list]] = {}
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                words, weights = by_lang.setdefault(lang, ([], []))
                words.append(word)
                weights.append(n)
            for lang, (words, weights) in by_lang.items():
                out[:, place[lang]] += expected(words, np.array(weights, float), index, logs[:, place[lang]])
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array((at % len(langs)).astype(np.int32)), pa.array((at // len(langs)).astype(np.int32)), pa.array(out.reshape(-1)[at])], names=["lang", "piece", "n"])

    return of_batches


def learn(counted: DataFrame, langs: list[str], pieces: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """Logarithms of the probabilities [pieces + 1, languages], by expectation maximisation over (lang, word, n)."""
    logs = np.full((len(pieces) + 1, len(langs)), np.log(1e-3))
    for _ in range(rounds):
        model = counted.sparkSession.sparkContext.broadcast((langs, logs, pieces))
        found = counted.mapInArrow(_expect(model), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros_like(logs)
        counts[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
        logs = maximised(counts)
    return logs


def _predict(model):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, probabilities, pieces = model.value
        index = Pieces(pieces) if langs else None
        known: dict[str, int] = {}
        logs = np.zeros((0, len(langs)))
        for batch in batches:
            names, scores = [], []
            for first in range(0, batch.num_rows, 256):
                words = [Counter(words_of(t or "")) for t in batch.column(1).slice(first, 256).to_pylist()]
                if len(known) > REMEMBERED:  # bounds what a worker remembers
                    known, logs = {}, logs[:0]
                fresh = list({w: None for c in words for w in c if w not in known and len(w) <= LONG}) if langs else []
                if fresh:
                    known.update(zip(fresh, range(len(logs), len(logs) + len(fresh))))
                    logs = np.concatenate([logs, marginals(fresh, index, probabilities)])
                for c in words:
                    if not c or not langs:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    short = [w for w in c if len(w) <= LONG]
                    total = np.fromiter((c[w] for w in short), float, len(short)) @ logs[np.fromiter((known[w] for w in short), np.int64, len(short))]
                    if len(short) < len(c):
                        long = [w for w in c if len(w) > LONG]
                        total = total + np.array([c[w] for w in long], float) @ marginals(long, index, probabilities)
                    best = int(np.argmax(total))
                    names.append(langs[best])
                    scores.append(float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return of_batches


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, fold: int, per_language: int, pieces: list[str]) -> tuple[list[str], np.ndarray]:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where((crc_mod(F.col("doc_id"), folds) != fold) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    if not sizes:
        return [], np.zeros((len(pieces) + 1, 0))
    # A hash of id and text decides, so that the same documents are taken again when a task is repeated.
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, per_language / n))])[F.col("lang")]
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < share * 1_000_003)
    counted = sample.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    langs = sorted(sizes)
    return langs, learn(written(counted, "words"), langs, pieces)


def language_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2, per_language: int = PER_LANGUAGE, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    pieces = vocabulary(vocabulary_path)
    langs, probabilities = train(docs, id_col, text_col, lang_col, folds, fold, per_language, pieces)
    model = docs.sparkSession.sparkContext.broadcast((langs, probabilities, pieces))
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(_predict(model), f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), folds) == fold, F.lit(False)).alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_ids(table(spark, sf_dir, "documents"))
