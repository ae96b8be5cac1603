"""Language-model scores by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts of up to ``order`` bytes with the counts of what followed them in the training documents:
a byte or the end of the text, 257 symbols in all. The trie is stored as the counts of its paths (a context and the symbol
after it), a Spark table that grows with the corpus; every level's probabilities are joined from the level below, where a key
has 256 rows at most. The most frequent paths, up to ``MAX_PATHS``, are broadcast; the others, each with hardly more than one
in ``MAX_PATHS`` of all positions, join by shuffle, position by position.

A symbol is predicted from the longest context that was seen; where that never saw the symbol, the model escapes to the next
shorter one, in which the symbols of the longer context no longer count (symbol exclusion): they leave its observations and
its kinds of symbols before its own escape is estimated. Escape estimation is method C: n observations of d kinds of symbols
give an escape d / (n + d), and none where no symbol is left to escape to. Below the empty context the symbols left are
equally likely. So the probabilities of all texts sum to one.

Beside it stands a unigram baseline over words, whose counts cover all training documents. Words that own more than a
``max_heavy``-th of all tokens, of which there can be no more than ``max_heavy``, are broadcast; the rest join by shuffle.
Words are told apart by 128 bits of hashes, so that a long one costs no more than a short one.

Defined results: a null text is empty: one token, the end, and the score of the end alone. Rows that repeat a ``doc_id`` each
train the model and get a result; rows that repeat id and text are one in the result. A null ``doc_id`` is in the training
part. With no training rows all counts are 0. Ids keep their type; other columns are ignored; an empty table gives no rows.
Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, crc_mod, table, written

#: Words that are broadcast, at most (24 bytes each).
MAX_HEAVY = 200_000
#: Bytes of the longest contexts; a path has a symbol more and has to fit 63 bits.
ORDER = 5
#: Paths that are broadcast, at most (12 bytes each).
MAX_PATHS = 1_000_000
SLOTS = 22
#: The symbols: 256 bytes and the end of a text. A path's last symbol takes 9 bits, its context 8 for each byte.
SYMBOLS, STOP, BITS = 257, 256, 9
#: Stands for the end of a text among its tokens; no word, as it holds a blank.
END = " "


def _long_paths(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of the texts, their ends included: itself after the ``order`` bytes before it (zeros before a text), as
    one number; and the number of symbols of each text."""
    texts = [s.encode() for s in column.to_pylist()]
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    data = np.frombuffer(b"".join(b"\0" * order + x + b"\0" for x in texts), np.uint8).astype(np.int64)
    ends = np.cumsum(sizes + order)
    if not len(data):
        return np.zeros(0, np.int64), sizes
    context = np.zeros(len(data) - order, np.int64)
    for i in range(order):
        context = (context << 8) | data[i : i + len(context)]
    data[ends - 1] = STOP
    # Symbol i of a text stands ``order`` places after the start of its context.
    own = np.repeat(ends - sizes, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return (context[own - order] << BITS) | data[own], sizes


def _merged(parts: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """Rows of (path, counts...) with the counts of a path summed."""
    columns = [np.concatenate(c) for c in zip(*parts)]
    order = np.argsort(columns[0], kind="stable")
    paths = columns[0][order]
    first = np.flatnonzero(np.diff(paths, prepend=-1))
    return [paths[first], *[np.add.reduceat(c[order], first) if len(first) else c for c in columns[1:]]]


def count_long_paths(order: int, most: int = 1 << 20):
    """For mapInArrow over (text, held_out): the task's paths, with their counts in training texts and in all; combined in the
    task, and given out whenever there are too many to hold."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [(np.zeros(0, np.int64),) * 3], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], names=["path", "n", "m"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                paths, lengths = _long_paths(batch.column(0).slice(at, 512), order)
                held = np.repeat(batch.column(1).slice(at, 512).to_numpy(zero_copy_only=False), lengths)
                for train in (True, False):
                    own, m = np.unique(paths[held != train], return_counts=True)
                    parts.append((own, m * train, m))
                    size += len(own)
                if size > 2 * most:
                    parts = [tuple(_merged(parts))]
                    size = len(parts[0][0])
                    if size > most:
                        yield out()
                        parts, size = [(np.zeros(0, np.int64),) * 3], 0
        parts = [tuple(_merged(parts))]
        yield out()

    return of_batches


def path_probabilities(paths: DataFrame, order: int) -> DataFrame:
    """(path, log): of the paths (path, n) of ``order`` bytes and a symbol, n the count in training, log10 of the symbol's
    probability by method C with exclusion.

    What a context saw, the shorter one saw too. So the symbols that are excluded one level down are those of the context
    itself, and two values of the level below are enough: the probability from there on (``p``), and the share of a symbol
    among what is left there (``q``). A context has 257 paths at most, and a path is the suffix of 256 longer ones at most, so
    no key of a level owns more rows.
    """
    mask = lambda k: F.lit((1 << 8 * k + BITS) - 1).cast("long")
    levels = [paths.select("path", "n")]
    for k in range(order - 1, -1, -1):
        levels.insert(0, written(levels[0].groupBy(F.col("path").bitwiseAND(mask(k)).alias("path")).agg(F.sum("n").alias("n")), "paths"))
    lower, seen = None, F.col("n") > 0
    context = Window.partitionBy(F.shiftright("path", BITS))
    counted = [F.sum("n").over(context).alias("total"), F.count_if(seen).over(context).alias("kinds")]
    for k, own in enumerate(levels):
        if lower is None:
            own = own.select("*", *counted).select("*", F.try_divide(F.lit(1), SYMBOLS - F.col("kinds")).alias("q"), F.lit(1 / SYMBOLS).alias("p1"))
        else:
            own = own.withColumn("low", F.col("path").bitwiseAND(mask(k - 1))).join(lower, "low")
            own = own.select("*", *counted, F.sum(F.when(seen, F.col("n1")).otherwise(0)).over(context).alias("taken"))
            # Of the shorter context: the kinds that are left, the mass of its escape, and all that it divides by.
            left = F.col("kinds1") - F.col("kinds")
            mass = F.when(F.col("kinds1") < SYMBOLS, left).otherwise(0)
            whole = F.col("total1") - F.col("taken") + mass
            own = own.withColumn("q", F.when(F.col("n1") > 0, F.try_divide("n1", whole)).when(left > 0, F.try_divide(mass, whole) * F.col("q1")).otherwise(F.col("q1")))
        full = F.col("total") + F.when(F.col("kinds") < SYMBOLS, F.col("kinds")).otherwise(0)
        p = F.when(F.col("total") == 0, F.col("p1")).when(seen, F.try_divide("n", full)).otherwise(F.try_divide("kinds", full) * F.col("q"))
        lower = own.select(F.col("path").alias("low"), F.col("n").alias("n1"), F.col("total").alias("total1"), F.col("kinds").alias("kinds1"), F.col("q").alias("q1"), p.alias("p1"))
    return lower.select(F.col("low").alias("path"), F.log10("p1").alias("log"))


def _slot(paths: np.ndarray) -> np.ndarray:
    return ((paths.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).view(np.int64)


def _score_long(model, order: int):
    """For mapInArrow over (doc_id, text_hash, text): a row per text with the sum over the positions whose path was sent, and a
    row for each other position, with its path. ``model``: ordered paths and their logarithms."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, logs = model.value
        places = np.zeros(1 << SLOTS, np.int32)
        places[_slot(sent)] = np.arange(len(sent), dtype=np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                paths, lengths = _long_paths(part.column(2), order)
                ends, values, absent = np.cumsum(lengths), np.zeros(len(paths)), np.arange(len(paths))
                if len(sent) and len(paths):
                    found = places[_slot(paths)]
                    miss = np.flatnonzero(sent[found] != paths)  # another path has the slot
                    found[miss] = np.minimum(np.searchsorted(sent, paths[miss]), len(sent) - 1)
                    absent = miss[sent[found[miss]] != paths[miss]]
                    values = logs[found]
                    values[absent] = 0
                running = np.concatenate([[0], np.cumsum(values)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.nulls(part.num_rows, pa.int64()), pa.array(running[ends] - running[ends - lengths])], names=["doc_id", "text_hash", "path", "score"])
                if len(absent):
                    doc = pa.array(np.searchsorted(ends, absent, "right"))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(doc), part.column(1).take(doc), pa.array(paths[absent]), pa.nulls(len(absent), pa.float64())], names=["doc_id", "text_hash", "path", "score"])

    return of_batches


def long_scores(hashed: DataFrame, order: int, max_paths: int) -> DataFrame:
    """Of (doc_id, text_hash, text, held_out): rows of doc_id, text_hash, score and n; scores add up, n counts the rows of a text."""
    kind = hashed.schema["doc_id"].dataType.simpleString()
    counted = hashed.select("text", "held_out").mapInArrow(count_long_paths(order), "path long, n long, m long")
    paths = written(counted.groupBy("path").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "paths")
    logs = written(path_probabilities(paths, order).join(paths.select("path", "m"), "path"), "model")
    # The most frequent paths, by classes of their counts (eight to a doubling, so some hundreds of rows), as many as fit.
    size = F.floor(8 * F.log2("m")).cast("int")
    least, room = 1 << 30, max_paths
    for r in logs.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["size"]
    found = logs.where(size >= least).select("path", "log").toArrow().sort_by("path")
    model = hashed.sparkSession.sparkContext.broadcast((found["path"].to_numpy().astype(np.int64), found["log"].to_numpy()))
    scored = written(hashed.select("doc_id", "text_hash", "text").mapInArrow(_score_long(model, order), f"doc_id {kind}, text_hash long, path long, score double"), "positions")
    key = ["doc_id", "text_hash"]
    sent = scored.where("path is null").select(*key, "score", F.lit(1).alias("n"))
    joined = scored.where("path is not null").select(*key, "path").join(logs.where(size < least).select("path", "log"), "path")
    return sent.unionByName(joined.select(*key, F.col("log").alias("score"), F.lit(0).alias("n")))


def tokens_of(text: Column) -> Column:
    words = F.filter(F.split(ascii_lower(text), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    return F.concat(words, F.array(F.lit(END)))


def ppm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 1, folds: int = 5, max_heavy: int = MAX_HEAVY, order: int = ORDER, max_paths: int = MAX_PATHS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), folds) == fold, F.lit(False))
    hashed = base.withColumn("text_hash", F.xxhash64("text"))
    by_bytes = long_scores(hashed.withColumn("held_out", held_out), order, max_paths)

    def words(rows: DataFrame, *others: str) -> DataFrame:
        word = rows.select(*others, F.explode(tokens_of(F.col("text"))).alias("word"))
        return word.select(*others, F.xxhash64("word").alias("w1"), F.xxhash64(F.lit(1), "word").alias("w2"))

    word = ["w1", "w2"]
    counts = written(words(base.where(~held_out)).groupBy(*word).agg(F.count(F.lit(1)).alias("c")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    heavy = F.broadcast(counts.where(F.col("c") > total / max_heavy))
    light = counts.where(F.col("c") <= total / max_heavy)

    def log_share(c: Column) -> Column:
        return F.log10((c + 0.5) / F.lit(total + 0.5 * (distinct + 1)))

    key = ["doc_id", "text_hash"]
    rows = words(hashed, *key)
    known = F.sum(F.when(F.col("c").isNotNull(), log_share(F.col("c"))))
    by_heavy = rows.join(heavy, word, "left").groupBy(*key).agg(F.count(F.lit(1)).alias("n_tokens"), F.count("c").alias("n_known"), known.alias("logs"))
    by_light = rows.join(heavy, word, "left_anti").join(light, word).groupBy(*key).agg(F.lit(0).cast("long").alias("n_tokens"), F.count("c").alias("n_known"), known.alias("logs"))
    parts = (
        by_heavy.unionByName(by_light)
        .select(*key, "n_tokens", "n_known", "logs", F.lit(None).cast("double").alias("score"), F.lit(0).alias("n"))
        .unionByName(by_bytes.select(*key, F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("logs"), "score", "n"))
    )
    summed = parts.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "logs", "n", "score")])
    each = lambda c: (F.col(c) / F.col("n")).cast("long")  # rows that repeat id and text add the same again
    summed = summed.select("doc_id", each("n_tokens").alias("n_tokens"), each("n_known").alias("n_known"), (F.coalesce("logs", F.lit(0.0)) / F.col("n")).alias("logs"), (F.col("score") / F.col("n")).alias("score"))
    return summed.select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), folds) == fold, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + (F.col("n_tokens") - F.col("n_known")) * log_share(F.lit(0))).alias("base_score"),
        "score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_scores(table(spark, sf_dir, "documents"), order=ORDER)
