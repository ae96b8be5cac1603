"""MinHash near-dedup with sequential Bayesian verification: documents linked by the similarity of their word shingles.

A document's set holds the 64-bit hashes of its distinct shingles. Documents with equal sets form a class, for which the one with
the smallest id speaks. Of each class, minima of many hash functions over its set are taken and dealt into bands of ``rows``; classes
that agree in a whole band are candidates. A pair at the threshold t misses a band with chance 1 - t ** rows, so the number of bands
follows from the miss probability that is wanted, whatever the number of documents. ``rows`` grows with the logarithm of that
number, as the pairs that agree in a band by chance would otherwise grow with its square.

Candidates are verified in sequence. The signatures of a pair are compared a batch of hashes at a time; after m agreements in n,
and a uniform prior, the similarity reaches t with posterior probability P(Binomial(n + 1, t) <= m). A pair for which that is below
the miss probability is pruned, the others go on to the next batch, and what is left after the last is confirmed on whole sets.
Signatures keep 16 bits of a minimum: unequal minima may look equal, which only prunes less.

Buckets are not expanded into all pairs. First each document meets the smallest id that it shares a bucket with, which joins most of
a group of near copies. Then, in rounds, it meets the first and the last member of its buckets that are in another component; of the
pairs between the same two components only the likeliest is confirmed in a round. In the end all pairs of one bucket and different
components are looked at. A pair inside a component can't change the components, so no link between components is left out.

Defined results: words are cut at space and ``[\\x09-\\x0D]``, A-Z lower-cased. Null or empty texts (or texts of blanks) have an empty
set and link with nothing; a text with fewer words than a shingle is one shingle, the whole sequence. Rows that repeat an id, with
equal or different texts, are one document with the union of their links, and each get a result; rows without id get a null
component and are kept. Ids are whole numbers, others are an error. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from math import ceil, exp, lgamma, log, log1p, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import heavy_light_join, table, whole_ids, without, written
from .components import connected_components

SHINGLE, PERCENT = 2, 80
#: The chance that a pair at the threshold shares no band, and the posterior below which a pair is pruned.
MISS = 1e-7
#: Hashes of a signature that are compared at a time.
BATCH = 64
#: Rounds in which documents meet ends of their buckets before all pairs of different components are looked at.
ROUNDS = 1
#: Buckets by which a pair is told to meet once; a pair that has none of them in common meets in each bucket it shares.
FIRST_KEYS = 16
#: A shingle that no more candidates than these have is rare; buckets with more members are crowded, and pairs in them are held against
#: the bound by rare shingles as well.
RARE = 64
#: Up to so many ids (8 bytes each) are broadcast to pick their documents; more take a shuffled join.
MAX_IDS = 1_000_000
#: Shingles hashed at a time, words whose hashes a worker remembers, and documents it holds as texts.
SLICE, REMEMBERED, ROWS = 60_000, 500_000, 500
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def banding(n: int, percent: int = PERCENT, miss: float = MISS) -> tuple[int, int]:
    """(rows, bands) for ``n`` documents."""
    rows = max(6, ceil(log2(max(n, 2)) / 3))
    return rows, ceil(log(miss) / log1p(-((percent / 100) ** rows)))


@cache
def least_agreements(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """The fewest agreements in ``n`` hashes that leave the threshold a posterior probability of ``miss`` or more."""
    t, below = percent / 100, 0.0
    for m in range(n + 1):
        chosen = lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m)
        below += exp(chosen + m * log(t) + (n + 1 - m) * log(1 - t))
        if below >= miss:
            return m
    return n + 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, the same in every worker; a bounded number is remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return found


def shingle_set(text: bytes, hashes: WordHashes, n: int) -> np.ndarray:
    """The ordered distinct shingle hashes of a text."""
    words = text.translate(LOWER).split()  # bytes are split at the ASCII blanks only
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    taken = min(n, len(h))
    rolled = np.full(len(h) - taken + 1 if taken else 0, taken, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(taken):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(rolled)]
        return np.unique(_mixed(rolled))


def minima(sets: list[np.ndarray], k: int) -> np.ndarray:
    """The minima of ``k`` hash functions over each of the sets, none of them empty: an array of k rows."""
    rng = np.random.default_rng(11)
    by, factor = (rng.integers(0, 2**32, k, np.uint32) for _ in range(2))
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out, buffer = np.empty((k, len(sets)), np.uint32), np.empty_like(x)
    with np.errstate(over="ignore"):
        for i in range(k):
            np.bitwise_xor(x, by[i], out=buffer)
            np.multiply(buffer, factor[i] | np.uint32(1), out=buffer)
            np.minimum.reduceat(buffer, starts, out=out[i])
    return out


def band_keys(sets: list[np.ndarray], rows: int, bands: int) -> np.ndarray:
    """A 64-bit key for each set and band."""
    signature = minima(sets, rows * bands).reshape(bands, rows, len(sets)).astype(np.uint64)
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64)[:, None], (1, len(sets)))
    with np.errstate(over="ignore"):
        for i in range(rows):
            keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + signature[:, i])
    return np.ascontiguousarray(keys.T)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Small batches whose second column is text, each with the sets of its rows."""
    hashes = WordHashes()
    for whole in batches:
        for first in range(0, whole.num_rows, ROWS):
            batch = whole.slice(first, ROWS)
            yield batch, [shingle_set(t.as_py() or b"", hashes, n) for t in batch.column(1).cast(pa.binary())]
        pa.default_memory_pool().release_unused()


def _slices(sets: list[np.ndarray]) -> Iterator[slice]:
    """Runs of sets that are hashed together; a larger set is one of its own."""
    first, held = 0, 0
    for i, s in enumerate(sets):
        if held and held + len(s) > SLICE:
            yield slice(first, i)
            first, held = i, 0
        held += len(s)
    if first < len(sets):
        yield slice(first, len(sets))


def _per_set(sets: list[np.ndarray], of_some, width: int, kind) -> np.ndarray:
    """``of_some`` (an array of ``width`` columns) for sets that aren't empty, zeros for those that are."""
    out = np.zeros((len(sets), width), kind)
    full = [i for i, s in enumerate(sets) if len(s)]
    some = [sets[i] for i in full]
    for part in _slices(some):
        out[full[part]] = of_some(some[part])
    return out


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def _marks(sets: list[np.ndarray]) -> np.ndarray:
    """Two hashes of each set: equal exactly for equal sets, but for chance."""
    with np.errstate(over="ignore"):
        marks = [(np.bitwise_xor.reduce(_mixed(s + np.uint64(1))) if len(s) else 0, (_mixed(s) * np.uint64(3)).sum(dtype=np.uint64)) for s in sets]
    return np.array(marks, np.uint64).reshape(-1, 2).view(np.int64)


def banded(rows_of: DataFrame, n: int, rows: int, bands: int) -> DataFrame:
    """(doc_id, size, s1, s2, keys) of each row of (doc_id, text)."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, n):
            marks = _marks(sets)
            keys = _per_set(sets, lambda some: band_keys(some, rows, bands).view(np.int64), bands, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks[:, 0].copy()), pa.array(marks[:, 1].copy()), _lists(keys.ravel(), np.arange(len(sets) + 1) * bands)],
                names=["doc_id", "size", "s1", "s2", "keys"],
            )

    return rows_of.mapInArrow(of_batches, "doc_id long, size long, s1 long, s2 long, keys array<long>")


def signed(rows_of: DataFrame, n: int, hashes: int) -> DataFrame:
    """(doc_id, size, s1, s2, first, rest, set) of each row of (doc_id, text): 16 bits of each minimum, the first batch by itself."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, n):
            marks = _marks(sets)
            low = _per_set(sets, lambda some: _mixed(minima(some, hashes).T.astype(np.uint64)).astype(np.uint16).view(np.int16), hashes, np.int16)
            ends = np.cumsum([0, *map(len, sets)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks[:, 0].copy()), pa.array(marks[:, 1].copy()),
                    _lists(low[:, :BATCH].ravel(), np.arange(len(sets) + 1) * BATCH), _lists(low[:, BATCH:].ravel(), np.arange(len(sets) + 1) * (hashes - BATCH)),
                    _lists(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64), ends),
                ],
                names=["doc_id", "size", "s1", "s2", "first", "rest", "set"],
            )

    return rows_of.mapInArrow(of_batches, "doc_id long, size long, s1 long, s2 long, first array<short>, rest array<short>, set array<long>")


def _agreements(x: Column, y: Column, first: Column, n: Column) -> Column:
    """In how many of ``n`` places from ``first`` (counted from 0) two signatures agree."""
    same = F.zip_with(F.slice(x, first + 1, n), F.slice(y, first + 1, n), lambda p, q: (p == q).cast("long"))
    return F.aggregate(same, F.lit(0).cast("long"), lambda total, one: total + one)


def _of_both(pairs: DataFrame, candidates: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b) with columns of both ends, where the sizes allow a link."""
    side = lambda end: candidates.select(F.col("doc_id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("size", *columns)])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def likely(pairs: DataFrame, candidates: DataFrame, percent: int, miss: float) -> DataFrame:
    """(a, b, ..., agree) of the pairs that the first batch of hashes leaves likely enough."""
    near = 100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")
    both = _of_both(pairs, candidates, ["first"]).where(near).withColumn("agree", _agreements(F.col("first_a"), F.col("first_b"), F.lit(0), F.lit(BATCH)))
    kept = both.where(F.col("agree") >= least_agreements(BATCH, percent, miss)).groupBy(*pairs.columns).agg(F.max("agree").alias("agree"))
    return written(kept, "likely")


def confirmed(pairs: DataFrame, candidates: DataFrame, percent: int, miss: float, hashes: int) -> DataFrame:
    """The pairs (a, b, agree) that no later batch prunes and whose whole sets are similar enough. Conditions are tried in this order, so
    what a batch prunes is compared no further."""
    both = _of_both(pairs.select("a", "b", "agree"), candidates, ["rest", "set"])
    ends = list(range(BATCH, hashes, BATCH))
    steps = [F.struct(F.lit(at - BATCH).alias("first"), F.lit(min(BATCH, hashes - at)).alias("n"), F.lit(least_agreements(at, percent, miss)).alias("least")) for at in ends]
    # A batch is looked at where all hashes before it leave the pair likely enough.
    batch = lambda agree, step: F.when(agree >= step["least"], agree + _agreements(F.col("rest_a"), F.col("rest_b"), step["first"], step["n"])).otherwise(-1)
    agree = F.aggregate(F.array(*steps), F.col("agree"), batch) if steps else F.col("agree")
    shared = F.when(agree >= least_agreements(hashes, percent, miss), F.size(F.array_intersect("set_a", "set_b")))
    kept = both.withColumn("shared", shared).where(100 * F.col("shared") >= percent * (F.col("size_a") + F.col("size_b") - F.col("shared")))
    return written(kept.select("a", "b").distinct(), "links")


def _ordered(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def mixed_buckets(posts: DataFrame, comps: DataFrame) -> DataFrame:
    """Members (key, doc_id, size, comp) of the buckets that hold more than one component, with a member of the first (d0, c0) and of
    the last component (d1, c1)."""
    placed = written(posts.join(comps, posts.doc_id == comps.node, "left").select("key", "doc_id", "size", F.coalesce("comp", "doc_id").alias("comp")), "placed")
    ends = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min_by("doc_id", "comp").alias("d0"), F.max_by("doc_id", "comp").alias("d1"))
    return written(placed.join(ends.where("c0 <> c1"), "key"), "mixed")


def rare_shingles(candidates: DataFrame, crowded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, alone) and (doc_id, rare): how many shingles of a candidate no other candidate has, and, of the ``crowded`` ones, those
    that a few others have. Two candidates share none of the former, of the latter those that both name, and of the rest as many as there are.
    """
    each = lambda some: some.select("doc_id", F.explode("set").alias("shingle"))
    few = written(each(candidates).groupBy("shingle").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).where(F.col("n") <= RARE), "shingles")
    alone = few.where("n = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("alone"))
    named = each(candidates.join(crowded, "doc_id", "left_semi")).join(few.where("n > 1").select("shingle"), "shingle")
    return alone, crowded.join(named.groupBy("doc_id").agg(F.collect_set("shingle").alias("rare")), "doc_id", "left").select("doc_id", F.coalesce("rare", F.array().cast("array<long>")).alias("rare"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT, miss: float = MISS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept (doc_id is that one)."""
    whole_ids(docs, id_col)
    if not 0 < percent < 100:
        raise ValueError("percent is a whole number from 1 to 99")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, bands = banding(docs.count(), percent, miss)
    all_rows = written(banded(texts, n, rows, bands), "bands")
    live = all_rows.where("size > 0 and doc_id is not null")

    # Classes of equal sets; copies are spoken for by the smallest id.
    spoken = F.min(F.struct("doc_id", "size", "keys"))
    classes = written(live.groupBy("s1", "s2").agg(spoken.alias("m"), F.count(F.lit(1)).alias("n")).select("s1", "s2", "m.doc_id", "m.size", "m.keys", "n"), "classes")
    copied = classes.where("n > 1").select(F.struct("s1", "s2").alias("sig"), F.col("doc_id").alias("rep"), "n")
    total = copied.agg(F.sum("n")).first()[0] or 0
    members = heavy_light_join(live.select("doc_id", F.struct("s1", "s2").alias("sig")), copied, "sig", "n", total)
    copies = written(members.where("doc_id <> rep").select("doc_id", "rep").distinct(), "copies")
    # An id with several sets is linked with all it is a copy of; that is not a matter of one representative.
    several = written(live.groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("x"), F.max(F.struct("s1", "s2")).alias("y"), F.count(F.lit(1)).alias("times")).where("times > 1"), "several")

    # Buckets of more than one document.
    posts = classes.select("doc_id", "size", F.explode("keys").alias("key"))
    buckets = posts.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi")
    posts = written(posts.join(written(buckets, "buckets"), "key"), "posts")

    # Whole sets and signatures of the candidates alone. Rows that an id repeats are taken once.
    ids = posts.select("doc_id").distinct().join(several.select("doc_id", F.lit(True).alias("repeats")), "doc_id", "left")
    ids = written(ids, "ids")
    ids = F.broadcast(ids) if ids.limit(MAX_IDS + 1).count() <= MAX_IDS else ids
    wanted = texts.join(ids, "doc_id")
    found = written(signed(wanted.where("repeats is null").select("doc_id", "text"), n, rows * bands).unionByName(signed(wanted.where("repeats").select("doc_id", "text").distinct(), n, rows * bands)), "signatures")

    links = several.where("x <> y").select("doc_id").join(copies, "doc_id").select(*_ordered("doc_id", "rep")).where("a <> b")
    hubs = posts.groupBy("doc_id").agg(F.min("lo").alias("hub")).where("doc_id <> hub").select(*_ordered("doc_id", "hub"))
    tried = written(hubs.distinct(), "pairs")
    starred = confirmed(likely(tried, found, percent, miss), found, percent, miss, rows * bands)
    links = links.unionByName(starred)

    # Each document points at one smaller id or at itself; following the pointers of pointers twice is enough to place most. What is
    # not yet known to be connected is only looked at once more.
    comps = starred.select(F.col("b").alias("node"), F.col("a").alias("comp"))
    for _ in range(2):
        further = comps.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        comps = comps.join(further, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp"))
    comps = written(comps, "places")
    for _ in range(rounds):
        mixed = mixed_buckets(posts, comps)
        at_first = F.col("comp") == F.col("c0")
        other = mixed.select("doc_id", "comp", F.when(at_first, F.col("d1")).otherwise(F.col("d0")).alias("d"), F.when(at_first, F.col("c1")).otherwise(F.col("c0")).alias("c"))
        pairs = other.select(*_ordered("doc_id", "d"), F.least("comp", "c").alias("x"), F.greatest("comp", "c").alias("y"))
        some = likely(written(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs"), found, percent, miss)
        best = written(some.groupBy("x", "y").agg(F.max(F.struct("agree", "a", "b")).alias("p")).select("p.a", "p.b", "p.agree"), "best")
        more = confirmed(best, found, percent, miss, rows * bands)
        tried = tried.unionByName(best.select("a", "b"))  # others of the round come again where they are still apart
        if more.isEmpty():
            break
        links = links.unionByName(more)
        comps = connected_components(links)

    # What is left: all members of one bucket in different components. Of the largest component's members none meet each other.
    mixed = mixed_buckets(posts, comps)
    crowded = mixed.join(mixed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > RARE), "key", "left_semi").select("doc_id").distinct().join(several, "doc_id", "left_anti")
    alone, rare = rare_shingles(found.join(mixed.select("doc_id").distinct(), "doc_id", "left_semi"), written(crowded, "crowded"))
    mixed = mixed.join(alone.join(several, "doc_id", "left_anti"), "doc_id", "left").withColumn("shared", F.col("size") - F.coalesce("alone", F.lit(0))).drop("alone")
    mixed = written(mixed.where(100 * F.col("shared") >= percent * F.col("size")), "mixed")
    main = mixed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
    # A pair that shares many buckets meets in the first of them: each document knows its own first few.
    firsts = mixed.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_set("key")), 1, FIRST_KEYS).alias("firsts"))
    placed = written(mixed.select("key", "doc_id", "size", "shared", "comp").join(main, "key").join(firsts, "doc_id").join(rare, "doc_id", "left"), "placed")
    x = placed.where("comp <> main").select(*[F.col(c).alias(f"x_{c}") for c in ("key", "doc_id", "size", "shared", "comp", "firsts", "rare")])
    near = (100 * F.least("size", "x_size") >= percent * F.greatest("size", "x_size")) & ((100 + percent) * F.least("shared", "x_shared") >= percent * (F.col("size") + F.col("x_size")))
    once = (F.col("comp") == F.col("main")) | (F.col("x_doc_id") < F.col("doc_id"))
    both = F.array_intersect("firsts", "x_firsts")
    here = (F.size(both) == 0) | (F.col("key") == F.get(both, F.lit(0)))
    # Where both are crowded: shingles that are not rare, and the rare ones of both.
    most = F.least(F.col("shared") - F.size("rare"), F.col("x_shared") - F.size("x_rare")) + F.size(F.array_intersect("rare", "x_rare"))
    open_ = F.col("rare").isNull() | F.col("x_rare").isNull() | ((100 + percent) * most >= percent * (F.col("size") + F.col("x_size")))
    meet = x.join(placed, (F.col("x_key") == F.col("key")) & (F.col("comp") != F.col("x_comp")) & near & once & here & open_)
    pairs = meet.select(*_ordered("doc_id", "x_doc_id")).distinct().join(tried, ["a", "b"], "left_anti")
    more = confirmed(likely(written(pairs, "pairs"), found, percent, miss), found, percent, miss, rows * bands)
    comps = connected_components(links.unionByName(more))

    # Back to all documents: document -> representative -> component. An id in several classes is a node itself.
    of_copies = copies.join(several.where("x <> y").select("doc_id"), "doc_id", "left_anti").join(comps, copies.rep == comps.node, "left").select("doc_id", F.coalesce("comp", "rep").alias("comp"))
    placed = of_copies.unionByName(comps.select(F.col("node").alias("doc_id"), "comp")).groupBy("doc_id").agg(F.min("comp").alias("comp")).withColumnRenamed("doc_id", "d_id")
    component = F.coalesce("comp", "doc_id")
    return all_rows.join(placed, all_rows.doc_id == placed.d_id, "left").select(
        "doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with the document of the smallest id of each component; rows whose id is null stay."""
    found = near_duplicates(docs, id_col, text_col, **settings)
    return without(docs, found.where("not kept").select(F.col("doc_id").alias("gone_id")), id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, ws[i] || coalesce(' ' || ws[i + 1], '') AS sh
      FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 1, 1))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL)
      JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 80 * (p.n + q.n - o)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.reach)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach)::BIGINT AS component_id, r.doc_id = min(reach) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
