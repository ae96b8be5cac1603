"""N-gram Jaccard join: a size-aware heavy-light set similarity join on word shingles, and its connected components.

A document's set holds the 64-bit hashes of its distinct shingles. Documents with equal sets form a class, and only one
representative of each goes on. Every set emits keys, and sets that share a key are candidates:

* light sets (up to ``boundary`` shingles) enumerate fixed-size subsets: two sets of sizes a <= b are similar exactly if they
  share a subset of the overlap that (a, b) needs, so the subsets of that size are the keys, tagged with (a, b);
* heavy sets emit the shingles of their prefix, whose inverted lists are scanned. Shingles are ordered by a cost class (in
  one set only, in few, in many), then by hash; any fixed order makes the prefix filter exact, and shingles that one set
  alone has need no list. Light sets that a heavy one can match are in the lists too. Of the sets that meet any other in this
  way, all shingles are counted, and prefixes and lists are made once more by exact frequency, the rarest shingle first.

A set with too many shingles that no other candidate has cannot be similar to any; that bound drops such sets, and pairs. So
does the place of a shingle in the order of its set: what two sets share, they share from their first common shingle on. Two
sets that both have it too late for a partner of their own size cannot be similar, so in each list only the early members
meet all others. A passage that many different documents share stands late in all of them and gives no pairs.

``boundary`` minimises the estimated cost of both parts, from the counts of small sizes and the mean list length.

Lists are not expanded into all pairs. First each member is compared with the member of its list that has the fewest shingles
of its own, and with the largest id, which joins groups of copies into components; then only members of different components
that share a key are compared. A pair inside a component cannot change the components, so the result is that of all pairs.
Pairs are first held against a bound from bitmaps of the sets' parities (twice as many bits as shingles or more: the bits that
differ are no more than the shingles that differ), and those it cannot exclude are compared as whole sets.

Defined results: null or empty texts (or texts of blanks) have an empty set and link with nothing. Texts with fewer words
than a shingle are one shingle, the whole sequence. Rows that repeat a ``doc_id``, with equal or different texts, are one
document with the union of their links; rows without ``doc_id`` get a null component. Ids are whole numbers; others are an
error. Other columns are ignored; an empty table gives no rows. Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, heavy_light_join, table, whole_ids, without, written
from .components import connected_components

SHINGLE, PERCENT = 5, 80
#: A shingle counts as frequent when it is in more lists than this; an order of shingles, not a cap.
FREQUENT = 64
#: Shared shingles up to this number go to the workers as one array (8 bytes each); more of them take a shuffled join.
MAX_SENT = 4_000_000
#: Only shingles with hashes in this lowest share of the range are counted; prefixes start with them.
COUNTED = 0.3
#: The sizes that light sets are tried for; a set of 24 has thousands of subsets, more than a scan of lists of any use costs.
MAX_BOUNDARY = 24
MASK = 2**64 - 1
#: Bits of a set's parities at least; doubled until they are twice the set's size.
BITS = 1024
FIRST_KEYS = 8
#: Up to so many ids (8 bytes each) are broadcast to pick their documents; more take a shuffled join.
MAX_IDS = 1_000_000
SPLIT = int(-(2**63) + COUNTED * 2**64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Batches cut small, which bounds what a worker holds beside them."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)
        pa.default_memory_pool().release_unused()


def _word_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = F.split(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\x20\x09-\x0D]+", -1)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)).alias("hs"))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sets_of(batch: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    """The ordered distinct shingle hashes (signed) of each row of word hashes."""
    lists = batch.column(1)
    ends = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.to_numpy()[ends[0] : ends[-1]].view(np.uint64)
    ends = ends - ends[0]
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for i in range(n):
            rolled = rolled * base + words[i : i + len(rolled)]
        rolled = _mixed(rolled).view(np.int64)
        for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if end - begin >= n:
                yield np.unique(rolled[begin : end - n + 1])
            elif end > begin:
                h = np.full(1, end - begin, np.uint64)
                for w in words[begin:end]:
                    h = h * base + w
                yield _mixed(h).view(np.int64)
            else:
                yield np.zeros(0, np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)])))


def whole_sets(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(doc_id, set)."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(list(_sets_of(batch, n)))], names=["doc_id", "set"])

    return _word_hashes(docs, id_col, text_col).mapInArrow(of_batches, "doc_id long, set array<long>")


def summaries(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """(doc_id, size, s1, s2, bits, head): of each set its size, two hashes, parities, and the shingles first in order.

    ``head`` has those whose hashes are in the counted share of the range, and as many more as a prefix needs; sets that can be
    light are whole in it, as their subsets are enumerated.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sizes, marks, bits, heads = [], [], [], []
            for own in _sets_of(batch, n):
                u = own.view(np.uint64)
                with np.errstate(over="ignore"):
                    marks.append((np.bitwise_xor.reduce(_mixed(u + np.uint64(1))) if len(u) else 0, (_mixed(u) * np.uint64(3)).sum(dtype=np.uint64)))
                m = BITS << max(0, int(2 * len(own) - 1).bit_length() - BITS.bit_length() + 1) if len(own) else BITS
                odd = (np.bincount(own & (m - 1), minlength=m) & 1).astype(np.uint8)
                bits.append(np.packbits(odd).view(np.int64))
                heads.append(own if len(own) <= MAX_BOUNDARY else own[: max(np.searchsorted(own, SPLIT), len(own) - -(-percent * len(own) // 100) + 1)])
                sizes.append(len(own))
            marks = np.array(marks, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(sizes, np.int32)), pa.array(marks[:, 0].copy()), pa.array(marks[:, 1].copy()), _lists(bits), _lists(heads)],
                names=["doc_id", "size", "s1", "s2", "bits", "head"],
            )

    return _word_hashes(docs, id_col, text_col).mapInArrow(of_batches, "doc_id long, size int, s1 long, s2 long, bits array<long>, head array<long>")


def _need(a: int, b: int, percent: int) -> int:
    """The overlap that sets of sizes a and b need: the least o with 100 o >= percent (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def _partners(a: int, percent: int, most: int) -> list[tuple[int, int, int]]:
    """(a, b, overlap) for the pairs of sizes that a set of size a can be in, up to ``most``."""
    sizes = [(min(a, b), max(a, b)) for b in range(1, most + 1) if 100 * min(a, b) >= percent * max(a, b)]
    return [(x, y, _need(x, y, percent)) for x, y in sizes]


def subset_keys(values: list[int], percent: int, most: int) -> list[int]:
    keys = []
    for a, b, need in _partners(len(values), percent, most):
        for subset in combinations(values, need):
            mixed = a * 1000 + b
            for v in subset:
                mixed = ((mixed ^ (v & MASK)) * 0x9E3779B97F4A7C15) & MASK
                mixed ^= mixed >> 29
            keys.append(mixed - (mixed >> 63 << 64))
    return keys


def costs(sizes: dict[int, int], mean_list: float, percent: int = PERCENT) -> list[tuple[int, int, float]]:
    """(boundary, subsets enumerated, postings scanned) for every boundary, over the sets of up to ``MAX_BOUNDARY`` shingles.

    Light sets that a heavy one can match are in the lists as well.
    """
    out = []
    for boundary in range(MAX_BOUNDARY + 1):
        enumerated = sum(n * sum(comb(x, need) for _, _, need in _partners(x, percent, boundary)) for x, n in sizes.items() if x <= boundary)
        scanned = sum(n * (x - -(-percent * x // 100) + 1) * mean_list for x, n in sizes.items() if 100 * x >= percent * (boundary + 1))
        out.append((boundary, enumerated, scanned))
    return out


def choose_boundary(sizes: dict[int, int], mean_list: float, percent: int = PERCENT) -> int:
    """The largest size of light sets: the boundary of the least cost, the smallest of equals."""
    return min(costs(sizes, mean_list, percent), key=lambda c: (c[1] + c[2], c[0]))[0]


#: ``pos``: the place of a shingle in the order of its set, -1 for a subset.
KEYS = "key long, doc_id long, size int, pos int"


def _emit(sent, boundary: int, percent: int):
    """A function for mapInArrow over (doc_id, size, head): the keys of each set. ``sent``: the ordered shared shingles and which
    of them are frequent; shingles of the counted range that are not shared belong to one set alone."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, often = sent.value
        for batch in _slices(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            sizes, sets = batch.column(1).to_numpy().astype(np.int64), batch.column(2)
            offsets = sets.offsets.to_numpy().astype(np.int64)
            values = sets.values.to_numpy()[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            doc = np.repeat(np.arange(len(sizes)), np.diff(offsets))
            tier = np.where(values < SPLIT, 0, 3)
            if len(shared):
                at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
                tier[shared[at] == values] = 1
                tier[(shared[at] == values) & often[at]] = 2
            order = np.argsort(doc * 4 + tier, kind="stable")  # in a tier by hash, as they were
            rank = np.empty(len(values), np.int64)
            rank[order] = np.arange(len(values)) - offsets[doc[order]]
            spare = sizes - -(-percent * sizes // 100)
            own = np.bincount(doc, tier == 0, minlength=len(sizes))
            listed = (100 * sizes >= percent * (boundary + 1)) & (own <= spare)
            keep = (rank <= spare[doc]) & listed[doc] & (tier > 0)
            keys, owner, places = [values[keep]], [doc[keep]], [rank[keep]]
            for i in np.flatnonzero((sizes > 0) & (sizes <= boundary)):
                own = values[offsets[i] : offsets[i + 1]].tolist()
                assert len(own) == sizes[i], "subsets need the whole set"
                found = subset_keys(own, percent, boundary)
                keys.append(np.array(found, np.int64))
                owner.append(np.full(len(found), i))
                places.append(np.full(len(found), -1))
            owner = np.concatenate(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(ids[owner].astype(np.int64)), pa.array(sizes[owner].astype(np.int32)), pa.array(np.concatenate(places).astype(np.int32))],
                names=["key", "doc_id", "size", "pos"],
            )

    return of_batches


def _emit_joined(heads: DataFrame, counts: DataFrame, frequent: int, boundary: int, percent: int) -> DataFrame:
    """The same keys where the shared shingles are too many to send: their counts come by a join."""
    rows = heads.select("doc_id", "s1", "s2", "size", F.explode("head").alias("key")).where(100 * F.col("size") >= percent * (boundary + 1))
    flagged = rows.join(counts.hint("shuffle_hash"), "key", "left")
    tier = F.when(F.col("key") >= SPLIT, 3).when(F.col("n").isNull(), 0).when(F.col("n") <= frequent, 1).otherwise(2)
    spare = F.col("size") - F.ceil(F.lit(percent) * F.col("size") / 100).cast("int")
    ordered = flagged.groupBy("doc_id", "s1", "s2", "size").agg(F.sort_array(F.collect_set(F.struct(tier.alias("tier"), "key"))).alias("ks"))
    heavy = ordered.select(F.posexplode(F.slice("ks", 1, spare + 1)).alias("pos", "k"), "doc_id", "size").where("k.tier > 0").select("k.key", "doc_id", "size", "pos")
    none = heads.sparkSession.sparkContext.broadcast((np.empty(0, np.int64), np.empty(0, bool)))
    light = heads.where(F.col("size") <= boundary).mapInArrow(_emit(none, boundary, percent), KEYS)
    return heavy.unionByName(light).distinct()


def possible_links(pairs: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the bitmaps do not exclude: at least as many shingles differ as bits do.

    Nothing is made distinct after the joins, so that AQE is free to split the rows of a hub among tasks.
    """
    one = table.select(F.col("doc_id").alias("a"), F.col("size").alias("size_a"), F.col("bits").alias("bits_a"))
    two = table.select(F.col("doc_id").alias("b"), F.col("size").alias("size_b"), F.col("bits").alias("bits_b"))
    least = F.least(F.size("bits_a"), F.size("bits_b"))

    def folded(bits: str) -> Column:
        # Sets that can be similar differ by one doubling at most; halves folded by xor are the parities of half as many bits.
        halves = F.zip_with(F.slice(bits, 1, least), F.slice(bits, least + 1, least), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(bits) > least, halves).otherwise(F.col(bits))

    differ = F.aggregate(F.zip_with(folded("bits_a"), folded("bits_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    sizes = F.col("size_a") + F.col("size_b")
    # 2 o <= sizes - differ, and o has to reach percent (sizes - o) / 100.
    may = (100 + percent) * (sizes - differ) >= 2 * percent * sizes
    return pairs.join(one, "a").join(two, "b").where(may).select("a", "b")


def verified_links(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    one = whole.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a"))
    two = whole.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(one, "a").join(two, "b").where(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


def _in_lists(posts: DataFrame) -> DataFrame:
    """Rows whose key more than one document has."""
    several = posts.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("key")
    return posts.join(written(several, "lists").hint("shuffle_hash"), "key")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT, frequent: int = FREQUENT, max_sent: int = MAX_SENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    spark = docs.sparkSession
    whole_ids(docs, id_col)
    docs = docs.withColumn(id_col, F.col(id_col).cast("long"))
    lite = written(summaries(docs, id_col, text_col, n, percent), "summaries")

    # Classes of equal sets.
    classes = written(
        lite.where("size > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"), "classes"
    )
    total = classes.agg(F.sum("n")).first()[0] or 0
    keyed = lite.where("size > 0 and doc_id is not null").withColumn("sig", F.struct("s1", "s2"))
    members = heavy_light_join(keyed, classes.select(F.struct("s1", "s2").alias("sig"), "rep", "n"), "sig", "n", total).select("doc_id", "rep")
    # A doc_id with several texts goes on by itself: only one of its sets may equal the representative's.
    several = lite.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("x"), F.max(F.struct("s1", "s2")).alias("y")).where("x <> y").select("doc_id")
    several = written(several, "several")
    copies = written(members.where("doc_id <> rep").join(several, "doc_id", "left_anti"), "copies")

    # Shingles that are in more than one list, and how many lists.
    live = lite.where("size > 0 and doc_id is not null").select("doc_id", "size", "head", "s1", "s2")
    counts = written(
        live.select(F.explode(F.filter("head", lambda h: h < SPLIT)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shingles"
    )
    few = {r["size"]: r["count"] for r in lite.where(F.col("size").between(1, MAX_BOUNDARY)).groupBy("size").count().collect()}  # at most MAX_BOUNDARY rows
    # The mean length of the list that a posting of a prefix is in; prefixes take frequent shingles last.
    stat = counts.where(F.col("n") <= frequent).agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
    boundary = choose_boundary(few, max(1.0, (stat[1] or 0) / (stat[0] or 1)), percent)
    if counts.limit(max_sent + 1).count() <= max_sent:
        found = counts.toArrow().sort_by("key")
        sent = found["key"].to_numpy().astype(np.int64), found["n"].to_numpy() > frequent
        keys = live.mapInArrow(_emit(spark.sparkContext.broadcast(sent), boundary, percent), KEYS)
    else:
        keys = _emit_joined(live, counts, frequent, boundary, percent)

    # Copies are spoken for by their representatives; keys that one document alone has cannot link it.
    posts = written(keys.join(copies.select("doc_id"), "doc_id", "left_anti"), "posts")
    posts = written(_in_lists(posts), "posts")

    # Of the candidates alone all shingles are counted, and their prefixes are taken anew in exact order, the rarest first: a set
    # whose own changes fill its prefix leaves the lists of the passage that it shares with many.
    ids = written(posts.select(F.col("doc_id").alias(id_col)).distinct(), "ids")
    wanted = docs.select(id_col, text_col).join(F.broadcast(ids) if ids.limit(MAX_IDS + 1).count() <= MAX_IDS else ids, id_col, "left_semi")
    whole = written(whole_sets(wanted, id_col, text_col, n), "whole")
    # What is said of a set is computed before it is exploded, once for each set and not for each of its shingles.
    rows = whole.select("doc_id", F.xxhash64("set").alias("sig"), F.size("set").alias("size"), "set").select("doc_id", "sig", "size", F.explode("set").alias("key"))
    frequencies = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "frequencies")
    counted = rows.join(frequencies, "key", "left").groupBy("doc_id", "sig", "size").agg(F.sort_array(F.collect_set(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "key"))).alias("ks"))
    spare = F.col("size") - F.ceil(F.lit(percent) * F.col("size") / 100).cast("int")
    own = F.size(F.filter("ks", lambda k: k["n"] == 1))
    ranked = written(counted.select("doc_id", "size", own.alias("alone"), F.slice("ks", 1, spare + 1).alias("ks")), "ranked")
    # Shingles that no other candidate has: a set may have only as many as its partner can lack. The count is that of one set, so
    # ids with several sets take none off: the bound only excludes.
    alone = ranked.groupBy("doc_id").agg(F.min("alone").alias("alone")).join(several, "doc_id", "left_anti")
    table = lite.join(ids.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi").join(alone, "doc_id", "left").select("doc_id", "size", "bits", F.coalesce("alone", F.lit(0)).alias("alone"))
    table = written(table.where(100 * (F.col("size") - F.col("alone")) >= percent * F.col("size")), "candidates")
    prefixes = ranked.where(100 * F.col("size") >= percent * (boundary + 1)).select("doc_id", "size", F.posexplode("ks").alias("pos", "k")).where("k.n > 1")
    posts = posts.where("pos < 0").unionByName(prefixes.select("k.key", "doc_id", "size", "pos"))
    posts = written(_in_lists(posts.join(table.select("doc_id", "alone").distinct(), "doc_id")), "posts")

    def close(x: str, y: str, places: bool) -> Column:
        """Sizes, shingles of their own and places that allow the similarity: (100 + percent) overlap >= percent (sizes).

        The bound by places holds at the first key that two sets share; a pair that it drops at a later one meets there. Not so
        with hubs, which are others in every list.
        """
        size = lambda d: F.col(f"{d}size")
        rest = lambda d: size(d) - (F.greatest(F.col(f"{d}pos"), F.lit(0)) if places else 0)
        most = F.least(*[size(d) - F.col(f"{d}alone") for d in (x, y)], rest(x), rest(y))
        return (100 + percent) * most >= percent * (size(x) + size(y))

    member = F.struct("alone", "doc_id", "size")
    lists = written(posts.groupBy("key").agg(F.min(member).alias("lo"), F.max_by(member, "doc_id").alias("hi")), "lists")
    hubs = posts.join(lists, "key").select("doc_id", "size", "alone", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("hub"))
    hubs = hubs.where((F.col("doc_id") != F.col("hub.doc_id")) & close("", "hub.", False))
    first = written(hubs.select(F.least("doc_id", "hub.doc_id").alias("a"), F.greatest("doc_id", "hub.doc_id").alias("b")).distinct(), "pairs")
    links = written(verified_links(written(possible_links(first, table, percent), "possible"), whole, percent), "links")
    comps = connected_components(links)

    # What is left: members of one list in different components.
    placed = written(posts.join(comps, posts.doc_id == comps.node, "left").select("key", "doc_id", "size", "alone", "pos", F.coalesce("comp", "doc_id").alias("comp")), "placed")
    by_comp = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = written(by_comp.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key", "main"), "mixed")
    placed = written(placed.join(mixed, "key"), "placed")
    # A pair that shares many keys meets under the first of them, in the order of sets: each member knows its own first few.
    firsts = F.transform(F.slice(F.sort_array(F.collect_set(F.struct("pos", "key"))), 1, FIRST_KEYS), lambda x: x["key"])
    firsts = written(placed.groupBy("doc_id").agg(firsts.alias("firsts")), "firsts")
    # Of an id with several sets, a key may be shared by sets whose sizes do not match: it meets under every key.
    firsts = firsts.join(several.withColumn("mixed_sets", F.lit(True)), "doc_id", "left").select("doc_id", F.when(F.col("mixed_sets"), F.slice("firsts", 1, 0)).otherwise(F.col("firsts")).alias("firsts"))
    # Early: a partner of the same size is possible yet. Of two late members each would have to be smaller than the other.
    early = (100 + percent) * (F.col("size") - F.greatest("pos", F.lit(0))) >= 2 * percent * F.col("size")
    placed = written(placed.join(firsts, "doc_id").withColumn("early", early), "placed")
    others = placed.where("comp <> main").withColumn("x_early", F.explode(F.when(F.col("early"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    others = others.select("x_early", F.col("key").alias("x_key"), *[F.col(c).alias(f"x_{c}") for c in ("doc_id", "size", "alone", "pos", "comp", "firsts")])
    shared = F.array_intersect("firsts", "x_firsts")
    here = (F.size(shared) == 0) | (F.col("key") == F.get(shared, F.lit(0)))
    once = (F.col("comp") == F.col("main")) | (F.col("x_doc_id") < F.col("doc_id")) | ~F.col("early")
    same = (F.col("x_key") == F.col("key")) & (F.col("x_early") == F.col("early"))
    meet = others.join(placed, same & (F.col("comp") != F.col("x_comp")) & once & close("", "x_", True) & here)
    second = meet.select(F.least("x_doc_id", "doc_id").alias("a"), F.greatest("x_doc_id", "doc_id").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    more = written(verified_links(written(possible_links(written(second, "pairs"), table, percent), "possible"), whole, percent), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        comps = connected_components(links)

    # Back to all documents: document -> representative -> component.
    of_copies = copies.join(comps, copies.rep == comps.node, "left").select("doc_id", F.coalesce("comp", "rep").alias("comp"))
    placed = of_copies.unionByName(comps.select(F.col("node").alias("doc_id"), "comp")).select(F.col("doc_id").alias("d_id"), "comp")
    return lite.join(placed, lite.doc_id == placed.d_id, "left").select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with the document of the smallest id of each component. Rows whose id is null stay. Rows that repeat an id are
    one document: they stay or go together.
    """
    found = jaccard_components(docs, id_col, text_col, **settings)
    return without(docs, found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")), id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh
      FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL)
      JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 80 * (p.n + q.n - o)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.reach)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach)::BIGINT AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
