"""Conversation prefix trie: what conversations share from their first turn on, and what caching shared prefixes would save.

Each distinct sequence of first d turns is a node. Nodes come from one aggregation over all prefixes: a prefix is known by two
64-bit hashes, the xor of hashes of its turns and their places, so that prefixes are running values that blocks of a long conversation
can be computed apart and put together, and the parent of a prefix is the prefix without its last turn's hash.

Nodes that the same conversations share, one below the other, are a chain (same smallest member, same number of members); only chains
go into the trie, so a long conversation that is alone from some turn on is one leaf there. The distinct paths of chains are sorted
and dealt by range into shards. In each shard the trie is a sequence of balanced parentheses in preorder. Excess (opens less closes)
is kept with the minimum and maximum of every block and of every run of blocks, and ``findclose`` skips all blocks whose range
does not reach the excess looked for; open and close delimit a subtree. The rank of leaf pairs ``()`` between them counts its leaves,
and the cumulative array of savings in preorder gives the tokens it saves. The spines that neighbouring shards share are merged by an
aggregation: what a shard says of a chain is a part that adds up. A chain's own saving counts in the shard that has the path of its
smallest member, which is one.

Defined results: turns are ordered by turn (null first), role, text; null roles or texts are empty. Rows without conversation id belong
to none and are left out; rows that repeat a turn are turns of their own. Conversations without turns end at the root. Other columns are
ignored; an empty table gives no nodes, not even a root. Ids are whole numbers, others are an error. Turns are compared by 128 bits of
hash. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_sql, heavy_light_join, table, whole_ids, written

#: Turns of a conversation that are numbered and summed together; ids of one node's ends that are joined together.
BLOCK, CHUNK = 1024, 4096
#: Chains that a shard's parentheses are made of at a time, and parentheses in a block of the range min-max tree.
HELD, EXCESS_BLOCK = 50_000, 256
KEY = ("depth", "k1", "k2")


def numbered(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, at, d1, d2, words): every turn with its place from 0, its hashes and its words.

    A conversation is numbered by blocks of its turn numbers, so that a very long one is not sorted in one task.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("block", F.expr(f"turn div {BLOCK}"))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")).cast("long")
    rows = rows.select("conv_id", "block", (F.row_number().over(inside) - 1).cast("long").alias("i"), F.xxhash64("role", "text").alias("d1"), F.xxhash64(F.lit("turn"), "text", "role").alias("d2"), words.alias("words"))
    rows = written(rows, "turns")
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where("before > 0")
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "before")
    same = (F.col("conv_id") == F.col("c")) & (F.col("block") == F.col("b"))  # a null block is the first, nothing comes before it
    return rows.join(blocks, same, "left").select("conv_id", (F.col("i") + F.coalesce("before", F.lit(0))).alias("at"), "d1", "d2", "words")


def with_shared_heads(turns: DataFrame) -> DataFrame:
    """Rebuilt conversations, as turns: the first h turns of conversation c - c % 20, then the own turns after the first h, where h is
    crc32 of the id, mod 4. Without a first part a conversation has a row of place null, so that none is lost when it has no turns.
    """
    heads = turns.where("conv_id % 20 = 0 and at < 3").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "d1", "d2", "words"))).alias("head"))
    ids = turns.groupBy("conv_id").agg(F.min("at").alias("none")).select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int").alias("h"))
    ids = ids.join(heads.withColumnRenamed("conv_id", "of"), F.col("base") == F.col("of"), "left")
    ids = written(ids.select("conv_id", F.col("h").cast("long").alias("h"), F.slice(F.coalesce("head", F.array().cast("array<struct<at:long,d1:long,d2:long,words:long>>")), 1, F.col("h")).alias("head")), "heads")
    own = turns.join(ids.select("conv_id", "h", F.size("head").cast("long").alias("taken")), "conv_id").where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "d1", "d2", "words")
    return own.unionByName(ids.select("conv_id", F.explode_outer("head").alias("t")).select("conv_id", "t.*"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, t1, t2, words, sum, last): all prefixes of all conversations, from the empty one on.

    ``k`` are the hashes of the prefix, ``t`` of its last turn at its place, ``sum`` its words, ``last`` whether the conversation ends here.
    """
    steps = turns.where("at is not null").select("conv_id", (F.col("at") + 1).alias("depth"), F.xxhash64("d1", "d2", "at").alias("t1"), F.xxhash64("at", "d2", "d1").alias("t2"), "words")
    ids = turns.groupBy("conv_id").agg(F.coalesce(F.max("at") + 1, F.lit(0)).alias("length"))
    none = [F.lit(0).cast("long").alias(c) for c in ("depth", "t1", "t2", "words")]
    rows = steps.unionByName(ids.select("conv_id", *none)).withColumn("block", F.expr(f"depth div {BLOCK}"))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth")
    running = [F.expr("bit_xor(t1)").over(inside).alias("k1"), F.expr("bit_xor(t2)").over(inside).alias("k2"), F.sum("words").over(inside).alias("sum")]
    rows = written(rows.select("conv_id", "block", "depth", "t1", "t2", "words", *running), "steps")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.expr("bit_xor(t1)").alias("b1"), F.expr("bit_xor(t2)").alias("b2"), F.sum("words").alias("bs"))
    blocks = blocks.select("conv_id", "block", F.expr("bit_xor(b1)").over(before).alias("b1"), F.expr("bit_xor(b2)").over(before).alias("b2"), F.sum("bs").over(before).alias("bs")).where("block > 0")
    rows = rows.join(blocks, ["conv_id", "block"], "left").join(ids, "conv_id")
    zero = F.lit(0)
    return rows.select(
        "conv_id", "depth", F.col("k1").bitwiseXOR(F.coalesce("b1", zero)).alias("k1"), F.col("k2").bitwiseXOR(F.coalesce("b2", zero)).alias("k2"), "t1", "t2", "words",
        (F.col("sum") + F.coalesce("bs", zero)).alias("sum"), (F.col("depth") == F.col("length")).alias("last"),
    )


class Parentheses:
    """A trie in preorder as balanced parentheses, with a range min-max tree of two levels over its excess."""

    def __init__(self, opens: np.ndarray, block: int = EXCESS_BLOCK):
        self.opens, self.block = opens, block
        self.excess = np.cumsum(np.where(opens, 1, -1))
        size = len(opens)
        pad = np.concatenate([self.excess, np.full(-size % block, self.excess[-1] if size else 0)]).reshape(-1, block)
        self.low, self.high = pad.min(axis=1), pad.max(axis=1)
        over = -len(self.low) % block
        self.low2 = np.concatenate([self.low, np.repeat(self.low[-1:], over)]).reshape(-1, block).min(axis=1)
        self.high2 = np.concatenate([self.high, np.repeat(self.high[-1:], over)]).reshape(-1, block).max(axis=1)
        pairs = np.zeros(size, bool)
        pairs[:-1] = opens[:-1] & ~opens[1:]
        self.leaf_rank = np.concatenate([[0], np.cumsum(pairs)])
        self.open_rank = np.concatenate([[0], np.cumsum(opens)])

    def findclose(self, at: int) -> int:
        """The place of the parenthesis that closes the one opened at ``at``: the first behind it with less excess."""
        wanted, block = int(self.excess[at]) - 1, at // self.block

        def inside(b: int, first: int) -> int:
            found = np.flatnonzero(self.excess[first : (b + 1) * self.block] == wanted)
            return first + int(found[0]) if len(found) else -1

        if (found := inside(block, at + 1)) >= 0:
            return found
        block += 1
        reaches = lambda low, high: (low <= wanted) & (wanted <= high)
        run_end = -(-block // self.block) * self.block
        ahead = np.flatnonzero(reaches(self.low[block:run_end], self.high[block:run_end]))
        if not len(ahead):
            run = run_end // self.block + int(np.flatnonzero(reaches(self.low2[run_end // self.block :], self.high2[run_end // self.block :]))[0])
            block = run * self.block
            ahead = np.flatnonzero(reaches(self.low[block : block + self.block], self.high[block : block + self.block]))
        block += int(ahead[0])
        return inside(block, block * self.block)

    def leaves(self, at: int, close: int) -> int:
        return int(self.leaf_rank[close] - self.leaf_rank[at])


def shard_parts(paths: list[tuple[list[tuple], int]]) -> list[tuple]:
    """(k1, k2, leaves, saved) of the chains of sorted paths, each a list of (k1, k2, smallest member, saving, is a leaf) and the
    conversation it stands for. A path may be the beginning of the next; a chain that ends in another shard is no leaf here."""
    opens: list[bool] = []
    chains: list[tuple] = []
    savings: list[int] = []
    stack: list[tuple] = []
    for path, conv in paths:
        keys = [c[:2] for c in path]
        common = 0
        while common < min(len(stack), len(keys)) and stack[common][0] == keys[common]:
            common += 1
        opens += [False] * (len(stack) - common)
        del stack[common:]
        for entry in path[common:]:
            stack.append((entry[:2], len(chains)))
            opens.append(True)
            chains.append(entry)
            savings.append(0)
        for (_, i), entry in zip(stack, path):
            if entry[2] == conv:
                savings[i] = entry[3]
    opens += [False] * len(stack)
    trie = Parentheses(np.array(opens, bool))
    before = np.concatenate([np.zeros(1, object), np.cumsum(np.array(savings, object))]) if savings else np.zeros(1, object)
    # Leaf pairs that are no leaves of the whole trie: the last path of a shard may go on in the next one.
    false = np.concatenate([[0], np.cumsum([bool(n == 1 and not c[4]) for n, c in zip(_sizes(trie, opens), chains)])]).astype(np.int64)
    out = []
    for i, at in enumerate(np.flatnonzero(trie.opens).tolist()):
        close = trie.findclose(at)
        end = int(trie.open_rank[close])
        out.append((*chains[i][:2], trie.leaves(at, close) - int(false[end] - false[i]), int(before[end] - before[i])))
    return out


def _sizes(trie: Parentheses, opens: list[bool]) -> Iterator[int]:
    """1 for a pair, 2 for anything that holds more, in preorder."""
    for at in np.flatnonzero(trie.opens).tolist():
        yield 1 if not opens[at + 1] else 2


def chain_parts(paths: DataFrame) -> DataFrame:
    """(k1, k2, leaves, saved) summed over shards, of (conv, path) with path an array of chains from the root on."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[tuple], int]] = []
        count = 0

        def flushed() -> pa.RecordBatch:
            rows = shard_parts(held)
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["k1", "k2", "leaves", "saved"])

        for batch in batches:
            for row in batch.to_pylist():
                held.append(([tuple(c[x] for x in ("k1", "k2", "rep", "saving", "leaf")) for c in row["path"]], row["conv"]))
                count += len(row["path"])
                if count >= HELD:
                    yield flushed()
                    held, count = [], 0
        if held:
            yield flushed()

    dealt = paths.repartitionByRange("path").sortWithinPartitions("path")
    parts = dealt.mapInArrow(of_batches, "k1 long, k2 long, leaves long, saved long")
    return parts.groupBy("k1", "k2").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, digest) of (depth, k1, k2, conv_id): SHA-256 of the sorted ids joined by commas.

    Ids are joined in chunks of a range first; the chunks of a node then stream through one hash, whatever their number.
    """
    chunks = ends.groupBy(*KEY, F.expr(f"conv_id div {CHUNK}").alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        for batch in batches:
            done = []
            for *own, ids in zip(*[batch.column(c).to_pylist() for c in (*KEY, "ids")]):
                if own != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = own, sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield made(done)
        if key is not None:
            yield made([(*key, digest.hexdigest())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [*[pa.int64()] * 3, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], names=[*KEY, "digest"])

    dealt = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk")
    return dealt.mapInArrow(of_batches, "depth long, k1 long, k2 long, digest string")


def trie_of(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of (conv_id, at, d1, d2, words)."""
    rows = written(prefixes(turns), "prefixes")
    grouped = rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("words").alias("words"), F.min("sum").alias("sum"), F.min("t1").alias("t1"), F.min("t2").alias("t2"),
        F.min(F.when(F.col("last"), F.col("conv_id"))).alias("end_rep"),
    )
    parent = [(F.col("depth") - 1).alias("pd"), F.col("k1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("t2")).alias("p2")]
    nodes = written(grouped.select(*KEY, "rep", "n", "words", "sum", "end_rep", *parent), "nodes")

    # Parents: the number of children is known before the join, so that parents of very many are broadcast.
    counts = nodes.where("depth > 0").groupBy(F.col("pd").alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("children"))
    nodes = nodes.join(counts, list(KEY), "left").withColumn("children", F.coalesce("children", F.lit(0)))
    nodes = written(nodes, "nodes")
    parents = nodes.where("children > 0").select(F.struct(*KEY).alias("parent"), F.col("rep").alias("parent_rep"), F.col("n").alias("parent_n"), "children")
    total = nodes.agg(F.sum("children")).first()[0] or 0
    child = nodes.where("depth > 0").withColumn("parent", F.struct(F.col("pd").alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")))
    child = heavy_light_join(child, parents.withColumnRenamed("children", "own"), "parent", "own", total).drop("parent", "own")
    root = nodes.where("depth = 0").withColumns({"parent_rep": F.lit(None).cast("long"), "parent_n": F.lit(None).cast("long")})
    nodes = written(child.unionByName(root).drop("pd", "p1", "p2"), "nodes")

    # Chains: a node tops one where its parent has other members too. Their savings are those of all their nodes.
    shared = nodes.where("n > 1")
    chains = shared.groupBy("rep", "n").agg(
        F.min(F.struct("depth", "k1", "k2")).alias("top"), F.sum("words").alias("words"), F.min(F.col("sum") - F.col("words")).alias("above"), F.min("children").alias("fewest"), F.count(F.lit(1)).alias("nodes")
    )
    chains = written(chains, "chains")
    alone = nodes.where("n = 1 and (parent_n > 1 or parent_n is null)").select("rep", "depth", F.struct("depth", "k1", "k2", "rep", F.lit(0).cast("long").alias("saving"), F.lit(True).alias("leaf")).alias("c"))
    entry = F.struct("top.depth", "top.k1", "top.k2", "rep", ((F.col("n") - 1) * F.col("words")).alias("saving"), (F.col("fewest") == 0).alias("leaf"))
    tops = chains.select(F.col("top").alias("node"), entry.alias("c"), "n")

    # Paths: of each distinct sequence of turns, its smallest conversation and the chains it goes through.
    paths_of = nodes.where("end_rep is not null").select(F.col("end_rep").alias("conv_id"))
    reps = rows.select("conv_id", F.struct(*KEY).alias("node")).join(paths_of, "conv_id", "left_semi")
    on_shared = heavy_light_join(reps, tops, "node", "n", chains.agg(F.sum(F.col("n"))).first()[0] or 0).select("conv_id", "c")
    steps = on_shared.unionByName(alone.select(F.col("rep").alias("conv_id"), "c"))
    paths = written(steps.groupBy("conv_id").agg(F.sort_array(F.collect_list("c")).alias("path")).select(F.col("conv_id").alias("conv"), "path"), "paths")
    parts = chain_parts(paths)

    # Back to the nodes: of a chain's saving, what its nodes above do not have.
    totals = chains.select("rep", "n", "above", "nodes", F.col("top.k1").alias("k1"), F.col("top.k2").alias("k2")).join(parts, ["k1", "k2"])
    totals = written(totals.select(F.struct("rep", "n").alias("chain"), "above", "nodes", "leaves", "saved"), "totals")
    of_shared = heavy_light_join(shared.withColumn("chain", F.struct("rep", "n")), totals, "chain", "nodes", totals.agg(F.sum("nodes")).first()[0] or 0)
    saved = F.col("saved") - (F.col("n") - 1) * (F.col("sum") - F.col("words") - F.col("above"))
    keep = [*KEY, "rep", "parent_rep", "n", "children", "end_rep"]
    one = F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")
    nodes = of_shared.select(*keep, "leaves", saved.alias("saved")).unionByName(nodes.where("n = 1").select(*keep, *one))
    digests = end_digests(rows.where("last").select(*KEY, "conv_id"))
    nodes = nodes.join(digests, list(KEY), "left")
    return nodes.select(
        F.col("rep").alias("conv_id"), "depth", F.col("parent_rep").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rebuild=None) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node.

    ``rebuild`` changes the numbered turns first (a function from (conv_id, at, d1, d2, words) to the same columns).
    """
    whole_ids(conversations, id_col)
    turns = numbered(conversations, id_col, turn_col, role_col, text_col)
    return trie_of(written(rebuild(turns) if rebuild else turns, "turns"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), rebuild=with_shared_heads)


ORACLE_SQL = rf"""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
           FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, count(*) AS turns, conv_id - conv_id % 20 AS base, {crc32_sql("conv_id")} % 4 AS h FROM o GROUP BY conv_id),
taken AS (SELECT x.conv_id, least(x.h, coalesce(y.turns, 0)) AS taken FROM c x LEFT JOIN c y ON y.conv_id = x.base),
b AS (SELECT c.conv_id, o.i, role, text FROM c JOIN o ON o.conv_id = c.base AND o.i <= c.h
      UNION ALL SELECT c.conv_id, o.i - c.h + taken, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.i > c.h JOIN taken t ON t.conv_id = c.conv_id),
p AS (SELECT conv_id, i AS depth, string_agg(md5(md5(role) || md5(text)), '') OVER (PARTITION BY conv_id ORDER BY i) AS path,
             len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words FROM b
      UNION ALL SELECT conv_id, 0, '', 0 FROM c),
e AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(path, depth) AS path FROM p GROUP BY conv_id) GROUP BY path),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words FROM p GROUP BY path, depth),
k AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN k USING (path)),
s AS (SELECT path, count(*) FILTER (children = 0) AS leaves, sum((n - 1) * words) AS saved
      FROM (SELECT n, words, children, left(path, 32 * unnest(range(depth + 1))) AS path FROM m) GROUP BY path)
SELECT m.conv_id::BIGINT AS conv_id, m.depth::BIGINT AS depth, u.conv_id::BIGINT AS parent_conv_id, m.n::BIGINT AS n_convs, m.children::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM m JOIN s USING (path) LEFT JOIN e USING (path) LEFT JOIN n u ON m.depth > 0 AND u.path = left(m.path, 32 * (m.depth - 1))
"""
