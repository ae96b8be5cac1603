"""Benchmark decontamination: find the words of documents that lie in passages of benchmark items.

The windows of the benchmark (13 consecutive words, or a whole shorter item) are hashed, and the hashes are broadcast while
their checked number stays under ``max_broadcast`` (12 bytes each), and joined by shuffle beyond. One pass over the documents
hashes the windows of all lengths and counts the words; what leaves it is a row for each document and for each hit. Hits are then
verified word by word, for which only the documents with hits are read again and cut into words.

Defined results: null text has no words; an item without words has no window; equal items and windows share their hits. An
item whose ``item_id`` is null marks words but is in no list of items. Rows that repeat a ``doc_id`` with different texts each
get a result; rows that repeat both id and text are one. A null ``doc_id`` is an id like any other. Other columns are ignored;
an empty table of either kind gives no hits or no rows. Long texts are cut into blocks of words that overlap by a window, so no
row of the scan grows with its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, written

WINDOW, BLOCK = 13, 4_096
#: Rows that are broadcast at most: hashes of windows; windows with their words and items, and hits, while they have no more bytes.
MAX_BROADCAST, MAX_BYTES = 1_000_000, 64 << 20
#: What separates words, after A-Z were lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS, -1)
    return F.filter(parts, lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """One row per distinct window: len, h, words (joined by blanks), items."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("ws")).where(F.size("ws") > 0)
    size = F.least(F.size("ws"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("ws") - size + 1)
    return (
        items.select("item_id", size.alias("len"), F.explode(F.transform(starts, lambda i: F.slice("ws", i, size))).alias("w"))
        .groupBy("len", F.array_join("w", " ").alias("words"))
        .agg(F.collect_set("item_id").alias("items"), F.first("w").alias("w"))
        .select("len", F.xxhash64(F.transform("w", lambda x: F.xxhash64(x))).alias("h"), "words", "items")
    )


def _few(df: DataFrame, size: Column, most: int) -> DataFrame:
    """``df`` as a broadcast if it has no more than ``most`` rows and ``MAX_BYTES``; ``df`` is a written table."""
    n, total = df.agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    return F.broadcast(df) if n <= most and (total or 0) <= MAX_BYTES else df.hint("shuffle_merge")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, items and the hit spans (array of first word, words), one row per id and text."""
    windows = written(benchmark_windows(benchmark, item_col, item_text_col, window), "windows")
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())  # no more than ``window`` rows
    hashes = _few(written(windows.select("len", "h").distinct(), "hashes"), F.lit(12), max_broadcast)
    windows = _few(windows, F.octet_length("words") + 16 * F.size("items"), max_broadcast)

    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    key = ["doc_id", "text_hash"]
    found = written(_scan(base, hashes, lengths), "found")
    counts = found.where("len = 0").groupBy(*key).agg(F.max(-1 - F.col("pos")).alias("n_words"))

    hits = found.where("len > 0").groupBy(*key).agg(F.collect_set(F.struct("pos", "len", "h")).alias("hits"))
    hits = _few(written(hits.select(F.col("doc_id").alias("d_id"), F.col("text_hash").alias("d_hash"), "hits"), "hits"), 16 + 16 * F.size("hits"), max_broadcast)
    again = base.join(hits, base.doc_id.eqNullSafe(hits.d_id) & (base.text_hash == hits.d_hash)).dropDuplicates(key)
    again = again.select(*key, "hits", words_of(F.col("text")).alias("ws"))

    def cited(hit: Column) -> Column:
        return F.struct(hit.pos.alias("pos"), hit.len.alias("len"), hit.h.alias("h"), F.array_join(F.slice("ws", hit.pos + 1, hit.len), " ").alias("words"))

    claims = again.select(*key, F.explode(F.transform("hits", cited)).alias("hit")).select(*key, "hit.*")
    verified = claims.join(windows, ["len", "h", "words"]).groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("pos", "len"))).alias("spans"), F.collect_set("items").alias("items"))
    verified = verified.select(F.col("doc_id").alias("d_id"), F.col("text_hash").alias("d_hash"), "spans", F.array_distinct(F.flatten("items")).alias("items"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s.pos, s.pos + s.len - 1))))).cast("long")
    item = dict(verified.dtypes)["items"]
    return counts.join(verified, counts.doc_id.eqNullSafe(verified.d_id) & (counts.text_hash == verified.d_hash), "left").select(
        *key,
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce(hit, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast(item)).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<pos:int,len:int>>")).alias("spans"),
    )


def _scan(base: DataFrame, hashes: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, text_hash, pos, len, h) of the document windows whose hash is that of a benchmark window, and for each document a
    row of length 0 whose ``pos`` is -1 - the number of its words. All lengths are hashed in one pass.
    """
    most = max(lengths, default=1)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws"), F.lit(1)), F.lit(BLOCK))
    blocks = base.select("doc_id", "text_hash", words_of(F.col("text")).alias("ws")).select(
        "doc_id",
        "text_hash",
        F.explode(
            F.transform(
                starts,
                lambda s: F.struct(
                    (s - 1).alias("at"),
                    F.when(s == 1, F.size("ws")).alias("n_words"),
                    F.transform(F.slice("ws", s, BLOCK + most - 1), lambda w: F.xxhash64(w)).alias("hs"),
                ),
            )
        ).alias("b"),
    ).select("doc_id", "text_hash", "b.*")

    def of_length(k: int) -> Column:
        n = F.least(F.size("hs") - k + 1, F.lit(BLOCK))
        row = lambda i: F.struct((F.col("at") + i - 1).alias("pos"), F.lit(k).alias("len"), F.xxhash64(F.slice("hs", i, k)).alias("h"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), row)).otherwise(F.array().cast("array<struct<pos:int,len:int,h:bigint>>"))

    # The document's own row is in no list of windows; its key is spread like theirs, and the outer join keeps it.
    own = F.when(F.col("n_words").isNotNull(), F.array(F.struct((-1 - F.col("n_words")).alias("pos"), F.lit(0).alias("len"), F.col("text_hash").alias("h")))).otherwise(F.array().cast("array<struct<pos:int,len:int,h:bigint>>"))
    rows = blocks.select("doc_id", "text_hash", F.explode(F.concat(own, *[of_length(k) for k in lengths])).alias("w")).select("doc_id", "text_hash", "w.*")
    known = hashes.withColumnsRenamed({"len": "k_len", "h": "k_h"})
    met = rows.join(known, (F.col("len") == F.col("k_len")) & (F.col("h") == F.col("k_h")), "left")
    return met.where("len = 0 or k_len is not null").select(*rows.columns)


def decontaminated(result: DataFrame) -> DataFrame:
    """Adds ``contaminated``: some word is hit, and at least a twentieth of all words are."""
    return result.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` without contaminated documents; where rows repeat an id, each goes or stays by its own text."""
    result = decontaminated(decontaminate(docs, benchmark, id_col, text_col, **settings))
    gone = written(result.where("contaminated").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")), "gone")
    gone = _few(gone, F.lit(16), MAX_BROADCAST)
    own = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(gone, docs[id_col].eqNullSafe(gone.gone_id) & (own == gone.gone_hash), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminated(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated",
    )


_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

ORACLE_SQL = f"""
WITH items AS (
  SELECT item_id, ws, least(len(ws), 13) AS k FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0
), windows AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS w
  FROM (SELECT item_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM items)
), docs AS (
  SELECT doc_id, {_WORDS} AS ws FROM documents
), found AS (
  SELECT d.doc_id, d.i, d.k, w.item_id
  FROM (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS w
        FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i
              FROM docs, (SELECT DISTINCT k FROM windows))) d
  JOIN windows w ON w.k = d.k AND w.w = d.w
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM found)) GROUP BY doc_id
), cited AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(d.ws), false) AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN cited USING (doc_id)
"""
