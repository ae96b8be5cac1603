"""Line dedup: lines that many documents share are kept in one document only.

Lines are exploded with their positions, normalised and hashed (128 bits); documents are counted per hash; lines of hashes
over the threshold are dropped except in the largest ``doc_id`` that holds them; what is left is put together by position.

Defined results: a null or empty text is one empty line. A document is a ``doc_id``: rows that repeat one count once, and
each row still gets its own result. Rows whose ``doc_id`` is null count as no document and own no line. Other columns are
ignored. An empty table gives an empty result. Texts of any length are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, heavy_light_join, table, written

MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, the kept text, and ``others`` (a struct of the other columns), one row per row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.split(text, "\n", -1).alias("lines"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)], F.lit(0).alias("_")).alias("others"),
    )

    def hashed(line: Column) -> Column:
        # Keys are never longer than their lines, so most short lines need no key at all.
        return F.when((F.length(line) >= min_chars) & (F.length(line_key(line)) >= min_chars), F.md5(line_key(line)))

    lines = (
        base.select("doc_id", "text_hash", F.posexplode(F.transform("lines", hashed)).alias("pos", "md5"))
        .where(F.col("md5").isNotNull())
        .select("doc_id", "text_hash", "pos", F.unhex("md5").alias("key"))
    )
    shared = written(
        lines.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs),
        "shared-lines",
    )
    total = shared.agg(F.sum("n_rows")).first()[0] or 0
    dropped = (
        heavy_light_join(lines, shared, "key", "n_rows", total)
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("pos").alias("dropped"))
        .select(F.col("doc_id").alias("d_id"), F.col("text_hash").alias("d_hash"), "dropped")
    )
    joined = base.join(dropped, base.doc_id.eqNullSafe(dropped.d_id) & (base.text_hash == dropped.d_hash), "left")
    none = F.array().cast("array<int>")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("dropped", none))
    return joined.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.coalesce("dropped", none)).cast("long").alias("n_dropped"),
        F.array_join(F.transform(kept, lambda i: F.col("lines")[i]), "\n").alias("kept_text"),
        "others",
    )


def with_lines_dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", **settings: int) -> DataFrame:
    """``docs`` with the kept texts (and their lengths, where there is such a column); no document goes."""
    out = line_dedup(docs, id_col, text_col, **settings)
    new = {id_col: F.col("doc_id"), text_col: F.col("kept_text"), length_col: F.length("kept_text").cast("long")}
    return out.select(*[(new[c] if c in new else F.col(f"others.`{c}`")).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
