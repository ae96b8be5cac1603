"""Secret scan by a trigram inverted index.

Each rule is a regular expression. Its Boolean trigram query (see ``trigrams``) names the trigrams that a match needs. The
index holds postings (trigram, document) of just those trigrams; postings that meet all trigrams of an alternative make a
document a candidate of the rule, and only candidates are scanned with the regular expression. Rules whose expression has no
mandatory trigram scan every document.

Spans are code points, end exclusive, leftmost and non-overlapping per kind. Kinds other than the first three are this
operator's own.

Defined results: a null text is empty and has no spans. Rows that repeat a ``doc_id`` each get a result; rows that repeat
both id and text are one. Other columns are ignored; an empty table gives no rows. Whole texts are scanned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, table
from .trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """``regex`` finds the matches; ``group`` of a match must have ``least`` characters, or the match is dropped."""

    kind: str
    regex: str
    least: int = 0
    group: int = 0


BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES


def postings(docs: DataFrame, trigrams: list[str], text_col: str = "text") -> DataFrame:
    """The inverted index of ``trigrams`` over A-Z-folded texts: the other columns of ``docs`` and ``trigram``."""
    others = [c for c in docs.columns if c != text_col]
    folded = docs.select(*others, ascii_lower(F.col(text_col)).alias("folded"))
    there = F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in trigrams])
    return folded.select(*others, F.explode(F.array_compact(there)).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame | None, list[str]]:
    """(doc_id, text_hash, kinds) of the documents that can match, and the kinds of the rules that scan every document."""
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    full = [kind for kind, q in queries.items() if frozenset() in q]
    needs = [(kind, alt, t) for kind, q in queries.items() if kind not in full for alt, group in enumerate(sorted(map(sorted, q))) for t in group]
    if not needs:
        return None, full
    wanted = docs.sparkSession.createDataFrame(needs, "kind string, alt int, trigram string")
    wanted = wanted.join(wanted.groupBy("kind", "alt").agg(F.count(F.lit(1)).alias("needed")), ["kind", "alt"])
    met = (
        postings(docs, sorted({t for *_, t in needs}))
        .join(F.broadcast(wanted), "trigram")  # a row for each trigram of the rules' queries
        .groupBy("doc_id", "text_hash", "kind", "alt", "needed")
        .agg(F.countDistinct("trigram").alias("n"))
        .where(F.col("n") == F.col("needed"))
    )
    return met.groupBy("doc_id", "text_hash").agg(F.collect_set("kind").alias("kinds")), full


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, an array of (start, rank of the kind, end, kind) in order, one row per document."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("text_hash", F.xxhash64("text"))
    found, full = candidates(base, rules)
    if found is None:
        joined = base.withColumn("kinds", F.lit(None).cast("array<string>"))
    else:
        found = found.select(F.col("doc_id").alias("d_id"), F.col("text_hash").alias("d_hash"), "kinds")
        joined = base.join(found, base.doc_id.eqNullSafe(found.d_id) & (base.text_hash == found.d_hash), "left")

    def pieces(rank: int, rule: Rule) -> Column:
        """The lengths of the gap before each match, of the match, and of the group that has to be long enough."""
        matches, gaps = F.regexp_extract_all("text", F.lit(rule.regex), F.lit(0)), F.split("text", rule.regex, -1)
        group = lambda m: F.regexp_extract(m, rule.regex, rule.group) if rule.group else m
        sizes = F.zip_with(gaps, matches, lambda g, m: F.when(m.isNotNull(), F.struct(F.length(g).alias("gap"), F.length(m).alias("long"), F.length(group(m)).alias("checked"))))
        scan = F.lit(True) if rule.kind in full else F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        return F.when(scan & F.col("text").rlike(rule.regex), F.struct(F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), F.lit(rule.least).alias("least"), sizes.alias("sizes")))

    by_kind = joined.select("doc_id", "text_hash", F.explode_outer(F.array_compact(F.array(*[pieces(i, r) for i, r in enumerate(rules)]))).alias("s"))
    by_match = by_kind.select("doc_id", "text_hash", "s.rank", "s.kind", "s.least", F.posexplode_outer("s.sizes").alias("k", "m"))
    so_far = Window.partitionBy("doc_id", "text_hash", "rank").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ends = by_match.where(F.col("k").isNull() | F.col("m").isNotNull()).dropDuplicates(["doc_id", "text_hash", "rank", "k"])
    ends = ends.withColumn("end", F.sum(F.col("m.gap") + F.col("m.long")).over(so_far))
    span = F.struct((F.col("end") - F.col("m.long")).alias("start"), "rank", "end", "kind")
    return ends.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.when(F.col("m.checked") >= F.col("least"), span))).alias("spans")).drop("text_hash")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_spans(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    base = F.filter("spans", lambda s: s.kind.isin([r.kind for r in BASE_RULES]))
    return out.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def _oracle() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    kinds = []
    for rank, r in enumerate(RULES):
        # DuckDB folds non-ASCII letters with (?i), so its keywords are spelled out in either case.
        rx = quoted(r.regex.replace("(?i:(password|passwd|secret|token|api_?key))", "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"))
        kinds.append(f"SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, {rx}) AS ms, regexp_extract_all(t, {rx}, {r.group}) AS gs, string_split_regex(t, {rx}) AS gaps FROM d")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(kinds)}),
e AS (SELECT doc_id, rank, kind, least, unnest(ms) AS x, unnest(gs) AS g, generate_subscripts(ms, 1) AS k, gaps FROM m WHERE len(ms) > 0),
p AS (SELECT *, sum(length(gaps[k]) + length(x)) OVER (PARTITION BY doc_id, rank ORDER BY k)::BIGINT AS stop FROM e),
s AS (SELECT doc_id, rank, kind, stop - length(x) AS start, kind || ':' || (stop - length(x)) || ':' || stop AS said FROM p WHERE length(g) >= least),
a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
             count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(said, ',' ORDER BY start, rank) FILTER (WHERE rank < {len(BASE_RULES)}) AS base,
             string_agg(said, ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


ORACLE_SQL = _oracle()
