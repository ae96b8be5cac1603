"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Space and the control characters tab to carriage return.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is.

    A text without multi-byte characters takes the fast built-in; ``translate`` handles the rest.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, one of our own will do for a
    local master only: on a cluster every machine would write to a disk of its own, which is an error.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read back: lineage ends there.

    Written rather than cached, so that a lost executor costs no recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def heavy_light_join(left: DataFrame, counts: DataFrame, key: str, n: str, total: int, max_heavy: int = 20_000) -> DataFrame:
    """Inner join of ``left`` with ``counts`` on ``key``, safe when a few keys own most rows of ``left``.

    ``counts[n]`` is the number of rows of ``left`` with that key and ``total`` their sum, so at most ``max_heavy`` keys
    have more than ``total / max_heavy`` rows: these are broadcast (a proven bound) and never shuffled. The other keys are
    each too small to make a partition uneven and take an ordinary shuffled join.
    """
    bound = total / max_heavy
    heavy = F.broadcast(counts.where(F.col(n) > bound))
    light = counts.where(F.col(n) <= bound)
    return left.join(heavy, key).unionByName(left.join(light, key))


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``."""
    return F.crc32(doc_id.cast("string")) % m


def whole_ids(docs: DataFrame, id_col: str) -> None:
    """Raises where ids are no whole numbers: an operator that orders or compares them as such never casts others to nulls."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} has to be a whole number, not {kind.simpleString()}")


def without(docs: DataFrame, gone: DataFrame, id_col: str, max_sent: int = 1_000_000) -> DataFrame:
    """``docs`` without the ids of ``gone`` (one column, no nulls): broadcast while their checked number is small, shuffled beyond."""
    gone = written(gone.distinct(), "gone")
    few = gone.limit(max_sent + 1).count() <= max_sent
    return docs.join(F.broadcast(gone) if few else gone, docs[id_col] == gone[gone.columns[0]], "left_anti")


def crc32_sql(number: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a number's decimal text, a bit at a time: that dialect has no function for it."""
    step = "list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, byte))"
    digits = f"list_transform(string_split(({number})::VARCHAR, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce({digits}, lambda crc, byte: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"
