"""Windows over keys that may own a large part of all rows, computed range by range and joined at the seams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

RANGE = "_range"


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``_range``: rows of a range lie next to each other in ``order``, lower ranges come first, and rows that are equal in
    ``order`` share one. A key that leads ``order`` is spread over as many ranges as its rows fill, so a window by key and range
    holds no more than a range. Bounds come from a sample, so the rows are written once: whatever reads them sees the same ranges.
    """
    return written(df.sparkSession, df.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id()), "ranges")
