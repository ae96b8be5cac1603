"""Pages of positioned tokens back into grids, so that the readers of spreadsheets can read them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_grid(runs: DataFrame, by: list[str], gap: float = 6.0, least_x: float | None = None) -> DataFrame:
    """(by, row_no, col_no, value) of (by, line_no, x, text).

    Columns come from the whole page and not from its heading, whose cells may be empty, wrapped or centred: wherever the next position
    is more than ``gap`` further right, a column begins. A token belongs to the last column that begins at or before it, give or take one
    point; tokens of one cell are joined in order. Rows are numbered as the page's lines are; what is left of ``least_x`` is a margin.

    The columns of a page go to its tokens as one short array, so no token meets every column in a join.
    """
    kept = runs.where(F.trim("text") != "")
    if least_x is not None:
        kept = kept.where(F.col("x") >= least_x)
    places = kept.groupBy(*by).agg(F.array_sort(F.collect_set("x")).alias("xs"))
    begins = F.filter("xs", lambda x, i: (i == 0) | (x - F.get("xs", F.when(i > 0, i - 1).otherwise(0)) > gap))
    starts = places.select(*by, begins.alias("starts"))
    column = F.greatest(F.size(F.filter("starts", lambda s: s <= F.col("x") + 1)) - 1, F.lit(0))
    placed = kept.join(starts, by).select(*by, F.col("line_no").alias("row_no"), column.alias("col_no"), F.struct("x", F.trim("text").alias("t")).alias("run"))
    cells = placed.groupBy(*by, "row_no", "col_no").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    return cells.select(*by, "row_no", "col_no", F.array_join(F.transform("runs", lambda r: r.t), " ").alias("value"))
