"""Boundaries of grids that have no pixels yet, from the sizes of their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("column", "row")


def layout(cells: DataFrame, char_width: int = 7, line_height: int = 12, padding: tuple[int, int] = (12, 6), least: tuple[int, int] = (40, 20)) -> DataFrame:
    """(table_id, axis, edges): cumulative boundaries of columns and of rows, from 0.

    cells(table_id, row_idx, col_idx, text). A text takes char_width a character and one line; empty cells take nothing, and
    columns and rows without texts the least size. Sizes are combined before the first shuffle.
    """
    text = F.coalesce("text", F.lit(""))
    size = lambda full, pad, low: F.when(text == "", F.lit(low)).otherwise(F.greatest(F.lit(low), full + 2 * pad))
    wide = F.struct(F.lit(AXES[0]).alias("axis"), F.col("col_idx").alias("idx"), size(F.length(text) * char_width, padding[0], least[0]).alias("size"))
    high = F.struct(F.lit(AXES[1]).alias("axis"), F.col("row_idx").alias("idx"), size(F.lit(line_height), padding[1], least[1]).alias("size"))
    sizes = cells.select("table_id", F.explode(F.array(wide, high)).alias("s")).groupBy("table_id", "s.axis", "s.idx").agg(F.max("s.size").alias("size"))
    one = sizes.groupBy("table_id", "axis").agg(F.map_from_entries(F.collect_list(F.struct("idx", "size"))).alias("m"), F.max("idx").alias("n"))
    low = F.when(F.col("axis") == AXES[0], least[0]).otherwise(least[1])
    step = lambda edges, i: F.concat(edges, F.array(F.element_at(edges, -1) + F.coalesce(F.try_element_at("m", i), low)))
    return one.select("table_id", "axis", F.aggregate(F.sequence(F.lit(0), F.col("n").cast("int")), F.array(F.lit(0)), step).alias("edges"))
