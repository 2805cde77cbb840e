"""Running values within groups of any size: a scan of each range of the sorted rows, and a carry from range to range.

A window by key sorts each group in one task. Here the rows are sorted into ranges that cut through groups, each range is scanned on
its own, and what a group brings along from the ranges before is worked out on a table of one row a range. Few groups need
that: ``hot_groups`` tells those above HOT_ROWS, and the callers give all others to plain windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, written

#: Rows of a group from which on it is scanned in ranges.
HOT_ROWS = 1_000_000
#: Bits of monotonically_increasing_id that count within a partition.
WITHIN = 33


def same_key(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in by))


def split_hot(rows: DataFrame, by: list[str], hot: int = HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups up to ``hot`` rows, rows of larger ones or None where there are none); null keys are keys."""
    large = written(rows.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > hot).drop("__n"), "hot-groups")
    n = large.count()
    if not n:
        return rows, None
    keys = bounded(large, 64, n)
    return rows.join(keys, same_key(rows, keys, by), "left_anti"), rows.join(keys, same_key(rows, keys, by), "left_semi")


def in_ranges(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The rows sorted by group and order into ranges: a table with __part, the range, and __id, which orders all rows.

    It is written, as ranges are drawn from samples: every reader must see the same ones.
    """
    keys = [*map(F.col, by), *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    return written(ranged, "ranges").withColumn("__part", F.shiftright("__id", WITHIN))


def _key(by: list[str]) -> Column:
    return F.struct(*(F.col(c).alias(c) for c in by))


def with_previous(ranged: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """Adds the value of ``column`` in the row before within the group; null in its first row."""
    within = Window.partitionBy("__part", *by).orderBy("__id")
    ends = ranged.groupBy("__part").agg(F.min_by(_key(by), "__id").alias("__first"), F.max_by(_key(by), "__id").alias("__last"), F.max_by(F.struct(F.col(column).alias("v")), "__id").alias("__tail"))
    parts = Window.orderBy("__part")  # of one row a range
    carried = F.when(F.lag("__last").over(parts) == F.col("__first"), F.lag("__tail").over(parts)["v"])
    carry = ends.select("__part", "__first", carried.alias("__carried"))
    out = ranged.join(F.broadcast(carry), "__part")
    begins = (F.row_number().over(within) == 1) & (_key(by) == F.col("__first"))
    return out.withColumn(name, F.when(begins, F.col("__carried")).otherwise(F.lag(column).over(within))).drop("__first", "__carried")


def with_running(ranged: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the group up to and with this one."""
    within = Window.partitionBy("__part", *by).orderBy("__id").rowsBetween(Window.unboundedPreceding, 0)
    ranged = ranged.withColumn("__v", value)
    ends = written(ranged.groupBy("__part").agg(F.min_by(_key(by), "__id").alias("__first"), F.max_by(_key(by), "__id").alias("__last")), "range-ends")
    tails = ranged.join(F.broadcast(ends), "__part").where(_key(by) == F.col("__last")).groupBy("__part", F.col("__last").alias("k")).agg(F.sum("__v").alias("v"))
    # A range asks for its first group before it adds to its last one.
    asks = ends.select("__part", F.col("__first").alias("k"), F.lit(0).cast(tails.schema["v"].dataType).alias("v"), F.lit(0).alias("adds"))
    both = asks.unionByName(tails.withColumn("adds", F.lit(1)))
    upto = Window.partitionBy("k").orderBy("__part", "adds").rowsBetween(Window.unboundedPreceding, 0)
    carry = both.withColumn("__carried", F.sum("v").over(upto)).where("adds = 0").select("__part", F.col("k").alias("__first"), "__carried")
    out = ranged.join(F.broadcast(carry), "__part")
    carried = F.when(_key(by) == F.col("__first"), F.col("__carried")).otherwise(F.lit(0))
    return out.withColumn(name, F.sum("__v").over(within) + carried).drop("__first", "__carried", "__v")
