"""Numbers and order statistics of whole tables without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Bits of monotonically_increasing_id that count within a partition.
WITHIN = 33


def positions(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Every row with its place (bigint, from 0, without gaps) in the given order; rows that tie come in any order.

    A range sort numbers each range in parallel, and the counts of the ranges before shift it. Both readers of the ranges
    (counts and rows) take them from one table: ranges are drawn from samples, so a second sort could cut elsewhere.
    """
    sorted_ = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "positions")
    part, place = F.shiftright("__id", WITHIN), F.col("__id").bitwiseAND(F.lit((1 << WITHIN) - 1))
    counts = sorted_.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    shift = counts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    return sorted_.withColumn("__p", part).join(F.broadcast(shift), "__p").withColumn(name, place + F.col("__s")).drop("__p", "__s", "__id")


def tallied(df: DataFrame, value: str) -> DataFrame:
    """(value, c, upto, total): how often each value occurs, up to it and in all.

    Meant for counts as values: k different counts need at least k * k / 2 rows below them, so this stays narrow.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    return c.withColumn("upto", F.sum("c").over(Window.orderBy(value))).withColumn("total", F.sum("c").over(Window.partitionBy()))


def value_at(value: str, index: Column) -> Column:
    """Aggregate over tallied rows: the value at a 0-based index of the sorted list."""
    return F.min(F.when(F.col("upto") > index, F.col(value)))
