"""Ranks and running maxima in two levels, so that a group with a third of all rows is spread over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the order column inside one range; a group's order is cut into ranges of 2^RANGE_BITS numbers.
RANGE_BITS = 16


def _ranged(rows: DataFrame, by: str, order: Column, bits: int) -> tuple[DataFrame, Window]:
    cut = rows.withColumn("_range", F.shiftright(order.cast("long"), bits))
    return cut, Window.partitionBy(by).orderBy(F.asc_nulls_first("_range")).rowsBetween(Window.unboundedPreceding, -1)


def ranked(rows: DataFrame, by: str, order: str, name: str, bits: int = RANGE_BITS) -> DataFrame:
    """Adds `name`: the rank of every row in its group, from 1, in order of an integer column (nulls first).

    The rows of every range are counted, the counts summed over the ranges before, and rows ranked inside their range.
    """
    cut, ahead = _ranged(rows, by, F.col(order), bits)
    n = cut.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    offset = n.select(F.col(by).alias("_range_by"), F.col("_range").alias("_range_at"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_range_from"))
    met = cut.join(offset, F.col(by).eqNullSafe(F.col("_range_by")) & F.col("_range").eqNullSafe(F.col("_range_at")))
    inside = F.row_number().over(Window.partitionBy(by, "_range").orderBy(F.asc_nulls_first(order)))
    return met.withColumn(name, F.col("_range_from") + inside).drop("_range_by", "_range_at", "_range_from", "_range")


def greatest_before(rows: DataFrame, by: str, order: list[str], value: str, name: str, bits: int = RANGE_BITS) -> DataFrame:
    """Adds `name`: the greatest `value` of the rows before in the group, null for the first.

    The first column of `order` is an integer; the greatest of every range is carried over the ranges behind it.
    """
    cut, ahead = _ranged(rows, by, F.col(order[0]), bits)
    top = cut.groupBy(by, "_range").agg(F.max(value).alias("_m"))
    carried = top.select(F.col(by).alias("_range_by"), F.col("_range").alias("_range_at"), F.max("_m").over(ahead).alias("_range_top"))
    met = cut.join(carried, F.col(by).eqNullSafe(F.col("_range_by")) & F.col("_range").eqNullSafe(F.col("_range_at")))
    inside = Window.partitionBy(by, "_range").orderBy(*(F.asc_nulls_first(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    return met.withColumn(name, F.greatest("_range_top", F.max(value).over(inside))).drop("_range_by", "_range_at", "_range_top", "_range")
