"""Ranks and carried values along an order, without one task per key.

A window over a hot key would sort a third of the data in one task.  Along an integer order the
rows are cut into ranges of ``width`` values (the order is unique per key, so a range holds at most
``width`` rows), ranges into ranges of ranges, and so on; every window sees one range of one level.
There are as many levels as the span of 64-bit integers needs, so gaps in the order do not matter.  Along other orders the rows are sorted across partitions, and windows
run inside a partition and over the partitions of a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passbook.session import cut_lineage

WIDTH = 1 << 22
#: Where a caller knows that no key has more rows (``most``), one window sorts the rows of a key without ranges.
ONE_TASK = 1 << 20


def _one_window(most: int | None) -> bool:
    return most is not None and most <= ONE_TASK


def _range_of(order: str, width: int) -> Column:
    return F.floor(F.col(order) / F.lit(width).cast("decimal(20,0)")).cast("bigint")


def _levels(width: int) -> int:
    """Levels of ranges whose top one cuts 64-bit integers into at most ``width`` ranges."""
    return max(1, ceil(64 / log2(width)) - 1)


def _before(keys: Sequence[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _sums_before(counts: DataFrame, keys: list[str], width: int, levels: int) -> DataFrame:
    """(keys, _range, _offset): the sum of ``_n`` over the earlier ranges of the key."""
    if levels <= 1:
        return counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(_before(keys, "_range")), F.lit(0)).alias("_offset"))
    cut = counts.withColumn("_above", _range_of("_range", width))
    above = _sums_before(
        cut.groupBy(*keys, F.col("_above").alias("_range")).agg(F.sum("_n").alias("_n")), keys, width, levels - 1
    ).select(*keys, F.col("_range").alias("_above"), F.col("_offset").alias("_start"))
    inside = F.coalesce(F.sum("_n").over(_before([*keys, "_above"], "_range")), F.lit(0))
    return cut.withColumn("_inside", inside).join(above, [*keys, "_above"]).select(
        *keys, "_range", (F.col("_inside") + F.col("_start")).alias("_offset")
    )


def rank_along(
    df: DataFrame, keys: Sequence[str], order: str, out: str = "rank", width: int = WIDTH, most: int | None = None
) -> DataFrame:
    """Add the 1-based position of each row inside its key, by a unique integer column."""
    keys = list(keys)
    if _one_window(most):
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("bigint"))
    cut = df.withColumn("_range", _range_of(order, width))
    inner = Window.partitionBy(*keys, "_range").orderBy(order)
    offsets = _sums_before(cut.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n")), keys, width, _levels(width))
    return (
        cut.withColumn("_local", F.row_number().over(inner))
        .join(offsets, [*keys, "_range"])
        .withColumn(out, (F.col("_local") + F.col("_offset")).cast("bigint"))
        .drop("_local", "_offset", "_range")
    )


def _carried(ends: DataFrame, keys: list[str], width: int, levels: int) -> DataFrame:
    """(keys, _range, _carry): the last ``_end`` of the earlier ranges of the key that has one."""
    last = lambda window: F.last("_end", ignorenulls=True).over(window)
    if levels <= 1:
        return ends.select(*keys, "_range", last(_before(keys, "_range")).alias("_carry"))
    cut = ends.withColumn("_above", _range_of("_range", width))
    above = _carried(
        cut.groupBy(*keys, F.col("_above").alias("_up"))
        .agg(F.max_by("_end", F.when(F.col("_end").isNotNull(), F.col("_range"))).alias("_end"))
        .withColumnRenamed("_up", "_range"),
        keys, width, levels - 1,
    ).select(*keys, F.col("_range").alias("_above"), F.col("_carry").alias("_far"))
    return cut.withColumn("_inside", last(_before([*keys, "_above"], "_range"))).join(above, [*keys, "_above"]).select(
        *keys, "_range", F.coalesce("_inside", "_far").alias("_carry")
    )


def previous_value(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str = "previous", width: int = WIDTH,
    most: int | None = None,
) -> DataFrame:
    """Add the last non-NULL ``value`` of earlier rows of the same key."""
    keys = list(keys)
    if _one_window(most):
        return df.withColumn(out, F.last(value, ignorenulls=True).over(_before(keys, order)))
    cut = df.withColumn("_range", _range_of(order, width))
    inner = (
        Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    ends = cut.groupBy(*keys, "_range").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_end")
    )
    return (
        cut.withColumn("_near", F.last(value, ignorenulls=True).over(inner))
        .join(_carried(ends, keys, width, _levels(width)), [*keys, "_range"])
        .withColumn(out, F.coalesce("_near", "_carry"))
        .drop("_near", "_carry", "_range")
    )


def sums_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over the earlier rows of the key, by columns of any type.

    Rows are sorted across partitions and stored once, so that a row keeps its partition; the
    window over a key then sees one row for each partition that holds it.
    """
    keys = list(keys)
    placed = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    inside = F.coalesce(F.sum(value).over(
        Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ), F.lit(0))
    starts = placed.groupBy(*keys, "_part").agg(F.sum(value).alias("_n")).select(
        *keys, "_part", F.coalesce(F.sum("_n").over(_before(keys, "_part")), F.lit(0)).alias("_part_sum")
    )
    return (
        placed.withColumn("_inside", inside)
        .join(starts, [*keys, "_part"])
        .withColumn(out, (F.col("_inside") + F.col("_part_sum")).cast("bigint"))
        .drop("_inside", "_part_sum", "_part")
    )


def rank_sorted(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "_rank", most: int | None = None
) -> DataFrame:
    """Add the 1-based position of each row inside its key, by columns of any type."""
    if _one_window(most):
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    before = sums_sorted(df.withColumn("_one", F.lit(1)), keys, order, "_one", out)
    return before.withColumn(out, F.col(out) + 1).drop("_one")
