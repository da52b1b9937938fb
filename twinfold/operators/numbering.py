"""Consecutive numbers without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

_PART, _ROW = "_part", "_row"


def _sorted_parts(df: DataFrame, order: list) -> DataFrame:
    """Range-partition and sort ``df``; remember partition and row in it.

    Written out before use: the partition bounds come from a sample, so the counts below
    and the numbering must see the very same layout.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    return materialize(
        ordered.withColumn(_ROW, place), "numbered"
    ).withColumn(_PART, F.shiftright(_ROW, 33)).withColumn(
        _ROW, F.col(_ROW).bitwiseAND(F.lit((1 << 33) - 1))
    )


def dense_number(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Add ``name`` = 1..n in the order given, which must not have ties."""
    parts = _sorted_parts(df, order)
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition, so both the window and the broadcast are bounded
    starts = parts.groupBy(_PART).count().select(
        _PART, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")
    )
    return parts.join(F.broadcast(starts), _PART).withColumn(
        name, F.col("_start") + F.col(_ROW) + 1
    ).drop(_PART, _ROW, "_start")


def number_within(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Add ``name`` = 1..k inside each group, however large one group is.

    A group is numbered piece by piece: a piece is what one range partition holds of it.
    Only a group that runs over a partition edge needs a carry, so there are at most as
    many carries as partitions.
    """
    parts = _sorted_parts(df, [group, *order])
    earlier = Window.partitionBy(group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carries = (
        parts.groupBy(group, _PART).agg(F.count("*").alias("_n"))
        .withColumn("_carry", F.sum("_n").over(earlier))
        .where("_carry > 0").drop("_n")
    )
    piece = Window.partitionBy(group, _PART).orderBy(_ROW)
    return (
        parts.withColumn("_nth", F.row_number().over(piece))
        .join(F.broadcast(carries), [group, _PART], "left")
        .withColumn(name, F.col("_nth") + F.coalesce("_carry", F.lit(0).cast("bigint")))
        .drop(_PART, _ROW, "_nth", "_carry")
    )
