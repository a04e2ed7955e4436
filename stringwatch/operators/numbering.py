"""Consecutive row numbers over a total order, without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stringwatch.storage import stage


def with_row_numbers(frame: DataFrame, order: Sequence[str], name: str = "row") -> DataFrame:
    """Number rows 1..n in the order of ``order``, which must be unique.

    Rows are range-partitioned and written once, which fixes the ranges; each
    range is numbered on its own and shifted by the sizes of the earlier ones.
    Only one count per range, never a row, is gathered.
    """
    ranged = stage(
        frame.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy(*order)
    # one row per range: at most spark.sql.shuffle.partitions rows
    return (
        ranged.withColumn("_row", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_offset") + F.col("_row"))
        .drop("_range", "_row", "_offset")
    )


def event_id(prefix: str, number: Column) -> Column:
    """``prefix-000001``; longer numbers keep all their digits."""
    text = number.cast("string")
    return F.concat(F.lit(f"{prefix}-"), F.lpad(text, F.greatest(F.length(text), F.lit(6)), "0"))


def with_event_ids(events: DataFrame, order: Sequence[str], prefix: str = "event") -> DataFrame:
    """Sequential ids in the order of ``order``."""
    return with_row_numbers(events, order, "_number").withColumn(
        "event_id", event_id(prefix, F.col("_number"))
    ).drop("_number")
