"""Exact quantiles and ranks of groups of any size.

Equal values of a group are counted first. The counted values are put into
ranges of (group, value) that are written once; a running count then needs one
total per group and range, and the order inside a range. No task holds more than
a range, however large a group or however often a value occurs. Infinite values
are ordered like others. Quantiles use linear interpolation between order
statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stringwatch.functions.rounding import between
from stringwatch.storage import stage


def _same_group(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of the keys and of the range."""
    condition = left["_range"] == right["_in_range"]
    for i, key in enumerate(keys):
        condition = condition & left[key].eqNullSafe(right[f"_key{i}"])
    return condition


def _counted_ranges(frame: DataFrame, keys: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Values with ``_count`` and ``_range``; per group and range its size, the rows before it and the group's size.

    Null and NaN values are left out.
    """
    known = frame.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counted = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_count"))
    ranged = stage(counted.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()), "values")
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("_count").alias("_total"))
    # one row per group and range
    group = Window.partitionBy(*[F.col(k) for k in keys])
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({"_before": F.coalesce(F.sum("_total").over(earlier), F.lit(0)), "_n": F.sum("_total").over(group)})
    return ranged, totals.withColumnsRenamed({"_range": "_in_range"} | {k: f"_key{i}" for i, k in enumerate(keys)})


def _running_start(keys: Sequence[str], value: str) -> Column:
    """Rows of the group with a smaller value."""
    inside = Window.partitionBy(*[F.col(k) for k in keys], "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return F.col("_before") + F.coalesce(F.sum("_count").over(inside), F.lit(0))


def _within(ranks: Column, start: Column, count: Column) -> Column:
    return F.filter(ranks, lambda r: (r >= start) & (r < start + count))


def quantiles(frame: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact quantiles of ``value`` per group.

    Returns keys, ``n`` (non-null, non-NaN values) and ``q``, an array in the
    order of ``probabilities``. ``frame`` is read once or twice, so pass a scan
    or a staged table rather than a long computation.
    """
    keys = list(keys)
    asked = F.array(*[F.lit(float(p)) for p in probabilities])
    # -0.0 and 0.0 are one value
    values = frame.select(*keys, (F.col(value).cast("double") + F.lit(0.0)).alias("_v"))
    ranged, totals = _counted_ranges(values, keys, "_v")
    # wanted 0-based ranks; each quantile needs the two around its position
    wanted = F.array_distinct(
        F.flatten(
            F.transform(
                asked,
                lambda p: F.array(
                    F.floor(p * (F.col("_n") - 1)).cast("long"), F.ceil(p * (F.col("_n") - 1)).cast("long")
                ),
            )
        )
    )
    targets = totals.withColumn("_ranks", _within(wanted, F.col("_before"), F.col("_total"))).where(F.size("_ranks") > 0)
    found = (
        ranged.join(targets, _same_group(ranged, targets, keys))
        .withColumn("_start", _running_start(keys, "_v"))
        .withColumn("_ranks", _within(F.col("_ranks"), F.col("_start"), F.col("_count")))
        .select(*keys, "_n", "_v", F.explode("_ranks").alias("_rank"))
    )
    # at most two rows per quantile and group are left here
    picked = found.groupBy(*keys).agg(
        F.first("_n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at")
    )

    def interpolate(p: Column) -> Column:
        position = p * (F.col("n") - 1)
        low = F.col("_at")[F.floor(position).cast("long")]
        high = F.col("_at")[F.ceil(position).cast("long")]
        # equal neighbours need no difference, which infinite ones do not have
        below = F.lit(float("-inf"))
        return F.when((low == high) | ((low == below) & (high < -below)), low).otherwise(low + (high - low) * (position - F.floor(position)))

    return picked.where("n > 0").withColumn("q", F.transform(asked, interpolate)).select(*keys, "n", "q")


def quantiles_of_columns(
    frame: DataFrame, keys: Sequence[str], values: Sequence[str], probabilities: Sequence[float]
) -> DataFrame:
    """Exact quantiles of several columns in one pass: keys, ``column`` (its name), ``n`` and ``q``."""
    stacked = frame.select(
        *keys, F.inline(F.array(*[F.struct(F.lit(v).alias("column"), F.col(v).cast("double").alias("_value")) for v in values]))
    )
    return quantiles(stacked, [*keys, "column"], "_value", probabilities)


def bounded_quantile(frame: DataFrame, keys: Sequence[str], value: str, probability: float, name: str) -> DataFrame:
    """One exact quantile of groups that are small by design, such as a string or a device over time.

    The caller vouches for that: the distinct values of a group meet in one
    task. One exchange. Values between two others are rounded once. The rules for null,
    NaN, -0.0 and infinite values are those of :func:`quantiles`.
    """
    values = frame.select(*keys, (F.col(value).cast("double") + F.lit(0.0)).alias("_v"))
    known = values.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if probability == 0.5:
        # the mean of two values, whichever way it is interpolated
        return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile("_v", F.lit(0.5)).alias(name))
    listed = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("_v")).alias("_all"))
    position = F.lit(float(probability)) * (F.col("n") - 1)
    ends = [F.get("_all", at(position).cast("int")).alias(end) for end, at in (("_low", F.floor), ("_high", F.ceil))]
    picked = listed.select(*keys, "n", *ends, (position - F.floor(position)).alias("_share"))
    return picked.select(*keys, "n", between(F.col("_low"), F.col("_high"), F.col("_share")).alias(name))


def quantile(frame: DataFrame, keys: Sequence[str], value: str, probability: float, name: str) -> DataFrame:
    """One exact quantile per group, with the number of values as ``n``."""
    table = quantiles(frame, keys, value, [probability])
    return table.select(*keys, "n", F.get("q", 0).alias(name))


def scalar_quantiles(frame: DataFrame, value: str, probabilities: Sequence[float]) -> list[float] | None:
    """Quantiles of the whole frame on the driver: one row, or None if empty."""
    row = quantiles(frame, [], value, probabilities).first()
    return list(row["q"]) if row else None


def average_ranks(frame: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Rank with ties averaged, per group and distinct value.

    Returns keys, the value and its rank.
    """
    keys = list(keys)
    ranged, totals = _counted_ranges(frame, keys, value)
    return (
        ranged.join(totals, _same_group(ranged, totals, keys))
        .withColumn("_start", _running_start(keys, value))
        .select(*keys, value, (F.col("_start") + (F.col("_count") + 1) / 2).alias(name))
    )
