"""Joins between points and intervals, and between intervals.

Everything is keyed by device and time bucket, so a device with many rows or
alarms is split by time, and only rows of the same bucket meet.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stringwatch.functions.timegrid import MICROS_PER_MINUTE

DAY_MINUTES = 1_440


def _bucket(value: Column, size: int) -> Column:
    return F.floor(value / size).cast("long")


def _buckets(start: Column, end: Column, size: int) -> Column:
    return F.sequence(_bucket(start, size), _bucket(end, size))


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}") == F.col(f"{right}.{k}") for k in keys])


def covered_spans(
    intervals: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    buffer_minutes: int = 0,
    bucket_minutes: int = DAY_MINUTES,
) -> DataFrame:
    """Union of intervals per key, cut at bucket edges, as disjoint spans.

    Columns: keys, ``_bucket``, ``_from`` and ``_to`` in microseconds, both ends
    inclusive. Overlapping and repeated intervals collapse here, so a point meets
    at most one span.
    """
    size = bucket_minutes * MICROS_PER_MINUTE
    buffer = buffer_minutes * MICROS_PER_MINUTE
    low, high = F.unix_micros(start) - buffer, F.unix_micros(end) + buffer
    cut = (
        intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull())
        .select(*keys, low.alias("_low"), high.alias("_high"))
        .where("_low <= _high")
        .select(*keys, "_low", "_high", F.explode(_buckets(F.col("_low"), F.col("_high"), size)).alias("_bucket"))
        .select(
            *keys,
            "_bucket",
            F.greatest("_low", F.col("_bucket") * size).alias("_from"),
            F.least("_high", (F.col("_bucket") + 1) * size - 1).alias("_to"),
        )
        # of intervals with the same start only the longest matters
        .groupBy(*keys, "_bucket", "_from")
        .agg(F.max("_to").alias("_to"))
    )
    ordered = Window.partitionBy(*keys, "_bucket").orderBy("_from")
    reached = F.max("_to").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("_from") > reached, F.lit(True))
    return (
        cut.withColumn("_new", opens.cast("int"))
        .withColumn("_span", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_bucket", "_span")
        .agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
        .drop("_span")
    )


def _filter_by_spans(
    points: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, bucket_minutes: int, how: str
) -> DataFrame:
    size = bucket_minutes * MICROS_PER_MINUTE
    left = points.withColumn("_bucket", _bucket(F.unix_micros(time), size)).alias("p")
    right = spans.alias("s")
    inside = F.unix_micros(F.col(f"p.{time}")).between(F.col("s._from"), F.col("s._to"))
    return left.join(right, _same((*keys, "_bucket"), "p", "s") & inside, how).drop("_bucket")


def exclude_windows(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str] = ("plant_id", "device_no"),
    time: str = "event_time",
    start: str = "start_time",
    end: str = "end_time",
    buffer_minutes: int = 10,
    bucket_minutes: int = DAY_MINUTES,
) -> DataFrame:
    """Drop points inside [start - buffer, end + buffer] of their own key."""
    spans = covered_spans(intervals, keys, start, end, buffer_minutes, bucket_minutes)
    return _filter_by_spans(points, spans, keys, time, bucket_minutes, "left_anti")


def keep_windows(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str] = ("plant_id", "device_no"),
    time: str = "event_time",
    start: str = "start_time",
    end: str = "end_time",
    buffer_minutes: int = 0,
    bucket_minutes: int = DAY_MINUTES,
) -> DataFrame:
    """Keep only points inside some interval of their own key."""
    spans = covered_spans(intervals, keys, start, end, buffer_minutes, bucket_minutes)
    return _filter_by_spans(points, spans, keys, time, bucket_minutes, "left_semi")


def points_in_windows(
    points: DataFrame,
    windows: DataFrame,
    keys: Sequence[str],
    time: str = "event_time",
    start: str = "start_time",
    end: str = "end_time",
    buffer_minutes: int = 0,
    bucket_minutes: int = DAY_MINUTES,
) -> DataFrame:
    """Every point once per window of its key that contains it.

    The result carries all columns of both sides; columns of ``windows`` must
    not clash with those of ``points`` apart from the keys.
    """
    size = bucket_minutes * MICROS_PER_MINUTE
    buffer = buffer_minutes * MICROS_PER_MINUTE
    low, high = F.unix_micros(start) - buffer, F.unix_micros(end) + buffer
    left = points.withColumn("_bucket", _bucket(F.unix_micros(time), size)).alias("p")
    right = (
        windows.withColumns({"_low": low, "_high": high})
        .where("_low <= _high")
        .withColumn("_bucket", F.explode(_buckets(F.col("_low"), F.col("_high"), size)))
        .alias("w")
    )
    inside = F.unix_micros(F.col(f"p.{time}")).between(F.col("w._low"), F.col("w._high"))
    extra = [F.col(f"w.{c}") for c in windows.columns if c not in keys]
    return left.join(right, _same((*keys, "_bucket"), "p", "w") & inside).select(
        *[F.col(f"p.{c}") for c in points.columns], *extra
    )


def overlapping(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_start: str,
    left_end: str,
    right_start: str,
    right_end: str,
    bucket_minutes: int = DAY_MINUTES,
) -> DataFrame:
    """Pairs of overlapping intervals of the same key, ends inclusive.

    Both sides are repeated per bucket they touch; a pair is kept only in the
    bucket where the overlap begins, which replaces a distinct.
    """
    size = bucket_minutes * MICROS_PER_MINUTE

    def side(frame: DataFrame, start: str, end: str, name: str) -> DataFrame:
        low, high = F.unix_micros(start), F.unix_micros(end)
        return (
            frame.where(low <= high)
            .withColumn("_bucket", F.explode(_buckets(low, high, size)))
            .alias(name)
        )

    a, b = side(left, left_start, left_end, "a"), side(right, right_start, right_end, "b")
    touch = (F.col(f"a.{left_end}") >= F.col(f"b.{right_start}")) & (F.col(f"a.{left_start}") <= F.col(f"b.{right_end}"))
    begins = _bucket(F.unix_micros(F.greatest(F.col(f"a.{left_start}"), F.col(f"b.{right_start}"))), size)
    return a.join(b, _same((*keys, "_bucket"), "a", "b") & touch & (F.col("a._bucket") == begins)).select(
        *[F.col(f"a.{c}") for c in left.columns], *[F.col(f"b.{c}") for c in right.columns if c not in keys]
    )


def overlaps_any(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_start: str,
    left_end: str,
    right_start: str,
    right_end: str,
    name: str,
    bucket_minutes: int = DAY_MINUTES,
) -> DataFrame:
    """Flag left intervals that overlap some right interval of the same key.

    Left intervals must be distinct in keys, start and end or carry an id. The
    right side is reduced to disjoint spans first, so no list of matches arises.
    """
    size = bucket_minutes * MICROS_PER_MINUTE
    spans = covered_spans(right, keys, right_start, right_end, 0, bucket_minutes).alias("s")
    low, high = F.unix_micros(left_start), F.unix_micros(left_end)
    cut = left.select(*keys, left_start, left_end).distinct()
    pieces = cut.where(low <= high).withColumn("_bucket", F.explode(_buckets(low, high, size))).alias("a")
    meets = (F.unix_micros(F.col(f"a.{left_end}")) >= F.col("s._from")) & (
        F.unix_micros(F.col(f"a.{left_start}")) <= F.col("s._to")
    )
    hit = (
        pieces.join(spans, _same((*keys, "_bucket"), "a", "s") & meets, "left_semi")
        .select(*keys, left_start, left_end)
        .distinct()
        .withColumn(name, F.lit(1))
    )
    return left.join(hit, [*keys, left_start, left_end], "left").withColumn(name, F.coalesce(name, F.lit(0)))
