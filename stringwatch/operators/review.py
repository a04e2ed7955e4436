"""Tables for manual review: event windows, ranks, wide exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stringwatch.functions.arrays import number_list
from stringwatch.functions.timegrid import local_text
from stringwatch.operators import intervals
from stringwatch.operators.channels import blank_unconfigured
from stringwatch.operators.compare import alerted_strings
from stringwatch.schema import DEVICE_KEYS, POINT_KEYS, channel_numbers, number


def window_points(points: DataFrame, windows: DataFrame, window_id: str, timezone: str = "Asia/Shanghai") -> DataFrame:
    """All strings of the device inside each window, ranked by current per time.

    Equal currents rank by string number. A window-time holds the strings of one
    device.
    """
    inside = intervals.points_in_windows(points, windows, DEVICE_KEYS, "event_time", "window_start", "window_end")
    group = Window.partitionBy(window_id, *POINT_KEYS)
    rank = F.row_number().over(group.orderBy(F.col("string_current").asc_nulls_last(), "string_no"))
    return inside.withColumns(
        {
            "current_rank_ascending": F.when(F.col("string_current").isNotNull(), rank),
            "strings_at_timestamp": F.count("string_no").over(group),
            "event_time_local": local_text("event_time", timezone),
        }
    ).withColumn("is_lowest_current", F.coalesce(F.col("current_rank_ascending") == 1, F.lit(False)))


def window_summary(inside: DataFrame, window_id: str, sums: Sequence[str] = ()) -> DataFrame:
    """Per window: times, rows and the lowest string."""
    lowest = F.min_by(
        F.struct("string_no", "string_current", "string_current_ratio"),
        F.when(F.col("string_current").isNotNull(), F.struct("string_current", "event_time", "string_no")),
    )
    per_time = inside.groupBy(window_id, *POINT_KEYS).agg(
        F.count(F.lit(1)).alias("_rows"),
        lowest.alias("_low"),
        *[F.sum(c).alias(c) for c in sums],
    )
    return (
        per_time.groupBy(window_id, *DEVICE_KEYS)
        .agg(
            F.count(F.lit(1)).alias("timestamps"),
            F.sum("_rows").alias("rows"),
            F.min_by(
                "_low", F.when(F.col("_low").isNotNull(), F.struct("_low.string_current", "event_time", "_low.string_no"))
            ).alias("_low"),
            *[F.sum(c).alias(c) for c in sums],
        )
        .select(
            window_id,
            *DEVICE_KEYS,
            "timestamps",
            "rows",
            F.col("_low.string_no").alias("lowest_string_no"),
            F.col("_low.string_current").alias("minimum_current"),
            F.col("_low.string_current_ratio").alias("minimum_current_ratio"),
            *sums,
        )
    )


def top_events(events: DataFrame, count: int, order: Sequence[str]) -> DataFrame:
    """The first events by a total order: a bounded top-k report."""
    return events.orderBy(*order).limit(count)


def review_windows(
    alerts: DataFrame,
    events: DataFrame,
    event_type: str,
    order: Sequence[str],
    maximum_events: int = 10,
    window_minutes: int = 30,
    curves: DataFrame | None = None,
) -> DataFrame:
    """Alert rows, and curves if given, around the first events."""
    chosen = top_events(events, maximum_events, order).select(
        *DEVICE_KEYS, F.col("start_time").alias("_start"), F.col("end_time").alias("_end")
    )
    rows = intervals.points_in_windows(
        alerts, chosen, DEVICE_KEYS, "target_time", "_start", "_end", window_minutes
    ).withColumns({"review_event_start": F.col("_start"), "review_event_type": F.lit(event_type)}).drop("_start", "_end")
    if curves is not None:
        extra = [c for c in curves.columns if c in POINT_KEYS or c not in alerts.columns]
        rows = rows.join(
            curves.select(*extra).withColumnRenamed("event_time", "target_time"),
            [*DEVICE_KEYS, "target_time"],
            "left",
        )
    return rows


def format_strings(numbers: Column, main_count: Column) -> Column:
    """``"03,07"`` of channels within the declared count, else ``FALSE``."""
    kept = F.filter(numbers, lambda n: main_count.isNull() | (n <= main_count))
    return F.when(F.size(F.coalesce(kept, F.array().cast("array<int>"))) > 0, number_list(kept)).otherwise("FALSE")


def manual_review(
    currents: DataFrame,
    events: DataFrame,
    predictions: Mapping[str, DataFrame],
    alert_columns: Mapping[str, str],
    timezone: str = "Asia/Shanghai",
) -> DataFrame:
    """Wide rows inside alarms beside each version's nonzero alerted strings."""
    names = channel_numbers(currents)
    result = blank_unconfigured(currents).join(
        events.select("alarm_event_id", F.col("raise_time"), F.col("end_time")).dropDuplicates(["alarm_event_id"]),
        "alarm_event_id",
    )
    count = number("main_string_count").cast("int")
    for label, points in predictions.items():
        alert = F.col(alert_columns[label]).cast("boolean") & (F.col("string_current") > 0)
        result = result.join(alerted_strings(points, alert, "_numbers"), list(POINT_KEYS), "left").withColumn(
            label, format_strings(F.col("_numbers"), count)
        ).drop("_numbers")
    return result.select(
        "alarm_event_id",
        *DEVICE_KEYS,
        local_text("raise_time", timezone).alias("raise_time_local"),
        local_text("end_time", timezone).alias("end_time_local"),
        local_text("event_time", timezone).alias("event_time_local"),
        *[F.col(f"string_current_{n:02d}") for n in names],
        F.lit("TRUE").alias("baseline"),
        *predictions,
        F.lit("").alias("manual_label"),
        F.lit("").alias("manual_note"),
    )
