"""Alarm intervals: parsing, scope, grid points, classification against the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stringwatch.functions.arrays import parse_number_list
from stringwatch.functions.timegrid import ceil_minutes, floor_minutes, grid, micros
from stringwatch.operators import intervals
from stringwatch.schema import DEVICE_KEYS, POINT_KEYS, key_text, require_columns

# fixed values: alarm codes for low and for zero string current
LOW_CURRENT, ZERO_CURRENT = "101001", "101002"
ALARM_COLUMNS = ("id", "alarm_code", "device_no", "station_name", "raise_time", "end_time")


def epoch_millis(column: str) -> Column:
    return F.timestamp_millis(F.expr(f"try_cast(`{column}` as bigint)"))


def clean_alarm_events(
    raw: DataFrame,
    codes: tuple[str, ...] = (LOW_CURRENT, ZERO_CURRENT),
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """Alarm rows with parsed times; bad and negative intervals are dropped."""
    require_columns(raw, ALARM_COLUMNS, "alarm table")
    events = (
        raw.where(F.col("alarm_code").cast("string").isin(*codes))
        .withColumns(
            {
                "device_no": key_text("device_no"),
                "station_name": key_text("station_name"),
                "raise_time": epoch_millis("raise_time"),
                "end_time": epoch_millis("end_time"),
            }
        )
        .withColumnRenamed("id", "alarm_event_id")
        .where("raise_time is not null and end_time is not null and end_time >= raise_time")
    )
    if start is not None:
        events = events.where(F.col("end_time") >= start)
    if end is not None:
        events = events.where(F.col("raise_time") < end)
    return events


def with_plant(events: DataFrame, stations: DataFrame) -> DataFrame:
    """Map station names to plants; unmapped ones keep a null plant.

    A station with two plants fails the job.
    """
    conflict = F.raise_error(F.concat(F.lit("several plants for station "), "station_name")).cast("string")
    names = (
        stations.select(F.trim("station_name").alias("station_name"), key_text("plant_id").alias("plant_id"))
        .groupBy("station_name")
        .agg(F.min("plant_id").alias("_low"), F.max("plant_id").alias("_high"))
        .select("station_name", F.when(F.col("_low") == F.col("_high"), F.col("_low")).when(F.col("_low").isNotNull(), conflict).alias("plant_id"))
    )
    return events.join(names, "station_name", "left").withColumn(
        "station_mapping_status", F.when(F.col("plant_id").isNotNull(), "mapped").otherwise("station_unmapped")
    )


def with_label_scope(events: DataFrame) -> DataFrame:
    """``string`` alarms name strings, one label each; others are ``device`` alarms."""
    return (
        events.withColumn("_numbers", parse_number_list(F.coalesce("alarm_string", F.lit(""))))
        .withColumn("label_scope", F.when(F.size("_numbers") > 0, "string").otherwise("device"))
        .select("*", F.explode_outer("_numbers").alias("string_no"))
        .drop("_numbers")
    )


def read_scope_report(events: DataFrame) -> DataFrame:
    return events.agg(
        F.countDistinct("alarm_event_id").alias("alarm_events"),
        F.count_if(F.col("label_scope") == "string").alias("string_scope_rows"),
        F.count_if(F.col("label_scope") == "device").alias("device_scope_rows"),
    )


def restrict_to_manifest(events: DataFrame, manifest: DataFrame) -> DataFrame:
    """Alarms of known devices only."""
    return events.join(manifest, [c for c in ("station_name", "device_no") if c in manifest.columns], "left_semi")


def restrict_to_predictions(events: DataFrame, predictions: DataFrame) -> DataFrame:
    """Alarms of stations and devices that have predictions."""
    keys = ["station_name", "device_no"]
    return events.join(predictions.select(*keys).distinct(), keys, "left_semi")


def excluded_stations(events: DataFrame, predictions: DataFrame) -> DataFrame:
    """Stations of alarms that predictions do not cover, with their events."""
    keys = ["station_name", "device_no"]
    return (
        events.join(predictions.select(*keys).distinct(), keys, "left_anti")
        .groupBy("station_name")
        .agg(F.count(F.lit(1)).alias("excluded_events"))
    )


def expand_to_grid(
    events: DataFrame, start: str = "raise_time", end: str = "end_time", interval_minutes: int = 5
) -> DataFrame:
    """Every grid time inside each interval; intervals without one vanish."""
    return events.select(
        "*", F.explode(grid(F.col(start), F.col(end), interval_minutes)).alias("event_time")
    )


def without_grid_points(
    events: DataFrame, start: str = "raise_time", end: str = "end_time", interval_minutes: int = 5
) -> DataFrame:
    """Intervals that contain no grid time."""
    return events.where(
        ceil_minutes(F.col(start), interval_minutes) > floor_minutes(F.col(end), interval_minutes)
    )


def device_ranges(source: DataFrame) -> DataFrame:
    """Rows, complete rows, first and last time per device."""
    return source.groupBy(*DEVICE_KEYS).agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if("current_complete").alias("clean_rows"),
        F.min("event_time").alias("device_first_event_time"),
        F.max("event_time").alias("device_last_event_time"),
    )


def classify_events(events: DataFrame, source: DataFrame, interval_minutes: int = 5) -> DataFrame:
    """Compare alarm intervals with the rows that exist for their device.

    ``source`` has device keys, event_time and current_complete. Expected points
    are the grid times of the interval clipped to the device's range.
    """
    ranges = device_ranges(source).drop("raw_rows", "clean_rows")
    known = events.join(ranges, list(DEVICE_KEYS), "left")
    first, last = F.col("device_first_event_time"), F.col("device_last_event_time")
    overlap = first.isNotNull() & (F.col("end_time") >= first) & (F.col("raise_time") <= last)
    clipped = known.withColumns(
        {
            "effective_start_time": F.when(overlap, F.greatest("raise_time", first)),
            "effective_end_time": F.when(overlap, F.least("end_time", last)),
        }
    )
    step = interval_minutes * 60_000_000
    low = micros(ceil_minutes(F.col("effective_start_time"), interval_minutes))
    high = micros(floor_minutes(F.col("effective_end_time"), interval_minutes))
    clipped = clipped.withColumn(
        "expected_points", F.coalesce(F.greatest((high - low) / step + 1, F.lit(0)), F.lit(0)).cast("long")
    )
    # one row per device-time first: a repeated time is complete if any copy is
    on_grid = source.where(F.pmod(micros("event_time"), F.lit(step)) == 0)
    rows = on_grid.groupBy(*POINT_KEYS).agg(F.bool_or("current_complete").alias("_complete"))
    windows = clipped.where(F.col("effective_start_time").isNotNull()).select(*WINDOW)
    joined = clipped.join(_rows_in_windows(rows, windows), WINDOW, "left").withColumns(
        {
            "present_points": F.coalesce("present_points", F.lit(0)),
            "current_incomplete_points": F.coalesce("current_incomplete_points", F.lit(0)),
        }
    )
    joined = joined.withColumn("missing_points", F.col("expected_points") - F.col("present_points"))
    outside = (F.col("raise_time") < first) | (F.col("end_time") > last)
    gap = (
        (F.col("missing_points") > 0)
        | (F.col("current_incomplete_points") > 0)
        | (F.col("expected_points") == 0)
    )
    return joined.withColumns(
        {
            "classification": F.when(F.col("effective_start_time").isNull(), "outside_production_range")
            .when(outside, "partially_outside_range")
            .when(gap, "within_range_gap")
            .otherwise("complete"),
            "range_reason": F.when(first.isNull(), "station_or_device_not_found")
            .when(F.col("effective_start_time").isNull(), "no_interval_overlap")
            .when(outside, "left_or_right_boundary_outside")
            .when(F.col("expected_points") == 0, "no_grid_point")
            .when(gap, "missing_timestamp_or_current")
            .otherwise("all_expected_points_complete"),
        }
    )


WINDOW = ["alarm_event_id", *DEVICE_KEYS, "effective_start_time", "effective_end_time"]


def _rows_in_windows(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Present and incomplete rows of every window, from running counts at its two ends.

    Rows and window ends are laid out by device and time, once each; days are
    counted on their own and shifted by the totals of the earlier ones.
    """
    day = F.floor(F.col("_at") / F.lit(86_400_000_000))
    empty = F.lit(None)
    points = rows.select(
        *DEVICE_KEYS, micros("event_time").alias("_at"), F.lit(1).alias("_side"), (~F.col("_complete")).cast("long").alias("_open")
    )
    windows = windows.distinct()
    ends = windows.select(
        "*", F.explode(F.array(*[F.struct(micros(c).alias("_at"), F.lit(side).alias("_side")) for c, side in ((WINDOW[-2], 0), (WINDOW[-1], 2))])).alias("_end")
    ).select(*WINDOW, "_end.*", empty.cast("long").alias("_open"))
    laid = points.unionByName(ends, allowMissingColumns=True).withColumn("_day", day)
    present, incomplete = F.count("_open"), F.coalesce(F.sum("_open"), F.lit(0))
    days = laid.groupBy(*DEVICE_KEYS, "_day").agg(present.alias("_n"), incomplete.alias("_m"))
    earlier = Window.partitionBy(*DEVICE_KEYS).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(
        *DEVICE_KEYS, "_day", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_m")]
    )
    within = Window.partitionBy(*DEVICE_KEYS, "_day").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = (
        laid.join(days, [*DEVICE_KEYS, "_day"])
        .withColumns({"_n": F.col("_n_before") + present.over(within), "_m": F.col("_m_before") + F.coalesce(F.sum("_open").over(within), F.lit(0))})
        .where("_side <> 1")
    )
    sign = F.when(F.col("_side") == 2, 1).otherwise(-1)
    return counted.groupBy(*WINDOW).agg(
        F.sum(sign * F.col("_n")).alias("present_points"), F.sum(sign * F.col("_m")).alias("current_incomplete_points")
    )


def complete_label_points(classified: DataFrame, interval_minutes: int = 5) -> DataFrame:
    """Grid points of fully covered alarms: the labels."""
    return expand_to_grid(
        classified.where("classification = 'complete'"), "effective_start_time", "effective_end_time", interval_minutes
    )
