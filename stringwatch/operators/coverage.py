"""How well alarm points are covered by production rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringwatch.functions.arrays import finite_count
from stringwatch.operators.channels import with_completeness
from stringwatch.schema import POINT_KEYS, channel_numbers, number

EVENT_KEYS = ("alarm_event_id", "alarm_code", "station_name", "plant_id", "device_no", "raise_time", "end_time")


def production_rows(frame: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """One row per device-time with its multiplicity and channel counts.

    The first row by ``order``, then by its own counts and currents, stands for
    repeated ones; after :func:`with_position` the order is file and row.
    """
    checked = with_completeness(frame)
    currents = [number(f"string_current_{n:02d}") for n in channel_numbers(frame)]
    values = F.array(*currents)
    row = F.struct(
        "current_expected_count",
        "current_finite_count",
        F.array_min(F.filter(values, lambda v: v.isNotNull())).alias("current_minimum"),
        F.array_max(F.filter(values, lambda v: v.isNotNull())).alias("current_maximum"),
        finite_count(values).alias("_finite"),
    )
    first = F.min_by(row, F.struct(*order, row) if order else row)
    return (
        checked.groupBy(*POINT_KEYS)
        .agg(F.count(F.lit(1)).alias("production_row_count"), first.alias("_row"))
        .select(*POINT_KEYS, "production_row_count", "_row.*")
        .drop("_finite")
    )


def attach_coverage(
    points: DataFrame, production: DataFrame, devices: DataFrame, audited_plants: DataFrame | None = None
) -> DataFrame:
    """Coverage status of every alarm point, first matching rule.

    Unmapped stations come first and stay unmapped; points of plants that are
    not audited keep their own status instead of vanishing.
    """
    known = devices.select("plant_id", "device_no").distinct().withColumn("production_device_exists", F.lit(True))
    result = points.join(known, ["plant_id", "device_no"], "left").join(production, list(POINT_KEYS), "left")
    audited = F.lit(True)
    if audited_plants is not None:
        plants = audited_plants.select("plant_id").distinct().withColumn("_audited", F.lit(True))
        result = result.join(plants, "plant_id", "left")
        audited = F.coalesce("_audited", F.lit(False))
    zero = F.lit(0)
    result = result.withColumns(
        {
            "production_device_exists": F.coalesce("production_device_exists", F.lit(False)),
            "production_row_count": F.coalesce("production_row_count", zero),
            "current_expected_count": F.coalesce("current_expected_count", zero),
            "current_finite_count": F.coalesce("current_finite_count", zero),
        }
    )
    result = result.withColumn(
        "current_missing_count",
        F.greatest(F.col("current_expected_count") - F.col("current_finite_count"), zero),
    )
    status = (
        F.when(F.col("station_mapping_status") != "mapped", "station_unmapped")
        .when(~audited, "plant_not_audited")
        .when(~F.col("production_device_exists"), "production_device_missing")
        .when(F.col("production_row_count") == 0, "production_timestamp_missing")
        .when(F.col("current_missing_count") > 0, "current_incomplete")
        .otherwise("complete")
    )
    return result.withColumn("coverage_status", status).drop("_audited")


def event_coverage(points: DataFrame) -> DataFrame:
    """Counts and status per alarm event."""

    def count(*statuses: str):
        return F.count_if(F.col("coverage_status").isin(*statuses))

    grouped = points.groupBy(*EVENT_KEYS).agg(
        F.count(F.lit(1)).alias("grid_points"),
        count("complete").alias("complete_current_points"),
        count("current_incomplete").alias("current_incomplete_points"),
        F.count_if(F.col("coverage_status") != "station_unmapped").alias("mapped_points"),
        F.count_if(
            ~F.col("coverage_status").isin("production_device_missing", "station_unmapped", "plant_not_audited")
        ).alias("device_present_points"),
        count("plant_not_audited").alias("_not_audited"),
        count("complete", "current_incomplete").alias("timestamp_present_points"),
        F.min("current_minimum").alias("minimum_current"),
        F.max("current_maximum").alias("maximum_current"),
    )
    status = (
        F.when(F.col("mapped_points") == 0, "station_unmapped")
        .when(F.col("_not_audited") == F.col("grid_points"), "plant_not_audited")
        .when(F.col("device_present_points") == 0, "production_device_missing")
        .when(F.col("timestamp_present_points") == 0, "production_timestamp_missing")
        .when(F.col("timestamp_present_points") < F.col("grid_points"), "production_timestamp_partial")
        .when(F.col("current_incomplete_points") > 0, "current_incomplete")
        .otherwise("complete")
    )
    return (
        grouped.withColumn("coverage_percent", F.col("complete_current_points") / F.col("grid_points") * 100)
        .withColumn("event_coverage_status", status)
        .drop("_not_audited")
    )


def status_counts(frame: DataFrame, column: str, *keys: str) -> DataFrame:
    """Frequencies of a status, optionally per key."""
    return frame.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("count"))
