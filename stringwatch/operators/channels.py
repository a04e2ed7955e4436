"""From wide device rows to strings: unpivot, configured channels, inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringwatch.functions.timegrid import local_date
from stringwatch.schema import DEVICE_KEYS, channel_numbers, number, number_text, require_columns

# fixed values: channel status 1 normal, 2 low current, 4 zero current
CONFIGURED_STATUS = (1, 2, 4)


def readings(frame: DataFrame) -> Column:
    """Array of (string_no, current, status) of one wide row."""

    def entry(n: int) -> str:
        status = f"string_status_{n:02d}"
        value = number_text(status) if status in frame.columns else "cast(null as double)"
        return f"named_struct('string_no', {n}, 'current', {number_text(f'string_current_{n:02d}')}, 'status', {value})"

    return F.expr(f"array({', '.join(entry(n) for n in channel_numbers(frame))})")


def configured(reading: Column) -> Column:
    """A finite current whose status, if any, is one of a physical channel."""
    return reading["current"].isNotNull() & (
        reading["status"].isNull() | reading["status"].isin(*CONFIGURED_STATUS)
    )


def unpivot_strings(frame: DataFrame, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per channel of every wide row, filtered before it is exploded."""
    strings = readings(frame)
    if keep is not None:
        strings = F.filter(strings, keep)
    meta = [c for c in frame.columns if not c.startswith(("string_current_", "string_status_"))]
    return frame.select(*meta, F.inline(strings)).withColumnsRenamed(
        {"current": "string_current", "status": "string_status"}
    )


def blank_unconfigured(frame: DataFrame) -> DataFrame:
    """Null currents of channels above the declared string count."""
    count = number("main_string_count")
    return frame.withColumns(
        {
            f"string_current_{n:02d}": F.when(
                count.isNull() | (count >= n), number(f"string_current_{n:02d}")
            )
            for n in channel_numbers(frame)
        }
    )


def with_completeness(frame: DataFrame) -> DataFrame:
    """Expected and finite channel counts and whether a row is complete."""
    numbers = channel_numbers(frame)
    available = len(numbers)
    finite = sum((number(f"string_current_{n:02d}").isNotNull().cast("int") for n in numbers), F.lit(0))
    expected = F.lit(available)
    if "main_string_count" in frame.columns:
        declared = number("main_string_count")
        expected = F.when(declared > 0, F.least(declared, F.lit(float(available)))).otherwise(available)
    return (
        frame.withColumn("current_expected_count", expected.cast("int"))
        .withColumn("current_finite_count", finite.cast("int"))
        .withColumn(
            "current_complete",
            (F.col("current_expected_count") > 0)
            & (F.col("current_finite_count") >= F.col("current_expected_count")),
        )
    )


def channel_inventory(
    frame: DataFrame,
    minimum_samples: int = 3,
    minimum_days: int = 1,
    timezone: str = "Asia/Shanghai",
) -> DataFrame:
    """Channels a device really has, by historical evidence.

    Non-zero status is authoritative where a channel ever reports one; positive
    current is the fallback. Evidence needs a number of samples and local days.
    One row per device and configured channel, numbering may have holes.
    """
    require_columns(frame, (*DEVICE_KEYS, "event_time"), "device table")
    day = local_date("event_time", timezone)
    has_status = F.coalesce(F.col("string_status") != 0, F.lit(False))
    has_current = F.coalesce(F.col("string_current") > 0, F.lit(False))
    # channels without evidence in a row count nowhere, unless none is asked for
    evident = (lambda s: F.coalesce((s["status"] != 0) | (s["current"] > 0), F.lit(False))) if minimum_samples > 0 else None
    # per day first: partial counts are merged before days are counted
    daily = (
        unpivot_strings(
            frame.withColumn("_day", day).select(
                *DEVICE_KEYS,
                "_day",
                *[c for c in frame.columns if c.startswith(("string_current_", "string_status_"))],
            ),
            evident,
        )
        .groupBy(*DEVICE_KEYS, "string_no", "_day")
        .agg(F.count_if(has_status).alias("_status"), F.count_if(has_current).alias("_current"))
    )
    return (
        daily.groupBy(*DEVICE_KEYS, "string_no")
        .agg(
            F.sum("_status").alias("_status"),
            F.sum("_current").alias("_current"),
            F.count_if(F.col("_status") > 0).alias("_status_days"),
            F.count_if(F.col("_current") > 0).alias("_current_days"),
        )
        .select(
            *DEVICE_KEYS,
            "string_no",
            F.when(F.col("_status") > 0, "status").otherwise("current").alias("evidence"),
            F.when(F.col("_status") > 0, F.col("_status")).otherwise(F.col("_current")).alias("evidence_samples"),
            F.when(F.col("_status") > 0, F.col("_status_days"))
            .otherwise(F.col("_current_days"))
            .alias("evidence_days"),
        )
        .where((F.col("evidence_samples") >= minimum_samples) & (F.col("evidence_days") >= minimum_days))
    )


def inventory_by_device(inventory: DataFrame) -> DataFrame:
    """One array of channels per device."""
    return inventory.groupBy(*DEVICE_KEYS).agg(
        F.array_sort(F.collect_set("string_no")).alias("configured_strings")
    )


def inventory_audit(frame: DataFrame, inventory: DataFrame) -> DataFrame:
    """Per device: channels, declared count, count mismatch and holes."""
    declared = frame.groupBy(*DEVICE_KEYS).agg(F.max(number("main_string_count")).alias("declared"))
    return (
        inventory_by_device(inventory)
        .join(declared, list(DEVICE_KEYS), "left")
        .select(
            *DEVICE_KEYS,
            F.size("configured_strings").alias("configured_channels"),
            F.col("declared").cast("int").alias("declared_count"),
            F.coalesce((F.col("declared") != F.size("configured_strings")).cast("int"), F.lit(0)).alias(
                "count_mismatch"
            ),
            (F.array_max("configured_strings") != F.size("configured_strings")).cast("int").alias("noncontiguous"),
        )
    )
