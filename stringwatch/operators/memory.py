"""Memory of confirmed anomalies and reconstruction of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringwatch.config import MemorySettings
from stringwatch.functions.timegrid import shift_minutes
from stringwatch.operators import runs
from stringwatch.schema import STRING_KEYS


def string_line(settings: MemorySettings, chunk_minutes: int | None = None) -> runs.Timeline:
    return runs.Timeline(STRING_KEYS, "event_time", settings.interval_minutes, chunk_minutes)


def add_memory(
    points: DataFrame,
    raw: Column,
    evaluable: Column,
    settings: MemorySettings = MemorySettings(),
    strict_column: str | None = None,
    chunk_minutes: int | None = None,
) -> DataFrame:
    """Alert at once on raw points while a confirmed anomaly is remembered.

    Confirmed by consecutive raw points, forgotten after consecutive normal
    points, a gap or a point that cannot be evaluated. The automaton reduces to
    comparing times inside a segment of evaluable, gap-free rows: memory is
    active while the last confirmation lies after the last clearing.
    """
    line = string_line(settings, chunk_minutes)
    ok = F.coalesce(evaluable, F.lit(False))
    result = points.withColumn("_ok", ok).withColumn("_raw", ok & F.coalesce(raw, F.lit(False)))
    result = runs.with_previous(result, line, {"_previous_time": F.col(line.time), "_previous_ok": F.col("_ok")})
    opens = F.col("_ok") & ~(runs.follows(line) & F.coalesce(F.col("_previous_ok"), F.lit(False)))
    result = runs.with_latest_time(
        result,
        line,
        {"_segment": opens, "_last_normal": F.col("_ok") & ~F.col("_raw"), "_last_raw": F.col("_raw")},
    )
    before = shift_minutes(F.col("_segment"), -line.interval_minutes)

    def count_since(last: str) -> Column:
        # points after the latest opposite point of the segment
        start = F.greatest(F.col(last), before)
        return ((F.unix_micros(line.time) - F.unix_micros(start)) / line.interval_micros).cast("int")

    result = result.withColumns(
        {
            "memory_entry_streak": F.when(F.col("_raw"), count_since("_last_normal")).otherwise(0),
            "memory_normal_streak": F.when(F.col("_ok") & ~F.col("_raw"), count_since("_last_raw")).otherwise(0),
        }
    )
    result = runs.with_latest_time(
        result,
        line,
        {
            "_confirmed": F.col("memory_entry_streak") >= settings.entry_consecutive,
            "_cleared": F.col("memory_normal_streak") >= settings.clear_consecutive,
        },
    )
    remembered = (F.col("_confirmed") >= F.col("_segment")) & (
        F.col("_cleared").isNull() | (F.col("_confirmed") > F.col("_cleared"))
    )
    active = F.col("_ok") & F.coalesce(remembered, F.lit(False))
    alert = F.col("_raw") & F.col("memory_active")
    result = result.withColumn("memory_active", active).withColumn("memory_alert", alert)
    final = F.col("memory_alert")
    if strict_column is not None:
        final = final | (F.coalesce(F.col(strict_column).cast("int"), F.lit(0)) == 1)
    return result.withColumns(
        {
            "memory_raw_anomaly": F.col("_raw").cast("int"),
            "memory_reactivated_alert": (
                F.col("memory_alert") & (F.col("memory_entry_streak") < settings.entry_consecutive)
            ).cast("int"),
            "final_alert": final.cast("int"),
            "memory_alert": F.col("memory_alert").cast("int"),
            "memory_active": F.col("memory_active").cast("int"),
        }
    ).drop(
        "_ok", "_raw", "_previous_time", "_previous_ok", "_segment", "_last_normal", "_last_raw", "_confirmed", "_cleared"
    )


def evidence_points(points: DataFrame) -> DataFrame:
    """Raw anomalies and final alerts."""
    return points.where("memory_raw_anomaly = 1 or final_alert = 1")


def reconstruct_events(points: DataFrame, settings: MemorySettings = MemorySettings()) -> DataFrame:
    """Runs of evidence, ``confirmed`` where they contain an alert.

    A confirmed event starts with its first candidate, not with its first alert.
    """
    return runs.collapse(
        evidence_points(points),
        string_line(settings),
        F.lit(True),
        [
            F.min(F.when(F.col("final_alert") == 1, F.col("event_time"))).alias("first_alert_time"),
            F.sum("final_alert").alias("alert_points"),
            F.sum("memory_reactivated_alert").alias("reactivated_points"),
            F.max("final_alert").alias("confirmed"),
        ],
    )


def memory_report(points: DataFrame) -> DataFrame:
    """Counts per plant and overall (plant_id null)."""
    return points.groupingSets([["plant_id"], []], "plant_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("memory_raw_anomaly").alias("raw_anomaly_points"),
        F.sum("memory_active").alias("memory_active_rows"),
        F.sum("memory_reactivated_alert").alias("memory_reactivated_points"),
        F.sum("final_alert").alias("alert_points"),
    )
