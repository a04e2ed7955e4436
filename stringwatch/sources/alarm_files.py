"""Alarm CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from stringwatch.operators import alarms


def read_alarm_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a byte-order mark on the first header is removed."""
    frame = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    return frame.toDF(*[name.lstrip("﻿").strip() for name in frame.columns])


def read_alarm_events(
    spark: SparkSession,
    path: str,
    manifest: DataFrame | None = None,
    codes: tuple[str, ...] = (alarms.LOW_CURRENT, alarms.ZERO_CURRENT),
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """Parsed alarms of known devices with their label scope."""
    events = alarms.clean_alarm_events(read_alarm_csv(spark, path), codes, start, end)
    if manifest is not None:
        events = alarms.restrict_to_manifest(events, manifest)
    return alarms.with_label_scope(events)
