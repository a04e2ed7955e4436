"""Audits of the derived weather and device tables and of raw events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringwatch.functions.timegrid import local_date
from stringwatch.operators import audit
from stringwatch.plans.driver_views import SQL_VIEWS, SQL_WEATHER, device_table, epoch, table, weather_table
from stringwatch.plans.registry import query
from stringwatch.storage import stage

TZ = "Asia/Shanghai"


def dated_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather beside its partition date; one plant is filed a day early."""
    rows = weather_table(spark, sf_dir)
    day = local_date("time", TZ)
    return rows.withColumn("date", F.when(F.col("plant_id") == "2", F.date_sub(day, 1)).otherwise(day))


SQL_W = f"{SQL_VIEWS},{SQL_WEATHER}"


@query(
    "weather_partition_audit",
    f"""with {SQL_W} select count(*) as rows, cast(0 as bigint) as invalid_time, min(wt) as minimum_epoch, max(wt) as maximum_epoch,
 count(*) filter (where plant = 2) as partition_date_mismatches, count(*) filter (where plant <> 1) as plant_id_mismatches,
 count(*) filter (where wt // 60 % 60 % 20 <> 0) as off_grid from wx""",
)
def weather_partition_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = audit.partition_summary(dated_weather(spark, sf_dir), "time", "date", F.lit("1"), TZ, 20)
    return summary.select(
        "rows", "invalid_time", epoch("minimum_time", "minimum_epoch"), epoch("maximum_time", "maximum_epoch"),
        "partition_date_mismatches", "plant_id_mismatches", "off_grid",
    )


@query(
    "weather_missing_values",
    f"""with {SQL_W} select 'sensor_ghi' as "column", count(*) filter (where sensor_ghi is null) as missing from wx
 union all select 'forecast_ghi', count(*) filter (where forecast_ghi is null) from wx""",
)
def weather_missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.missing_values(weather_table(spark, sf_dir), ["sensor_ghi", "forecast_ghi"])


@query(
    "weather_series_summary",
    f"""with {SQL_W} select count(sensor_ghi) as present, count(*) - count(sensor_ghi) as missing,
 round_even(count(sensor_ghi) * 100.0 / count(*), 4) as present_percent, round(min(sensor_ghi), 6) as minimum, round(max(sensor_ghi), 6) as maximum,
 count(*) filter (where sensor_ghi < 0) as negative_values, count(*) filter (where sensor_ghi = 0) as zero_values, 'sensor_ghi' as "column" from wx""",
)
def weather_series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = audit.series_summary(weather_table(spark, sf_dir), "sensor_ghi")
    return summary.withColumns(
        {
            "minimum": F.round("minimum", 6),
            "maximum": F.round("maximum", 6),
        }
    )


@query(
    "weather_within_day_gaps",
    f"""with {SQL_W},
g as (select wt - lag(wt) over (partition by plant, (wt + 28800) // 86400 order by wt) as d from wx)
select count(*) filter (where d > 300) as within_day_gap_segments,
 cast(coalesce(sum(case when d > 300 then greatest(cast(round_even(d / 300.0, 0) as bigint) - 1, 0) end), 0) as bigint) as estimated_missing_within_days from g""",
)
def weather_within_day_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.within_day_gaps(weather_table(spark, sf_dir), ["plant_id"], "time", 5, TZ)


@query(
    "device_interval_histogram",
    f"""with {SQL_VIEWS},
g as (select (epoch - lag(epoch) over (partition by plant, dev, (epoch + 28800) // 86400 order by epoch)) / 60.0 as minutes from meta)
select minutes, count(*) as count from g where minutes is not null group by minutes""",
)
def device_interval_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interval_histogram(device_table(spark, sf_dir), ["plant_id", "device_no"], "event_time", TZ)


@query(
    "weather_presence_by_date",
    f"""with {SQL_W} select strftime(to_timestamp(wt + 28800)::timestamp, '%Y-%m-%d') as local_date, count(*) as rows,
 count(forecast_ghi) as forecast_ghi_present, count(sensor_ghi) as sensor_ghi_present from wx group by 1""",
)
def weather_presence_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.presence_by_date(
        weather_table(spark, sf_dir), "time", ["forecast_ghi", "sensor_ghi"], TZ
    ).withColumn("local_date", F.col("local_date").cast("string"))


@query(
    "device_partition_audit",
    f"""with {SQL_VIEWS} select count(*) as rows, cast(0 as bigint) as invalid_time, min(epoch) as minimum_epoch, max(epoch) as maximum_epoch,
 cast(0 as bigint) as partition_date_mismatches, cast(0 as bigint) as plant_id_mismatches, count(*) filter (where epoch // 60 % 60 % 10 <> 0) as off_grid from meta""",
)
def device_partition_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = device_table(spark, sf_dir).withColumn("date", local_date("event_time", TZ))
    summary = audit.partition_summary(rows, "event_time", "date", None, TZ, 10)
    return summary.select(
        "rows", "invalid_time", epoch("minimum_time", "minimum_epoch"), epoch("maximum_time", "maximum_epoch"),
        "partition_date_mismatches", "plant_id_mismatches", "off_grid",
    )


@query(
    "duplicate_keys",
    "select cast(sum(n - 1) as bigint) as duplicate_keys from (select count(*) as n from lineitem group by l_suppkey, l_shipdate)",
)
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_shipdate"])


@query(
    "term_counts",
    """select 'l_returnflag' as "column", l_returnflag as value, count(*) as count from lineitem group by l_returnflag
 union all select 'l_linestatus', l_linestatus, count(*) from lineitem group by l_linestatus
 union all select 'l_linenumber', cast(l_linenumber as varchar), count(*) from lineitem group by l_linenumber""",
)
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.several_value_counts(
        table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]
    )


@query("value_counts", "select event_type, count(*) as count from events group by event_type")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.value_counts(table(spark, sf_dir, "events"), "event_type")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events as device rows, in whole minutes."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("user_id") / 15).cast("string").alias("plant_id"),
        F.col("user_id").cast("string").alias("device_no"),
        F.timestamp_seconds(at - F.pmod(at, F.lit(600))).alias("event_time"),
        "value",
    )


SQL_EVENTS = """
er as (
  select user_id // 15 as plant, user_id as dev, cast(floor(epoch(ts) / 600) * 600 as bigint) as epoch, value from events),
ed as (
  select *, epoch - lag(epoch) over (partition by plant, dev order by epoch) as d from er),
co as (
  select plant, dev, count(*) as rows, min(epoch) as first_epoch, max(epoch) as last_epoch, count(*) filter (where d = 0) as duplicate_rows,
         count(*) filter (where d > 3600) as gap_segments,
         cast(coalesce(sum(case when d > 3600 then greatest(cast(round_even(d / 3600.0, 0) as bigint) - 1, 0) end), 0) as bigint) as estimated_missing_points,
         count(*) filter (where d > 0 and d < 3600) as short_or_irregular_intervals
  from ed group by plant, dev)
"""


@query(
    "event_continuity",
    f"""with {SQL_EVENTS} select cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, * exclude (plant, dev) from co""",
)
def event_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = audit.continuity(event_rows(spark, sf_dir), ["plant_id", "device_no"], "event_time", 60)
    return result.select(
        "plant_id", "device_no", "rows", epoch("first_event", "first_epoch"), epoch("last_event", "last_epoch"),
        "duplicate_rows", "gap_segments", "estimated_missing_points", "short_or_irregular_intervals",
    )


@query(
    "continuity_totals",
    f"""with {SQL_EVENTS} select count(*) as unique_devices, cast(sum(rows) as bigint) as rows_total, cast(sum(duplicate_rows) as bigint) as duplicate_rows_total,
 cast(sum(gap_segments) as bigint) as gap_segments_total, cast(sum(estimated_missing_points) as bigint) as estimated_missing_points_total,
 cast(sum(short_or_irregular_intervals) as bigint) as short_or_irregular_intervals_total from co""",
)
def continuity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.continuity_totals(
        audit.continuity(event_rows(spark, sf_dir), ["plant_id", "device_no"], "event_time", 60)
    )


@query(
    "daily_device_counts",
    f"""with {SQL_EVENTS} select strftime(to_timestamp(epoch + 28800)::timestamp, '%Y-%m-%d') as local_date, cast(dev as varchar) as device_no,
 count(*) as rows, min(epoch) as first_epoch, max(epoch) as last_epoch from er group by grouping sets ((1, 2), (1))""",
)
def daily_device_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = audit.daily_device_counts(event_rows(spark, sf_dir), ["device_no"], "event_time", TZ)
    return counts.select(
        F.col("local_date").cast("string").alias("local_date"), "device_no", "rows",
        epoch("first_event", "first_epoch"), epoch("last_event", "last_epoch"),
    )


@query(
    "plant_overview",
    """select cast(user_id // 15 as varchar) as plant_id, count(*) as document_count, min(cast(floor(epoch(ts) / 600) * 600 as bigint)) as minimum_epoch,
 max(cast(floor(epoch(ts) / 600) * 600 as bigint)) as maximum_epoch, count(distinct user_id) as unique_devices_estimate from events group by 1""",
)
def plant_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From stored sketches of every plant and day; numbers as small as here are exact."""
    days = stage(audit.plant_days(event_rows(spark, sf_dir)), "plant-days")
    return audit.overview_of_days(days).select(
        "plant_id", "document_count", epoch("minimum", "minimum_epoch"), epoch("maximum", "maximum_epoch"),
        "unique_devices_estimate",
    )


@query(
    "missing_channels",
    "select * from (with "
    + SQL_VIEWS
    + """, n as (select count(*) as n from meta), k as (select s, count(*) as m from pts group by s)
 select 'string_current_' || lpad(cast(k.s as varchar), 2, '0') as "column", n.n - k.m as missing from k, n)""",
)
def missing_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = device_table(spark, sf_dir)
    return audit.missing_values(rows, [c for c in rows.columns if c.startswith("string_current_")])


@query(
    "export_summary",
    f"""with {SQL_W} select count(*) as rows, min(wt) as minimum_epoch, max(wt) as maximum_epoch, cast(0 as bigint) as invalid_timestamps,
 count(*) filter (where plant = 2) as partition_date_mismatches, count(distinct plant) as plants from wx""",
)
def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.export_summary(dated_weather(spark, sf_dir), "time", "date", None, TZ).select(
        "rows", epoch("minimum", "minimum_epoch"), epoch("maximum", "maximum_epoch"),
        "invalid_timestamps", "partition_date_mismatches", "plants",
    )


@query(
    "plant_alignment",
    f"""with {SQL_W}, dp as (select distinct plant from meta), mw as (select * from wx where plant in (select plant from dp))
select (select count(*) from dp) as target_plants, (select count(*) from dp where plant in (select plant from wx)) as target_plants_present,
 count(*) as matched_rows, round_even(count(*) filter (where sensor_ghi is null) * 100.0 / count(*), 4) as matched_sensor_ghi_null_percent from mw""",
)
def plant_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.plant_alignment(device_table(spark, sf_dir), weather_table(spark, sf_dir), ["sensor_ghi"])
