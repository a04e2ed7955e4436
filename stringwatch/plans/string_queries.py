"""Queries of the string detector on raw currents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringwatch.config import LofSettings
from stringwatch.operators import strings
from stringwatch.plans.driver_views import SQL_VIEWS, device_table, epoch
from stringwatch.plans.registry import query
from stringwatch.sources import sinks, telemetry
from stringwatch.storage import staging_path

SETTINGS = LofSettings(threshold=1.6)

# scores by a ranked self join: k nearest by (distance, string number)
SQL_SCORES = (
    SQL_VIEWS
    + """,
elig as (
  select * from meta where active_power / 100.0 between 0.1 and 1.1 and status_code in (1, 4) and valid_strings > 0),
outp as (
  select p.*, e.active_power, c <= 0 as zero from pts p join elig e using (plant, dev, slot)),
peer as (
  select *, count(*) over g as np, median(c) over g as med from outp where not zero
  window g as (partition by plant, dev, slot)),
rat as (select plant, dev, slot, s, c / med as r from peer where np >= 6 and med > 0),
near as (
  select a.plant, a.dev, a.slot, a.s, b.s as j, abs(a.r - b.r) as d,
         row_number() over (partition by a.plant, a.dev, a.slot, a.s order by abs(a.r - b.r), b.s) as k
  from rat a join rat b on a.plant = b.plant and a.dev = b.dev and a.slot = b.slot and a.s <> b.s),
knn as (select * from near where k <= 5),
kdist as (select plant, dev, slot, s, max(d) as kd from knn group by all),
lrd as (
  select a.plant, a.dev, a.slot, a.s, 1.0 / avg(greatest(a.d, b.kd, 0.01)) as l
  from knn a join kdist b on a.plant = b.plant and a.dev = b.dev and a.slot = b.slot and a.j = b.s group by all),
lof as (
  select a.plant, a.dev, a.slot, a.s, avg(b.l) / any_value(o.l) as score
  from knn a join lrd b on a.plant = b.plant and a.dev = b.dev and a.slot = b.slot and a.j = b.s
  join lrd o on a.plant = o.plant and a.dev = o.dev and a.slot = o.slot and a.s = o.s
  group by a.plant, a.dev, a.slot, a.s),
scored as (
  select o.plant, o.dev, o.epoch, o.slot, o.s, o.c, o.st, o.zero, o.active_power, rat.r, lof.score
  from outp o left join rat using (plant, dev, slot, s) left join lof using (plant, dev, slot, s)),
raw as (
  select *, coalesce(score >= 1.6 and r <= 0.9, false) as raw from scored),
brk as (
  select *, row_number() over g as rn,
         coalesce(epoch - lag(epoch) over g <> 300, true) as gap from raw
  window g as (partition by plant, dev, s order by epoch)),
strk as (
  select *, case when raw then rn - coalesce(max(case when not raw then rn when gap then rn - 1 end) over g, 0) else 0 end as streak
  from brk window g as (partition by plant, dev, s order by epoch rows unbounded preceding)),
alert as (
  select *, streak >= 2 as lof_alert, (streak >= 2) or zero as combined from strk)
"""
)


@query(
    "string_outlier_scores",
    f"""with {SQL_SCORES}
select cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, epoch as event_epoch,
       cast(s as integer) as string_no, round(c, 6) as string_current, cast(st as integer) as string_status,
       round(r, 6) as string_current_ratio, round(score, 6) as lof_score,
       cast(score is not null as integer) as lof_eligible, cast(zero as integer) as zero_current_alert,
       cast(st = 2 as integer) as weak_low, cast(st = 4 as integer) as weak_zero
from scored""",
)
def string_outlier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = strings.score_strings(device_table(spark, sf_dir), SETTINGS)
    return scored.select(
        "plant_id",
        "device_no",
        epoch("event_time", "event_epoch"),
        "string_no",
        F.round("string_current", 6).alias("string_current"),
        "string_status",
        F.round("string_current_ratio", 6).alias("string_current_ratio"),
        F.round("lof_score", 6).alias("lof_score"),
        F.col("lof_eligible").cast("int").alias("lof_eligible"),
        "zero_current_alert",
        F.col("weak_low_current_label").cast("int").alias("weak_low"),
        F.col("weak_zero_current_label").cast("int").alias("weak_zero"),
    )


@query(
    "string_alert_points",
    f"""with {SQL_SCORES}
select cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, epoch as event_epoch,
       cast(s as integer) as string_no, cast(raw as integer) as lof_raw_alert,
       cast(streak as integer) as lof_consecutive, cast(lof_alert as integer) as lof_alert,
       cast(combined as integer) as combined_alert
from alert""",
)
def string_alert_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = strings.apply_string_detector(device_table(spark, sf_dir), SETTINGS)
    return alerts.select(
        "plant_id", "device_no", epoch("event_time", "event_epoch"), "string_no",
        "lof_raw_alert", "lof_consecutive", "lof_alert", "combined_alert",
    )


SQL_EVENTS = (
    SQL_SCORES
    + """,
isl as (
  select *, sum(case when new then 1 else 0 end) over (partition by plant, dev, s order by epoch) as island
  from (select *, coalesce(epoch - lag(epoch) over (partition by plant, dev, s order by epoch) <> 300, true) as new
        from alert where combined)),
ev as (
  select plant, dev, s, min(epoch) as st_epoch, max(epoch) as en_epoch, count(*) as points,
         sum(zero::int) as zero_points, sum(lof_alert::int) as lof_points, min(c) as min_c, min(r) as min_r, max(score) as max_score
  from isl group by plant, dev, s, island)
"""
)


@query(
    "string_events",
    f"""with {SQL_EVENTS}
select cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, cast(s as integer) as string_no,
       st_epoch as start_epoch, en_epoch as end_epoch, points, cast(zero_points as bigint) as zero_current_points,
       cast(lof_points as bigint) as lof_points, round(min_c, 6) as minimum_current,
       round(min_r, 6) as minimum_current_ratio, round(max_score, 6) as maximum_lof_score,
       (en_epoch - st_epoch) / 60.0 + 5 as duration_minutes
from ev""",
)
def string_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = strings.string_events(strings.apply_string_detector(device_table(spark, sf_dir), SETTINGS))
    return events.select(
        "plant_id", "device_no", "string_no",
        F.unix_seconds("start_time").alias("start_epoch"),
        F.unix_seconds("end_time").alias("end_epoch"),
        "points", "zero_current_points", "lof_points",
        F.round("minimum_current", 6).alias("minimum_current"),
        F.round("minimum_current_ratio", 6).alias("minimum_current_ratio"),
        F.round("maximum_lof_score", 6).alias("maximum_lof_score"),
        F.col("duration_minutes").cast("double").alias("duration_minutes"),
    )


FIT = LofSettings(quantile=0.985)

SQL_NORMAL = """
normal as (select score from scored where score is not null and st = 1),
fit as (select quantile_cont(score, 0.985) as threshold, quantile_cont(score, 0.5) as med, max(score) as top, count(*) as n from normal)
"""
# alerts as above, with the fitted threshold in place of the given one
SQL_FITTED = SQL_SCORES.replace("raw as (", SQL_NORMAL.strip() + ",\nraw as (", 1).replace("score >= 1.6", "score >= (select threshold from fit)")


@query(
    "string_threshold",
    f"""with {SQL_SCORES},{SQL_NORMAL}
select round(threshold, 6) as threshold, round(med, 6) as score_median, round(top, 6) as score_maximum, n as normal_calibration_samples,
       (select count(*) from (select distinct plant, dev, epoch from scored)) as wide_samples, (select count(*) from scored) as string_samples,
       (select count(*) from scored where score is not null) as eligible_nonzero_samples,
       (select count(*) from scored where zero) as zero_current_samples
from fit""",
)
def string_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted threshold and its report, one row."""
    _, report = strings.fit_string_threshold(device_table(spark, sf_dir), FIT)
    rounded = {k: round(report[k], 6) for k in ("threshold", "score_median", "score_maximum")}
    counts = ("normal_calibration_samples", "wide_samples", "string_samples", "eligible_nonzero_samples", "zero_current_samples")
    return spark.createDataFrame(
        [tuple(rounded.values()) + tuple(report[k] for k in counts)],
        ", ".join([f"{k} double" for k in rounded] + [f"{k} bigint" for k in counts]),
    )


@query(
    "stored_string_alerts",
    f"""with {SQL_FITTED}
select cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, epoch as event_epoch, cast(s as integer) as string_no,
       cast(raw as integer) as lof_raw_alert, cast(combined as integer) as combined_alert
from alert""",
)
def stored_string_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit, write the fit, read it back and apply it."""
    rows, path = device_table(spark, sf_dir), staging_path(spark, "string-model")
    sinks.save_model(spark, path, strings.fit_string_threshold(rows, FIT)[0])
    alerts = strings.apply_string_detector(rows, sinks.load_settings(spark, path, LofSettings))
    return alerts.select(
        "plant_id", "device_no", epoch("event_time", "event_epoch"), "string_no", "lof_raw_alert", "combined_alert"
    )


@query(
    "mapped_string_events",
    f"""with {SQL_EVENTS}
select cast(plant as varchar) as plant_id, case when plant % 2 = 1 then cast(plant - 1 as varchar) else cast(plant as varchar) end as model_plant_id,
       cast(dev % 10 as varchar) as device_no, cast(s as integer) as string_no, st_epoch as start_epoch, en_epoch as end_epoch, points,
       round(max_score, 6) as maximum_lof_score
from ev""",
)
def mapped_string_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plants that share a model plant own devices of the same numbers; their strings stay apart."""
    rows = device_table(spark, sf_dir).withColumn("device_no", (F.col("device_no").cast("long") % 10).cast("string"))
    plants = sorted(int(r[0]) for r in rows.select("plant_id").distinct().collect())  # the mapping is a list of plants
    mapped = telemetry.apply_plant_mapping(rows, {str(p): str(p - 1) for p in plants if p % 2 == 1})
    events = strings.string_events(strings.apply_string_detector(mapped, SETTINGS))
    return telemetry.restore_plants(events).select(
        "plant_id", "model_plant_id", "device_no", "string_no", F.unix_seconds("start_time").alias("start_epoch"),
        F.unix_seconds("end_time").alias("end_epoch"), "points", F.round("maximum_lof_score", 6).alias("maximum_lof_score"),
    )
