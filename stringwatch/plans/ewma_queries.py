"""Queries of the EWMA chart on daily residuals of event users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringwatch.config import EwmaSettings
from stringwatch.functions.timegrid import local_date
from stringwatch.operators import evaluate, ewma, review, runs
from stringwatch.plans.driver_views import SQL_RESIDUALS, epoch, residual_table
from stringwatch.plans.registry import query
from stringwatch.storage import stage

DAY = 1_440
FIT = EwmaSettings(interval_minutes=DAY)
SETTINGS = EwmaSettings(interval_minutes=DAY, center=0.01, scale=0.12, threshold=0.4)


def keys():
    return "plant_id", "device_no", epoch("target_time", "target_epoch")


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


KEYS_SQL = "cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, day * 86400 as target_epoch"

# the recursion itself, one step per row of a device
SQL_EWMA = (
    SQL_RESIDUALS
    + """,
sq as (select *, row_number() over (partition by plant, dev order by day) as i from res),
ew as (
  select plant, dev, day, i, u, ok, case when ok then 0.2 * (u - 0.01) / 0.12 else 0.0 end as s from sq where i = 1
  union all
  select n.plant, n.dev, n.day, n.i, n.u, n.ok,
         case when n.ok then 0.2 * (n.u - 0.01) / 0.12 + 0.8 * (case when n.day - e.day = 1 then e.s else 0.0 end) else 0.0 end
  from ew e join sq n on e.plant = n.plant and e.dev = n.dev and n.i = e.i + 1),
ea as (select *, ok and s > 0.4 as raw from ew),
eb as (select *, row_number() over g as rn, coalesce(day - lag(day) over g <> 1, true) as brk from ea window g as (partition by plant, dev order by day)),
ec as (
  select *, case when raw then rn - coalesce(max(case when not raw then rn when brk then rn - 1 end) over g, 0) else 0 end as n
  from eb window g as (partition by plant, dev order by day rows unbounded preceding)),
wl as (select *, day % 3 = dev % 3 as weak, n >= 2 as alert from ec)
"""
)


@query(
    "residual_eligibility",
    f"with {SQL_RESIDUALS} select {KEYS_SQL}, round(u, 6) as underproduction_residual, cast(ok as integer) as ewma_eligible from res",
)
def residual_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = ewma.prepare_residuals(residual_table(spark, sf_dir), SETTINGS)
    return prepared.select(*keys(), *r6("underproduction_residual"), F.col("ewma_eligible").cast("int").alias("ewma_eligible"))


@query(
    "ewma_center_scale",
    f"""with {SQL_RESIDUALS}, ok as (select u from res where ok), m as (select median(u) as c from ok)
select round(any_value(c), 6) as center, round(1.4826 * median(abs(u - c)), 6) as scale, count(*) as samples from ok, m""",
)
def ewma_center_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(ewma.prepare_residuals(residual_table(spark, sf_dir), FIT).where("ewma_eligible"), "residuals")
    center, scale = ewma.robust_center_scale(rows, "underproduction_residual")
    return rows.agg(F.count(F.lit(1)).alias("samples")).select(
        F.round(F.lit(center), 6).alias("center"), F.round(F.lit(scale), 6).alias("scale"), "samples"
    )


@query(
    "ewma_center_scale_by_device",
    f"""with {SQL_RESIDUALS}, ok as (select plant, dev, u from res where ok), m as (select plant, dev, median(u) as c from ok group by all),
d as (select plant, dev, any_value(c) as c, median(abs(u - c)) * 1.4826 as k, stddev_pop(u) as sd, count(*) as n from ok join m using (plant, dev) group by plant, dev)
select cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, n, round(c, 6) as center,
 round(case when k >= 1e-6 then k when sd >= 1e-6 then sd else 1.0 end, 6) as scale from d""",
)
def ewma_center_scale_by_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(ewma.prepare_residuals(residual_table(spark, sf_dir), FIT).where("ewma_eligible"), "residuals")
    result = ewma.residual_baseline_scale(rows, "underproduction_residual", ("plant_id", "device_no"))
    return result.select("plant_id", "device_no", "n", *r6("center", "scale"))


@query(
    "ewma_scores",
    f"with recursive {SQL_EWMA} select {KEYS_SQL}, round(case when ok then s end, 6) as ewma_score from ew",
)
def ewma_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = ewma.prepare_residuals(residual_table(spark, sf_dir), SETTINGS)
    return ewma.ewma_scores(prepared, SETTINGS).select(*keys(), *r6("ewma_score"))


@query(
    "ewma_alerts",
    f"with recursive {SQL_EWMA} select {KEYS_SQL}, cast(raw as integer) as ewma_raw_alert, cast(n as integer) as ewma_consecutive, cast(n >= 2 as integer) as ewma_alert from ec",
)
def ewma_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ewma.apply_ewma(residual_table(spark, sf_dir), SETTINGS).select(
        *keys(), "ewma_raw_alert", "ewma_consecutive", "ewma_alert"
    )


@query(
    "ewma_threshold",
    f"""with recursive {SQL_RESIDUALS}, ok0 as (select u from res where ok), c0 as (select median(u) as c from ok0),
k0 as (select any_value(c) as c, 1.4826 * median(abs(u - c)) as k from ok0, c0),
sq as (select *, row_number() over (partition by plant, dev order by day) as i from res),
ew as (
  select plant, dev, day, i, ok, case when ok then 0.2 * (u - c) / k else 0.0 end as s from sq, k0 where i = 1
  union all
  select n.plant, n.dev, n.day, n.i, n.ok, case when n.ok then 0.2 * (n.u - c) / k + 0.8 * (case when n.day - e.day = 1 then e.s else 0.0 end) else 0.0 end
  from ew e join sq n on e.plant = n.plant and e.dev = n.dev and n.i = e.i + 1 cross join k0)
select round(quantile_cont(s, 0.995), 6) as threshold, count(*) as eligible_samples from ew where ok""",
)
def ewma_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted, report = ewma.fit_ewma(residual_table(spark, sf_dir), FIT)
    return spark.createDataFrame(
        [(fitted.threshold, report["eligible_samples"])], "threshold double, eligible_samples long"
    ).withColumn("threshold", F.round("threshold", 6))


def weak_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device statuses: abnormal on every third day of a device."""
    rows = residual_table(spark, sf_dir)
    day = F.floor(F.unix_seconds("target_time") / 86_400)
    weak = F.pmod(day, F.lit(3)) == F.pmod(F.col("device_no").cast("long"), F.lit(3))
    return rows.select(
        "plant_id", "device_no", F.col("target_time").alias("event_time"),
        F.when(weak, 2 + F.pmod(day, F.lit(2)) * 2).otherwise(1).cast("int").alias("string_overall_status"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = ewma.apply_ewma(residual_table(spark, sf_dir), SETTINGS)
    return evaluate.weak_label_alignment(alerts, weak_statuses(spark, sf_dir))


@query(
    "weak_label_alignment",
    f"with recursive {SQL_EWMA} select {KEYS_SQL}, cast(weak as integer) as weak_current_label, cast(alert as integer) as ewma_alert from wl",
)
def weak_label_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select(*keys(), "weak_current_label", "ewma_alert")


@query(
    "alert_distribution_by_date",
    f"""with recursive {SQL_EWMA} select strftime(to_timestamp(day * 86400)::timestamp, '%Y-%m-%d') as local_date, count(*) as samples,
 count(*) filter (where alert) as ewma_alert_points, count(*) filter (where weak) as weak_current_label_points,
 round(count(*) filter (where alert) / count(*), 6) as ewma_alert_rate, round(count(*) filter (where weak) / count(*), 6) as weak_current_label_rate from wl group by 1""",
)
def alert_distribution_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).withColumn("local_date", local_date("target_time", "UTC").cast("string"))
    result = evaluate.distribution_table(rows, ["local_date"], ["ewma_alert", "weak_current_label"])
    return result.withColumns({c: F.round(c, 6) for c in ("ewma_alert_rate", "weak_current_label_rate")})


@query(
    "ewma_events",
    f"""with recursive {SQL_EWMA}, v0 as (select *, coalesce(day - lag(day) over (partition by plant, dev order by day) <> 1, true) as nw from wl where alert),
v1 as (select *, sum(nw::int) over (partition by plant, dev order by day) as run from v0)
select cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, min(day) * 86400 as start_epoch, max(day) * 86400 as end_epoch, count(*) as points
from v1 group by plant, dev, run""",
)
def ewma_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = runs.collapse(
        ewma.apply_ewma(residual_table(spark, sf_dir), SETTINGS), ewma.device_timeline(DAY), F.col("ewma_alert") == 1
    )
    return events.select(
        "plant_id", "device_no", epoch("start_time", "start_epoch"), epoch("end_time", "end_epoch"), "points"
    )


@query(
    "review_windows",
    f"""with recursive {SQL_EWMA}, v0 as (select *, coalesce(day - lag(day) over (partition by plant, dev order by day) <> 1, true) as nw from wl where alert),
v1 as (select *, sum(nw::int) over (partition by plant, dev order by day) as run from v0),
ev as (select plant, dev, min(day) as a, max(day) as b from v1 group by plant, dev, run order by a, cast(plant as varchar), cast(dev as varchar) limit 10)
select cast(w.plant as varchar) as plant_id, cast(w.dev as varchar) as device_no, w.day * 86400 as target_epoch, ev.a * 86400 as review_epoch, 'ewma' as review_event_type,
 cast(case when w.weak then 2 + w.day % 2 * 2 else 1 end as integer) as string_overall_status
from wl w join ev on w.plant = ev.plant and w.dev = ev.dev and w.day between ev.a - 2 and ev.b + 2""",
)
def review_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = labelled(spark, sf_dir)
    events = runs.collapse(alerts, ewma.device_timeline(DAY), F.col("ewma_alert") == 1)
    rows = review.review_windows(
        alerts, events, "ewma", ["start_time", "plant_id", "device_no"], 10, 2 * DAY, weak_statuses(spark, sf_dir)
    )
    return rows.select(
        *keys(), epoch("review_event_start", "review_epoch"), "review_event_type", "string_overall_status"
    )
