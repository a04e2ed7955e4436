"""Streaming detectors over the given tables, drained and read back.

Each query streams a table derived from the given ones, ends it by a marker that
moves the watermark past all rows, and returns what the stream has written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringwatch.config import MemorySettings
from stringwatch.operators import strings
from stringwatch.plans.audit_queries import event_rows
from stringwatch.plans.driver_views import device_table, epoch, residual_table
from stringwatch.plans.ewma_queries import SETTINGS as EWMA_SETTINGS
from stringwatch.plans.ewma_queries import SQL_EWMA
from stringwatch.plans.registry import query
from stringwatch.plans.string_queries import SETTINGS, SQL_EVENTS, SQL_SCORES
from stringwatch.storage import staging_root
from stringwatch.streaming import detectors

MEMORY = MemorySettings()


def streamed(spark: SparkSession, frame: DataFrame, time: str | None = None) -> DataFrame:
    """Write a frame once and read its files as a stream; with ``time`` a marker ends it."""
    path = f"{staging_root(spark)}/stream-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    if time is not None:
        detectors.end_marker(spark.read.schema(frame.schema).parquet(path), time).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frame.schema).parquet(path)


def drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run a stream over what is available and return its output."""
    root = f"{staging_root(spark)}/drain-{uuid.uuid4().hex}"
    running = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    if running.exception() is not None:
        raise running.exception()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query(
    "stream_string_scores",
    f"""with {SQL_SCORES} select cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, epoch as event_epoch,
 cast(s as integer) as string_no, round(score, 6) as lof_score from scored""",
)
def stream_string_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streamed(spark, device_table(spark, sf_dir))
    return drained(spark, detectors.stream_scores(rows, SETTINGS)).select(
        "plant_id", "device_no", epoch("event_time", "event_epoch"), "string_no", F.round("lof_score", 6).alias("lof_score")
    )


@query(
    "stream_gap_monitor",
    """with e as (select user_id // 15 as plant, user_id as dev, cast(floor(epoch(ts) / 600) * 600 as bigint) as t from events),
w as (select plant, dev, t // 86400 * 86400 as w, count(*) as n from e group by all),
d as (select plant, dev, unnest(generate_series(min(w), (select max(w) from w), 86400)) as w from w group by plant, dev)
select cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, d.w as window_epoch, coalesce(n, 0) as points,
 greatest(24 - coalesce(n, 0), 0) as missing_points from d left join w using (plant, dev, w)""",
)
def stream_gap_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each device's first day to the last day of all."""
    detectors.use_state_store(spark)
    events = event_rows(spark, sf_dir)
    last = events.agg(F.date_trunc("day", F.max("event_time"))).first()[0]
    rows = streamed(spark, events, "event_time")
    watched = drained(spark, detectors.stream_gaps(rows, 60, 1_440))
    return watched.where(F.col("window_start") <= F.lit(last)).select(
        "plant_id", "device_no", epoch("window_start", "window_epoch"), "points",
        F.col("missing_points").cast("long").alias("missing_points"),
    )


@query(
    "stream_alert_events",
    f"""with {SQL_EVENTS} select cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, cast(s as integer) as string_no,
 st_epoch as start_epoch, en_epoch as end_epoch, points from ev""",
)
def stream_alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = strings.apply_string_detector(device_table(spark, sf_dir), SETTINGS).where("combined_alert = 1")
    rows = streamed(spark, alerts.select("event_time", "plant_id", "device_no", "string_no"), "event_time")
    return drained(spark, detectors.stream_events(rows)).select(
        "plant_id", "device_no", "string_no", epoch("start_time", "start_epoch"), epoch("end_time", "end_epoch"), "points"
    )


SQL_STREAM_MEMORY = (
    SQL_SCORES
    + """,
mq as (
  select plant, dev, s, epoch, score is not null as ok, raw, row_number() over (partition by plant, dev, s order by epoch) as i from alert),
mm as (
  select plant, dev, s, epoch, i, ok, (ok and raw)::int as streak, (ok and not raw)::int as normals, ok and raw and 1 >= ENTER as act from mq where i = 1
  union all
  select n.plant, n.dev, n.s, n.epoch, n.i, n.ok,
         case when n.ok and n.raw then case when n.epoch - m.epoch = 300 then m.streak else 0 end + 1 else 0 end,
         case when n.ok and not n.raw then case when n.epoch - m.epoch = 300 then m.normals else 0 end + 1 else 0 end,
         case when not n.ok then false
              when n.raw then (n.epoch - m.epoch = 300 and m.act) or case when n.epoch - m.epoch = 300 then m.streak else 0 end + 1 >= ENTER
              else n.epoch - m.epoch = 300 and m.act and m.normals + 1 < CLEAR end
  from mm m join mq n on m.plant = n.plant and m.dev = n.dev and m.s = n.s and n.i = m.i + 1)
"""
).replace("ENTER", str(MEMORY.entry_consecutive)).replace("CLEAR", str(MEMORY.clear_consecutive))


@query(
    "stream_memory_alerts",
    f"""with recursive {SQL_STREAM_MEMORY} select cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, cast(s as integer) as string_no,
 epoch as event_epoch, streak, cast(act as integer) as memory_active, cast(act and streak > 0 as integer) as memory_alert from mm""",
)
def stream_memory_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    detectors.use_state_store(spark)
    points = strings.apply_string_detector(device_table(spark, sf_dir), SETTINGS)
    rows = streamed(
        spark, points.select("event_time", "plant_id", "device_no", "string_no", "lof_raw_alert", "lof_eligible"), "event_time"
    )
    return drained(spark, detectors.stream_memory(rows, F.col("lof_raw_alert") == 1, F.col("lof_eligible"), MEMORY)).select(
        "plant_id", "device_no", "string_no", epoch("event_time", "event_epoch"), "streak", "memory_active", "memory_alert"
    )


@query(
    "stream_ewma_scores",
    f"""with recursive {SQL_EWMA} select cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, day * 86400 as target_epoch,
 round(case when ok then s end, 6) as ewma_score from ew""",
)
def stream_ewma_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    detectors.use_state_store(spark)
    rows = streamed(spark, residual_table(spark, sf_dir), "target_time")
    return drained(spark, detectors.stream_ewma(rows, EWMA_SETTINGS)).select(
        "plant_id", "device_no", epoch("target_time", "target_epoch"), F.round("ewma_score", 6).alias("ewma_score")
    )
