"""Device rows at labelled times, alone or with their plant's context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringwatch.functions.timegrid import local_date, shift_minutes
from stringwatch.schema import POINT_KEYS, key_text
from stringwatch.storage import stage


def latest_rows(frame: DataFrame, order: str, keys: tuple[str, ...] = POINT_KEYS) -> DataFrame:
    """One row per key: the last by ``order``.

    An aggregation rather than a ranked window, so repeated rows are reduced
    before they are shuffled.
    """
    rest = [c for c in frame.columns if c not in keys]
    return (
        frame.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def labelled_rows(production: DataFrame, labels: DataFrame) -> DataFrame:
    """Production rows whose device-time is labelled (semi join)."""
    return production.join(labels.select(*POINT_KEYS).distinct(), list(POINT_KEYS), "left_semi")


def rows_of_label_days(
    partitioned: DataFrame, labels: DataFrame, start: str, end: str, timezone: str = "Asia/Shanghai"
) -> DataFrame:
    """Rows of a ``plant_id=/date=`` table in the plant-days that hold a label.

    Labels carry their local date; their distinct plant-days, in the range of
    local dates from ``start`` to ``end`` (both included), are written once, so
    that their size is known. While it is below the session's broadcast limit
    the scan reads only those partitions; beyond it the join is a shuffle, and
    the scan is bounded by the range. The date column is dropped.
    """
    days = labels.select(key_text("plant_id").alias("plant_id"), local_date("event_time", timezone).alias("date")).distinct()
    days = stage(days, "label-days").where(F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    dated = partitioned.where(F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return dated.join(days, ["plant_id", "date"], "left_semi").drop("date")


def label_currents(production: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels with the device row at their time (inner join)."""
    distinct = labels.select("alarm_event_id", *POINT_KEYS).distinct()
    return distinct.join(production, list(POINT_KEYS))


def missing_labels(production: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels without a device row (anti join)."""
    distinct = labels.select("alarm_event_id", *POINT_KEYS).distinct()
    return distinct.join(production.select(*POINT_KEYS), list(POINT_KEYS), "left_anti")


def peer_context(
    production: DataFrame, labels: DataFrame, warmup_minutes: int = 15, interval_minutes: int = 5
) -> DataFrame:
    """All devices of a plant at labelled times and the warm-up before them.

    Flags the labelled rows and the rows that only warm up, and lists the alarm
    ids of each labelled row.
    """
    steps = warmup_minutes // interval_minutes
    targets = labels.select("plant_id", "event_time").distinct()
    wanted = (
        targets.select(
            "plant_id",
            F.explode(
                F.transform(
                    F.sequence(F.lit(0), F.lit(steps)),
                    lambda i: F.struct(
                        shift_minutes(F.col("event_time"), -i * interval_minutes).alias("event_time"),
                        (i > 0).alias("warm"),
                    ),
                )
            ).alias("_t"),
        )
        .groupBy("plant_id", F.col("_t.event_time").alias("event_time"))
        .agg(F.min("_t.warm").alias("is_warmup"))
    )
    ids = (
        labels.select(*POINT_KEYS, F.col("alarm_event_id").cast("string").alias("alarm_event_id"))
        .distinct()
        .groupBy(*POINT_KEYS)
        .agg(F.array_join(F.array_sort(F.collect_list("alarm_event_id")), ",").alias("alarm_event_id"))
    )
    return (
        production.join(wanted, ["plant_id", "event_time"])
        .join(ids, list(POINT_KEYS), "left")
        .withColumn("is_alarm_target", F.col("alarm_event_id").isNotNull())
    )
