"""Detectors on streaming DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stringwatch.config import EwmaSettings, LofSettings, MemorySettings
from stringwatch.operators.ewma import prepare_residuals
from stringwatch.operators.strings import score_strings
from stringwatch.schema import DEVICE_KEYS, SOURCE_PLANT, STRING_KEYS
from stringwatch.streaming.processors import Bucketed, EventProcessor, EwmaProcessor, GapProcessor, MemoryProcessor, OrderedProcessor
from stringwatch.streaming.watch import QUALITY, WITHOUT_TIME

#: groups of keys that share a state; a bucket's rows of one batch fit a task by far
BUCKETS = 1_024
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def stream_scores(wide: DataFrame, settings: LofSettings) -> DataFrame:
    """String scores of a stream of wide rows; stateless, no watermark needed."""
    return score_strings(wide, settings)


def _keyed(frame: DataFrame, keys: Sequence[str], time: str, delay: str, *payload: Column) -> tuple[DataFrame, str]:
    """Keys, time and payload behind a watermark, and the schema of the keys.

    A source plant is one of the keys where there is one, since two plants that
    share a model plant may own devices of the same number. Rows without time
    belong nowhere: they are counted in the metrics of the stream and left out.
    """
    named = [*keys, SOURCE_PLANT] if SOURCE_PLANT in frame.columns else list(keys)
    kinds = {name: "int" if name == "string_no" else "string" for name in named}
    counted = frame.observe(QUALITY, F.count_if(F.col(time).isNull()).alias(WITHOUT_TIME))
    prepared = counted.where(F.col(time).isNotNull()).select(
        *[F.col(n).cast(k).alias(n) for n, k in kinds.items()], time, F.unix_micros(F.col(time).cast("timestamp")).alias("time_us"), *payload
    )
    return prepared.withWatermark(time, delay), ", ".join(f"{n} {k}" for n, k in kinds.items())


def _transformed(prepared: DataFrame, key_schema: str, processor: OrderedProcessor | GapProcessor) -> DataFrame:
    use_state_store(prepared.sparkSession)
    keys = [field.split()[0] for field in key_schema.split(", ")]
    bucketed = Bucketed(processor, key_schema)
    grouped = prepared.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")).groupBy("_bucket")
    return grouped.transformWithStateInPandas(bucketed, bucketed.output_schema(), "Append", "EventTime")


def stream_memory(
    points: DataFrame,
    raw: Column,
    evaluable: Column,
    settings: MemorySettings = MemorySettings(),
    delay: str = "15 minutes",
) -> DataFrame:
    """Streaks and remembered alerts per string, emitted behind the watermark."""
    prepared, schema = _keyed(
        points, STRING_KEYS, "event_time", delay,
        F.coalesce(raw.cast("boolean"), F.lit(False)).alias("raw"),
        F.coalesce(evaluable.cast("boolean"), F.lit(False)).alias("evaluable"),
    )
    processor = MemoryProcessor(settings.interval_minutes, settings.entry_consecutive, settings.clear_consecutive)
    return _transformed(prepared, schema, processor).withColumn("event_time", F.timestamp_micros("time_us")).drop("time_us")


def stream_ewma(frame: DataFrame, settings: EwmaSettings, delay: str = "15 minutes") -> DataFrame:
    """EWMA scores per device, emitted behind the watermark."""
    prepared, schema = _keyed(
        prepare_residuals(frame, settings), DEVICE_KEYS, "target_time", delay,
        F.col("underproduction_residual"),
        F.coalesce("ewma_eligible", F.lit(False)).alias("ewma_eligible"),
    )
    processor = EwmaProcessor(settings.weight, settings.center, settings.scale, settings.interval_minutes)
    return _transformed(prepared, schema, processor).withColumn("target_time", F.timestamp_micros("time_us")).drop("time_us")


def stream_gaps(
    frame: DataFrame,
    interval_minutes: int = 5,
    window_minutes: int = 60,
    delay: str = "15 minutes",
    silent_windows: int = 1_000,
) -> DataFrame:
    """Points per device and window against the expected number, silent windows included.

    A device is watched from its first window on; the watermark of all devices
    closes its windows, so one that falls silent is reported too.
    """
    expected = window_minutes // interval_minutes
    prepared, schema = _keyed(frame, DEVICE_KEYS, "event_time", delay)
    counted = _transformed(prepared, schema, GapProcessor(window_minutes, silent_windows))
    return counted.select(
        F.timestamp_millis("window_ms").alias("window_start"),
        *[c for c in counted.columns if c not in ("window_ms", "points")],
        "points",
        F.greatest(F.lit(expected) - F.col("points"), F.lit(0)).alias("missing_points"),
    )


def end_marker(frame: DataFrame, time: str = "event_time", days_ahead: int = 30) -> DataFrame:
    """One row without keys, far behind the last one of a bounded replay.

    Streamed last, it moves the watermark past all other rows, so that nothing
    is left in state; it is itself never released.
    """
    last = frame.agg((F.max(time) + F.expr(f"interval {days_ahead} days")).alias(time)).where(F.col(time).isNotNull())
    return last.select(
        *[F.col(time).cast(f.dataType).alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in frame.schema.fields]
    )


def stream_events(alerts: DataFrame, interval_minutes: int = 5, delay: str = "15 minutes") -> DataFrame:
    """Events of alerts in exact intervals, closed once the watermark passes the place of the next point.

    Points may lie off the grid and repeat; the runs are those of
    :func:`stringwatch.operators.runs.collapse`.
    """
    prepared, schema = _keyed(alerts, STRING_KEYS, "event_time", delay, F.lit(True).alias("alert"))
    found = _transformed(prepared, schema, EventProcessor(interval_minutes))
    return found.withColumns({"start_time": F.timestamp_micros("start_us"), "end_time": F.timestamp_micros("end_us")}).drop("start_us", "end_us")
