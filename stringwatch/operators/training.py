"""Forecast features: quality, targets, splits, peers, windows, baselines."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stringwatch.config import Settings
from stringwatch.functions.timegrid import MICROS_PER_MINUTE, local_date, local_time, shift_minutes
from stringwatch.operators import runs
from stringwatch.operators.asof import asof_join
from stringwatch.operators.irradiance import leave_one_out_median
from stringwatch.schema import DEVICE_KEYS, number


@dataclass(frozen=True)
class TrainingSettings(Settings):
    """Limits of normal operation and the chronological split (dates exclusive)."""

    train_end: str = "2026-06-01"
    validation_end: str = "2026-07-01"
    test_end: str = "2026-07-23"
    timezone: str = "Asia/Shanghai"
    running_status_code: int = 1
    interval_minutes: int = 5
    maximum_power_ratio: float = 1.1
    minimum_temperature: float = 0.0
    maximum_temperature: float = 80.0
    weather_tolerance_minutes: int = 15


def split_of(time: Column, settings: TrainingSettings) -> Column:
    """train, validation or test by local date; null after the last."""
    day = local_date(time, settings.timezone)
    return (
        F.when(day < F.to_date(F.lit(settings.train_end)), "train")
        .when(day < F.to_date(F.lit(settings.validation_end)), "validation")
        .when(day < F.to_date(F.lit(settings.test_end)), "test")
    )


def device_line(settings: TrainingSettings, chunk_minutes: int | None = None) -> runs.Timeline:
    return runs.Timeline(DEVICE_KEYS, "event_time", settings.interval_minutes, chunk_minutes)


def add_quality_and_targets(
    frame: DataFrame, settings: TrainingSettings = TrainingSettings(), chunk_minutes: int | None = None
) -> DataFrame:
    """Quality flags, the power exactly one interval later, and usable rows.

    A row is a candidate when it and its target are good and both fall into the
    same split. The optional total power does not count when it is missing.
    """
    if "plant_id" not in frame.columns:
        frame = frame.withColumn("plant_id", F.lit("").cast("string"))
    power, rated = number("active_power"), number("rated_power")
    ratio = F.when(rated > 0, power / rated)
    temperature = number("device_temperature")
    rows = frame.withColumns(
        {
            "device_key": F.concat_ws("::", F.col("plant_id").cast("string"), F.col("device_no").cast("string")),
            "active_power_ratio": ratio,
            "quality_finite": power.isNotNull()
            & rated.isNotNull()
            & temperature.isNotNull()
            & number("dc_power").isNotNull(),
            "quality_running": F.coalesce(F.col("status_code") == settings.running_status_code, F.lit(False)),
            "quality_power": F.coalesce((power > 0) & (rated > 0), F.lit(False)),
            "quality_ratio": F.coalesce(ratio <= settings.maximum_power_ratio, F.lit(False)),
            "quality_temperature": F.coalesce(
                temperature.between(settings.minimum_temperature, settings.maximum_temperature), F.lit(False)
            ),
            "split": split_of(F.col("event_time"), settings),
        }
    ).withColumn(
        "quality_point",
        F.col("quality_finite")
        & F.col("quality_running")
        & F.col("quality_power")
        & F.col("quality_ratio")
        & F.col("quality_temperature"),
    )
    following = Window.partitionBy(*DEVICE_KEYS).orderBy("event_time")
    ahead = F.lead(F.struct("event_time", "active_power", "quality_point", "split")).over(following)
    if chunk_minutes is not None:
        # the same look-ahead on a mirrored clock, chunk by chunk
        mirrored = runs.Timeline(DEVICE_KEYS, "_mirror", settings.interval_minutes, chunk_minutes)
        rows = rows.withColumn("_mirror", F.timestamp_micros(-F.unix_micros("event_time")))
        rows = runs.with_previous(
            rows, mirrored, {"_ahead": F.struct("event_time", "active_power", "quality_point", "split")}
        ).drop("_mirror")
    else:
        rows = rows.withColumn("_ahead", ahead)
    exact = (
        F.unix_micros("_ahead.event_time") - F.unix_micros("event_time")
        == settings.interval_minutes * MICROS_PER_MINUTE
    )
    follows = F.coalesce(exact, F.lit(False))
    return rows.withColumns(
        {
            "target_time": shift_minutes(F.col("event_time"), settings.interval_minutes),
            "target_active_power": F.when(follows, F.col("_ahead.active_power")),
            "quality_continuity": follows,
            "candidate_normal": follows
            & F.col("quality_point")
            & F.coalesce(F.col("_ahead.quality_point"), F.lit(False))
            & F.coalesce(F.col("split") == F.col("_ahead.split"), F.lit(False)),
        }
    ).drop("_ahead")


def add_time_features(frame: DataFrame, timezone: str = "Asia/Shanghai") -> DataFrame:
    """Power ratios and the position in day and year on circles."""
    local = local_time("event_time", timezone)
    day = 2 * math.pi * (F.hour(local) * 60 + F.minute(local)) / 1440
    year = 2 * math.pi * F.dayofyear(local) / 365.25
    rated = number("rated_power")
    return frame.withColumns(
        {
            "active_power_ratio": F.when(rated > 0, number("active_power") / rated),
            "dc_power_ratio": F.when(rated > 0, number("dc_power") / rated),
            "day_sin": F.sin(day),
            "day_cos": F.cos(day),
            "year_sin": F.sin(year),
            "year_cos": F.cos(year),
        }
    )


def add_peer_power(frame: DataFrame, minimum_peers: int = 3, interval_minutes: int = 5) -> DataFrame:
    """Median power ratio of the plant's other devices, and its ramp."""
    result = leave_one_out_median(
        frame, ("plant_id", "event_time"), "device_no", "active_power_ratio", "_peer", "peer_count"
    )
    enough = F.col("peer_count") >= minimum_peers
    result = result.withColumns(
        {
            "peer_median_power_ratio": F.when(enough, F.col("_peer")),
            "peer_power_available": F.coalesce(enough, F.lit(False)).cast("double"),
        }
    ).drop("_peer")
    line = runs.Timeline(DEVICE_KEYS, "event_time", interval_minutes)
    result = runs.with_previous(
        result, line, {"_previous_time": F.col("event_time"), "_previous_peer": F.col("peer_median_power_ratio")}
    )
    ramp = F.when(runs.follows(line), F.col("peer_median_power_ratio") - F.col("_previous_peer"))
    return result.withColumn("peer_median_ramp_ratio", ramp).drop("_previous_time", "_previous_peer")


def attach_weather(
    frame: DataFrame, weather: DataFrame, settings: TrainingSettings = TrainingSettings(), offset_minutes: int = 0
) -> DataFrame:
    """Latest weather slot at or before each row, with a match flag."""
    columns = [c for c in ("forecast_ghi", "sensor_ghi") if c in weather.columns]
    slots = weather.withColumn("slot_time", shift_minutes(F.col("time"), -offset_minutes)).select(
        "plant_id", "slot_time", *columns
    )
    joined = asof_join(
        frame, slots, ["plant_id"], "event_time", "slot_time", columns, settings.weather_tolerance_minutes
    )
    return joined.withColumn("weather_matched", F.col("matched_slot_time").isNotNull()).drop("matched_slot_time")


def feature_windows(
    frame: DataFrame, features: Sequence[str], size: int = 24, interval_minutes: int = 5
) -> DataFrame:
    """Sequences of ``size`` contiguous candidate points, one per end point."""
    line = runs.Timeline(DEVICE_KEYS, "event_time", interval_minutes)
    marked = runs.with_streak(frame, line, F.col("candidate_normal"), "_length")
    recent = line.local_window().rowsBetween(-(size - 1), 0)
    return (
        marked.withColumn("sequence", F.collect_list(F.struct(*features)).over(recent))
        .where(F.col("_length") >= size)
        .drop("_length")
    )


def baseline_predictions(frame: DataFrame) -> DataFrame:
    """Persistence and peer-ramp forecasts with their residuals (actual - forecast)."""
    actual = F.col("target_active_power")
    result = frame.withColumn("baseline_prediction", F.col("active_power"))
    if "peer_median_ramp_ratio" in frame.columns:
        result = result.withColumn(
            "peer_physical_prediction",
            F.col("active_power")
            + F.coalesce(F.col("peer_median_ramp_ratio"), F.lit(0.0)) * F.col("rated_power"),
        ).withColumn("peer_physical_residual", actual - F.col("peer_physical_prediction"))
    return result.withColumn("baseline_residual", actual - F.col("baseline_prediction"))


def regression_metrics(
    frame: DataFrame, actual: str, predicted: str, groups: Sequence[Sequence[str]] = ((),)
) -> DataFrame:
    """MAE, RMSE, bias and R2 for several groupings in one aggregation."""
    keys = list(dict.fromkeys(k for g in groups for k in g))
    rows = frame.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    error = F.col(predicted) - F.col(actual)
    sums = [
        F.count(F.lit(1)).alias("samples"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("_mse"),
        F.avg(error).alias("bias"),
        F.var_pop(actual).alias("_var"),
    ]
    grouped = rows.groupingSets([list(g) for g in groups], *keys).agg(*sums) if keys else rows.agg(*sums)
    return (
        grouped.withColumn("rmse", F.sqrt("_mse"))
        .withColumn("r2", F.when(F.col("_var") > 0, 1 - F.col("_mse") / F.col("_var")))
        .drop("_mse", "_var")
    )


# fixed values: lower edges of the power bins in percent, left-closed
POWER_BINS = (0, 10, 20, 40, 60, 80, 100)


def power_bin(ratio: Column) -> Column:
    # rounding keeps an edge like 0.1 in the bin it opens
    value = F.round(ratio * 100, 9)
    result = F.when(value >= POWER_BINS[-1], f">{POWER_BINS[-1]}%")
    for low, high in zip(POWER_BINS[-2::-1], POWER_BINS[:0:-1]):
        result = result.when(value >= low, f"{low}-{high}%")
    return result


def residual_audit(frame: DataFrame, groups: Sequence[Sequence[str]] = ((),)) -> DataFrame:
    """Model against baseline: MAE, its difference, and share of wins."""
    keys = list(dict.fromkeys(k for g in groups for k in g))
    values = [
        F.count(F.lit(1)).alias("samples"),
        F.avg("absolute_error").alias("model_mae"),
        F.avg("baseline_absolute_error").alias("baseline_mae"),
        F.avg(F.col("absolute_error") - F.col("baseline_absolute_error")).alias("mae_delta"),
        F.avg((F.col("absolute_error") < F.col("baseline_absolute_error")).cast("double")).alias("win_rate"),
    ]
    return frame.groupingSets([list(g) for g in groups], *keys).agg(*values) if keys else frame.agg(*values)


def training_audit(frame: DataFrame, interval_minutes: int = 5) -> DataFrame:
    """Per split: rows, wrong horizons, non-running rows, null shares, matches."""
    total = F.count(F.lit(1))

    def share(test: Column) -> Column:
        return F.bround(F.count_if(test) / total * 100, 4)

    horizon = F.unix_micros("target_time") - F.unix_micros("event_time")
    audited = frame.groupBy("split").agg(
        total.alias("rows"),
        F.min("event_time").alias("minimum_event_time"),
        F.max("target_time").alias("maximum_target_time"),
        F.countDistinct(*DEVICE_KEYS).alias("devices"),
        F.count_if(~F.col("candidate_normal")).alias("candidate_false_rows"),
        F.count_if(horizon != interval_minutes * MICROS_PER_MINUTE).alias("wrong_horizon_targets"),
        F.count_if(F.coalesce(F.col("status_code") != 1, F.lit(True))).alias("non_running_rows"),
        F.count_if(F.col("active_power") <= 0).alias("non_positive_power_rows"),
        *(
            [share(F.col("weather_matched")).alias("weather_matched_percent")]
            if "weather_matched" in frame.columns
            else []
        ),
        *[
            share(F.col(c).isNull()).alias(f"{c}_null_percent")
            for c in ("sensor_ghi", "forecast_ghi")
            if c in frame.columns
        ],
    )
    repeated = (
        frame.groupBy("split", "event_time", *DEVICE_KEYS)
        .agg((F.count(F.lit(1)) - 1).alias("_extra"))
        .groupBy("split")
        .agg(F.sum("_extra").alias("duplicate_input_keys"))
    )
    return audited.join(repeated, "split", "left")


def fit_scaler(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and population deviation per feature, from training rows only."""
    moments = train.agg(
        *[F.avg(f).alias(f"mean_{f}") for f in features], *[F.stddev_pop(f).alias(f"std_{f}") for f in features]
    )
    return moments.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("feature"),
                        F.col(f"mean_{f}").alias("mean"),
                        F.when(F.col(f"std_{f}") > 0, F.col(f"std_{f}")).otherwise(1.0).alias("scale"),
                    )
                    for f in features
                ]
            )
        )
    )


def apply_scaler(frame: DataFrame, scaler: DataFrame) -> DataFrame:
    """Standardise features; the scaler has one row per feature."""
    values = {r["feature"]: (r["mean"], r["scale"]) for r in scaler.collect()}
    return frame.withColumns({f: (F.col(f) - F.lit(m)) / F.lit(s) for f, (m, s) in values.items()})


def device_vocabulary(train: DataFrame, key: str = "device_key") -> DataFrame:
    """Consecutive index per device in key order."""
    from stringwatch.operators.numbering import with_row_numbers

    return with_row_numbers(train.select(key).distinct(), [key], "device_index").withColumn(
        "device_index", F.col("device_index") - 1
    )


def fit_power_model(train: DataFrame, features: Sequence[str], label: str = "target_active_power"):
    """Linear one-step forecast as a Spark ML pipeline.

    Fitted on rows that have the label and all features. Applied to a row
    without some feature it keeps the row and predicts NaN.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True),
        LinearRegression(featuresCol="features", labelCol=label, predictionCol="predicted_power", regParam=1e-6),
    ]
    return Pipeline(stages=stages).fit(train.na.drop(subset=[*features, label]))
