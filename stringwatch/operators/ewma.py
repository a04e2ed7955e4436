"""Control chart on forecast residuals of devices."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stringwatch.config import EwmaSettings
from stringwatch.operators import runs
from stringwatch.operators.quantiles import quantile, scalar_quantiles
from stringwatch.schema import number, require_columns
from stringwatch.storage import stage

RESIDUAL_COLUMNS = (
    "target_time",
    "device_no",
    "rated_power",
    "actual_power",
    "predicted_power",
    "actual_power_ratio",
)
# fixed values: consistency factor of the median absolute deviation, smallest usable scale
MAD_FACTOR = 1.4826
SMALLEST_SCALE = 1e-6


def prepare_residuals(frame: DataFrame, settings: EwmaSettings = EwmaSettings()) -> DataFrame:
    """Underproduction (predicted - actual) / rated and row eligibility."""
    require_columns(frame, RESIDUAL_COLUMNS, "residual table")
    if "plant_id" not in frame.columns:
        frame = frame.withColumn("plant_id", F.lit("").cast("string"))
    residual = F.try_divide(number("predicted_power") - number("actual_power"), number("rated_power"))
    eligible = (
        (number("rated_power") > 0)
        & number(F.col("underproduction_residual")).isNotNull()
        & number("actual_power_ratio").between(settings.minimum_power_ratio, settings.maximum_power_ratio)
    )
    return frame.withColumn("underproduction_residual", residual).withColumn(
        "ewma_eligible", F.coalesce(eligible, F.lit(False))
    )


def device_timeline(interval_minutes: int, chunk_minutes: int | None = None) -> runs.Timeline:
    return runs.Timeline(("plant_id", "device_no"), "target_time", interval_minutes, chunk_minutes)


def ewma_scores(prepared: DataFrame, settings: EwmaSettings) -> DataFrame:
    """Add the smoothed standardised residual, restarting after any gap.

    Inside a run of eligible points at index i the recursion has the closed form
    ``w k^i sum(z_j k^-j)`` with k = 1 - w, one running sum. ``k^-j`` would
    overflow in long runs, so the sum restarts in blocks and the state at the
    end of the previous block is added; earlier blocks weigh below 1e-150.
    """
    line = device_timeline(settings.interval_minutes)
    value = (F.col("underproduction_residual") - F.lit(settings.center)) / F.lit(settings.scale)
    if settings.weight == 1:
        return prepared.withColumn("ewma_score", F.when(F.col("ewma_eligible"), value))
    result = runs.with_previous(
        prepared, line, {"_previous_time": F.col(line.time), "_previous_ok": F.col("ewma_eligible")}
    )
    starts = F.col("ewma_eligible") & ~(
        runs.follows(line) & F.coalesce(F.col("_previous_ok"), F.lit(False))
    )
    result = runs.with_latest_time(result, line, {"_start": starts})
    keep = 1.0 - settings.weight
    block = math.ceil(345.0 / -math.log(keep))
    index = F.when(F.col("ewma_eligible"), runs.run_length(line, "_start") - 1)
    result = result.withColumns(
        {
            "_z": F.when(F.col("ewma_eligible"), value),
            "_run": F.when(F.col("ewma_eligible"), F.col("_start")),
            "_block": F.floor(index / block),
            "_index": F.pmod(index, F.lit(block)),
        }
    )
    run = Window.partitionBy(*line.keys, "_run").orderBy(line.time)
    in_block = (
        Window.partitionBy(*line.keys, "_run", "_block")
        .orderBy(line.time)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    growth = F.pow(F.lit(keep), -F.col("_index"))
    result = result.withColumn(
        "_local", F.lit(settings.weight) * F.sum(F.col("_z") * growth).over(in_block) / growth
    )
    block_end = F.when(F.col("_index") == block - 1, F.col("_local"))
    carried = F.last(block_end, ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1))
    score = F.col("_local") + F.coalesce(carried * F.pow(F.lit(keep), F.col("_index") + 1), F.lit(0.0))
    return result.withColumn("ewma_score", F.when(F.col("ewma_eligible"), score)).drop(
        "_previous_time", "_previous_ok", "_start", "_z", "_run", "_block", "_index", "_local"
    )


def robust_center_scale(frame: DataFrame, value: str) -> tuple[float, float] | None:
    """Median and scaled median absolute deviation, with two fallbacks."""
    found = scalar_quantiles(frame, value, [0.5])
    if found is None:
        return None
    center = found[0]
    deviation = frame.select(F.abs(F.col(value) - F.lit(center)).alias("_d"))
    scale = MAD_FACTOR * scalar_quantiles(deviation, "_d", [0.5])[0]
    if not scale >= SMALLEST_SCALE:
        scale = frame.agg(F.stddev_pop(value)).first()[0] or 0.0
    if not scale >= SMALLEST_SCALE:
        scale = 1.0
    return center, scale


def fit_ewma(frame: DataFrame, settings: EwmaSettings = EwmaSettings()) -> tuple[EwmaSettings, dict[str, float]]:
    """Robust centre and scale, then the control limit as a score quantile."""
    prepared = stage(
        prepare_residuals(frame, settings).select(
            "plant_id", "device_no", "target_time", "underproduction_residual", "ewma_eligible"
        ),
        "residuals",
    )
    robust = robust_center_scale(prepared.where("ewma_eligible"), "underproduction_residual")
    if robust is None:
        raise ValueError("the history has no residual of plausible output, so the chart cannot be fitted")
    fitted = settings.derive(center=robust[0], scale=robust[1])
    scores = stage(ewma_scores(prepared, fitted).where("ewma_eligible").select("ewma_score"), "ewma-scores")
    fitted = fitted.derive(threshold=scalar_quantiles(scores, "ewma_score", [settings.quantile])[0])
    counts = prepared.agg(F.count(F.lit(1)).alias("samples"), F.count_if("ewma_eligible").alias("eligible")).first()
    report = {
        "samples": counts["samples"],
        "eligible_samples": counts["eligible"],
        "eligible_percent": 100.0 * counts["eligible"] / counts["samples"],
        "underproduction_center": fitted.center,
        "underproduction_scale": fitted.scale,
        "ewma_score_quantile": settings.quantile,
        "threshold": fitted.threshold,
    }
    return fitted, report


def apply_ewma(frame: DataFrame, settings: EwmaSettings) -> DataFrame:
    """Scores, raw exceedances, streaks and alerts with fitted settings."""
    if settings.threshold is None:
        raise ValueError("settings have no fitted threshold")
    scored = ewma_scores(prepare_residuals(frame, settings), settings)
    raw = F.coalesce(F.col("ewma_eligible") & (F.col("ewma_score") > settings.threshold), F.lit(False))
    result = scored.withColumn("ewma_raw_alert", raw.cast("int"))
    line = device_timeline(settings.interval_minutes)
    result = runs.with_streak(result, line, F.col("ewma_raw_alert") == 1, "ewma_consecutive")
    return result.withColumn(
        "ewma_alert", (F.col("ewma_consecutive") >= settings.minimum_consecutive).cast("int")
    )


def residual_baseline_scale(frame: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """Robust centre and scale per group, all fallbacks included."""
    center = quantile(frame, keys, value, 0.5, "center").drop("n")
    spread = frame.groupBy(*keys).agg(F.stddev_pop(value).alias("_std"))
    deviation = frame.join(center, list(keys)).withColumn("_d", F.abs(F.col(value) - F.col("center")))
    mad = quantile(deviation, keys, "_d", 0.5, "_mad")
    scaled = F.col("_mad") * MAD_FACTOR
    scale = (
        F.when(scaled >= SMALLEST_SCALE, scaled)
        .when(F.col("_std") >= SMALLEST_SCALE, F.col("_std"))
        .otherwise(1.0)
    )
    return center.join(mad, list(keys)).join(spread, list(keys)).select(*keys, "n", "center", scale.alias("scale"))
