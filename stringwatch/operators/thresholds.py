"""Context thresholds: device, plant and string count, string count, global."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stringwatch.config import HierarchySettings, ResidualSettings
from stringwatch.functions.timegrid import local_date
from stringwatch.operators import runs
from stringwatch.operators.ewma import MAD_FACTOR
from stringwatch.operators.quantiles import quantiles, scalar_quantiles
from stringwatch.operators.residuals import with_drops
from stringwatch.schema import STRING_KEYS
from stringwatch.storage import stage

LEVEL_KEYS = ["level", "k1", "k2"]


@dataclass(frozen=True)
class ContextThresholds:
    """Threshold tables per level and the global fallback."""

    devices: DataFrame
    plant_counts: DataFrame
    counts: DataFrame
    global_threshold: float


def _levels(samples: DataFrame) -> DataFrame:
    """Every sample once per level below the global one."""
    count = F.col("string_count").cast("string")
    none = F.lit("")
    return samples.select(
        "value",
        "day",
        "plant_id",
        "string_count",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(level).alias("level"), k1.alias("k1"), k2.alias("k2"))
                    for level, k1, k2 in (
                        ("device", F.col("plant_id"), F.col("device_no")),
                        ("plant_count", F.col("plant_id"), count),
                        ("count", count, none),
                    )
                ]
            )
        ),
    )


def fit_context_thresholds(
    samples: DataFrame,
    settings: HierarchySettings,
    mad_multiplier: float | None = None,
    floor: float | None = None,
) -> ContextThresholds:
    """Shrunken quantiles per context.

    ``samples`` has plant_id, device_no, string_count, value and day. A level
    counts only above its minima of samples and days; its quantile is pulled
    towards the nearest passing parent by N / (N + K). A device's parent is the
    string count it shows most often (the smallest on a tie). With
    ``mad_multiplier`` a quantile is capped at median + m * 1.4826 * MAD, with
    ``floor`` no threshold lies below it.
    """
    samples = stage(samples.select("plant_id", "device_no", "string_count", "value", "day"), "threshold-samples")
    probabilities = [settings.quantile, 0.5]
    overall = scalar_quantiles(samples, "value", probabilities)
    if overall is None:
        raise ValueError("No eligible samples remain for threshold calibration")
    global_threshold, center = overall
    if mad_multiplier is not None:
        spread = samples.select(F.abs(F.col("value") - F.lit(center)).alias("value"))
        cap = center + mad_multiplier * MAD_FACTOR * scalar_quantiles(spread, "value", [0.5])[0]
        global_threshold = min(global_threshold, cap)
    if floor is not None:
        global_threshold = max(global_threshold, floor)
    levels = _levels(samples)
    table = quantiles(levels, LEVEL_KEYS, "value", probabilities)
    # samples per day first, so that counting days needs no distinct values
    days = (
        levels.where(F.col("value").isNotNull())
        .groupBy(*LEVEL_KEYS, "day")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy(*LEVEL_KEYS)
        .agg(F.count(F.lit(1)).alias("days"))
    )
    table = stage(
        table.select(*LEVEL_KEYS, "n", F.get("q", 0).alias("q"), F.get("q", 1).alias("median")).join(days, LEVEL_KEYS),
        "threshold-levels",
    )
    if mad_multiplier is not None:
        deviations = stage(
            levels.join(table.select(*LEVEL_KEYS, "median"), LEVEL_KEYS).select(
                *LEVEL_KEYS, F.abs(F.col("value") - F.col("median")).alias("value")
            ),
            "threshold-deviations",
        )
        mad = quantiles(deviations, LEVEL_KEYS, "value", [0.5]).select(*LEVEL_KEYS, F.get("q", 0).alias("mad"))
        cap = F.col("median") + mad_multiplier * MAD_FACTOR * F.col("mad")
        table = stage(table.join(mad, LEVEL_KEYS).withColumn("q", F.least("q", cap)).drop("mad"), "threshold-capped")

    def floored(value: Column) -> Column:
        return value if floor is None else F.greatest(value, F.lit(floor))

    def shrunk(parent: Column) -> Column:
        weight = F.col("n") / (F.col("n") + F.lit(settings.shrinkage_k))
        # written so that equal quantile and parent give exactly that value
        return floored(parent + weight * (F.col("q") - parent))

    def passing(level: str, minimum_samples: int, minimum_days: int) -> DataFrame:
        return table.where(
            (F.col("level") == level) & (F.col("n") >= minimum_samples) & (F.col("days") >= minimum_days)
        )

    counts = passing("count", settings.minimum_count_samples, settings.minimum_count_days).select(
        F.col("k1").cast("int").alias("string_count"),
        shrunk(F.lit(global_threshold)).alias("threshold"),
        "n",
        "days",
    )
    plant_counts = passing(
        "plant_count", settings.minimum_plant_count_samples, settings.minimum_plant_count_days
    ).withColumn("string_count", F.col("k2").cast("int"))
    parent = F.coalesce(F.col("_parent"), F.lit(global_threshold))
    plant_counts = plant_counts.join(
        counts.select("string_count", F.col("threshold").alias("_parent")), "string_count", "left"
    ).select(F.col("k1").alias("plant_id"), "string_count", shrunk(parent).alias("threshold"), "n", "days")
    usual = (
        samples.groupBy("plant_id", "device_no", "string_count")
        .agg(F.count("value").alias("_n"))
        .groupBy("plant_id", "device_no")
        .agg(F.max_by("string_count", F.struct("_n", -F.col("string_count"))).alias("string_count"))
    )
    devices = (
        passing("device", settings.minimum_device_samples, settings.minimum_device_days)
        .select(F.col("k1").alias("plant_id"), F.col("k2").alias("device_no"), "n", "days", "q")
        .join(usual, ["plant_id", "device_no"])
        .join(
            plant_counts.select("plant_id", "string_count", F.col("threshold").alias("_plant_parent")),
            ["plant_id", "string_count"],
            "left",
        )
        .join(counts.select("string_count", F.col("threshold").alias("_count_parent")), "string_count", "left")
        .withColumn("_parent", F.coalesce("_plant_parent", "_count_parent"))
        .select("plant_id", "device_no", shrunk(parent).alias("threshold"), "n", "days")
    )
    return ContextThresholds(stage(devices, "threshold-devices"), plant_counts, counts, global_threshold)


def with_context_threshold(
    frame: DataFrame, thresholds: ContextThresholds, threshold: str, level: str, count: str = "available_strings"
) -> DataFrame:
    """Look up the threshold of a row: the most specific level that has one.

    A device has at most 99 strings, so the thresholds by string count are one
    short map for all plants and one for each plant; only devices and plants are
    joined. Whether those are small enough to broadcast is left to their size.
    """
    devices = thresholds.devices.select("plant_id", "device_no", F.col("threshold").alias("_device"))
    plants = thresholds.plant_counts.groupBy("plant_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("string_count").cast("int"), "threshold"))).alias("_ladder")
    )
    counts = F.lit(None).cast("map<int, double>")
    if known := [(int(r["string_count"]), r["threshold"]) for r in thresholds.counts.collect()]:  # at most 99 rows
        counts = F.create_map(*[F.lit(x) for pair in known for x in pair])
    number = F.col(count).cast("int")
    joined = frame.join(devices, ["plant_id", "device_no"], "left").join(plants, ["plant_id"], "left")
    joined = joined.withColumns({"_plant_count": F.try_element_at("_ladder", number), "_count": F.try_element_at(counts, number)})
    return joined.withColumns(
        {
            threshold: F.coalesce("_device", "_plant_count", "_count", F.lit(thresholds.global_threshold)),
            level: F.when(F.col("_device").isNotNull(), "device")
            .when(F.col("_plant_count").isNotNull(), "plant_count")
            .when(F.col("_count").isNotNull(), "count")
            .otherwise("global"),
        }
    ).drop("_device", "_plant_count", "_count", "_ladder")


def hierarchy_samples(scored: DataFrame, settings: ResidualSettings, timezone: str) -> DataFrame:
    """LOF scores of low, gated, positive strings: the calibration sample."""
    low = with_drops(scored, settings).where(
        F.col("lof_eligible")
        & F.col("response_known")
        & (F.col("string_current") > float(settings.zero_current_threshold))
        & (F.col("residual_ratio") < F.col("residual_median"))
        & (F.col("isolated_effect_eligible") == 1)
    )
    return low.select(
        "plant_id",
        "device_no",
        F.col("available_strings").alias("string_count"),
        F.col("lof_score").alias("value"),
        local_date("event_time", timezone).alias("day"),
    )


def fit_hierarchy(
    scored: DataFrame, base: ResidualSettings, settings: HierarchySettings = HierarchySettings()
) -> ContextThresholds:
    return fit_context_thresholds(hierarchy_samples(scored, base, settings.timezone), settings)


def add_strict_alerts(
    points: DataFrame,
    base: ResidualSettings,
    thresholds: ContextThresholds,
    settings: HierarchySettings = HierarchySettings(),
    chunk_minutes: int | None = None,
) -> DataFrame:
    """Every point of a streak must pass the threshold of its own context."""
    result = with_context_threshold(
        points, thresholds, "isolated_hier_lof_threshold", "isolated_hier_threshold_level"
    )
    if "isolated_effect_eligible" not in result.columns:
        result = with_drops(result, base)
    raw = (
        F.col("lof_eligible")
        & F.col("response_known")
        & (F.col("string_current") > float(base.zero_current_threshold))
        & (F.col("lof_score") >= F.col("isolated_hier_lof_threshold"))
        & (F.col("residual_ratio") < F.col("residual_median"))
        & (F.col("isolated_effect_eligible") == 1)
    )
    result = result.withColumn("hier_raw_alert", F.coalesce(raw, F.lit(False)).cast("int"))
    line = runs.Timeline(STRING_KEYS, "event_time", settings.interval_minutes, chunk_minutes)
    result = runs.with_streak(result, line, F.col("hier_raw_alert") == 1, "hier_consecutive")
    single = F.col("hier_consecutive") >= settings.minimum_consecutive
    if "collective_member_alert" in result.columns:
        single = single | (F.col("collective_member_alert") == 1)
    return result.withColumn("hier_strict_alert", single.cast("int"))


def add_continuation_alerts(
    points: DataFrame, raw: Column, keeps: Column, minimum_consecutive: int, interval_minutes: int, name: str
) -> DataFrame:
    """Streaks that start on a raw candidate and go on while only ``keeps`` holds.

    The looser variant of an isolated streak: a point whose score fell back
    still continues a streak if its direction is low.
    """
    line = runs.Timeline(STRING_KEYS, "event_time", interval_minutes)
    alive = F.coalesce(raw | keeps, F.lit(False))
    result = runs.with_previous(
        points.withColumn("_alive", alive), line, {"_previous_time": F.col(line.time), "_was_alive": F.col("_alive")}
    )
    connected = runs.follows(line) & F.coalesce(F.col("_was_alive"), F.lit(False))
    result = runs.with_latest_time(result, line, {"_segment": F.col("_alive") & ~connected})
    # the first raw candidate of the alive segment opens the streak
    segment = (
        Window.partitionBy(*line.keys, "_segment")
        .orderBy(line.time)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    opened = F.min(F.when(F.coalesce(raw, F.lit(False)), F.col(line.time))).over(segment)
    result = result.withColumn("_opened", F.when(F.col("_alive"), opened))
    return result.withColumn(
        name, F.coalesce(runs.run_length(line, "_opened") >= minimum_consecutive, F.lit(False)).cast("int")
    ).drop("_alive", "_previous_time", "_was_alive", "_segment", "_opened")

