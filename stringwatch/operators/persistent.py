"""Persistent mild deficit of a stable group of strings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stringwatch.config import PersistentSettings
from stringwatch.functions.arrays import median
from stringwatch.functions.timegrid import local_date
from stringwatch.operators import runs
from stringwatch.operators.residuals import continuity_of_sets, string_bit
from stringwatch.operators.thresholds import ContextThresholds, fit_context_thresholds, with_context_threshold
from stringwatch.schema import DEVICE_KEYS, POINT_KEYS, STRING_KEYS, require_columns
from stringwatch.storage import stage

NEEDED = (*STRING_KEYS, "event_time", "residual_ratio", "string_current", "response_known", "collective_group_member")


@dataclass(frozen=True)
class PersistentModel:
    settings: PersistentSettings
    thresholds: ContextThresholds

    @property
    def global_threshold(self) -> float:
        return self.thresholds.global_threshold


def group_deficits(points: DataFrame, settings: PersistentSettings) -> DataFrame:
    """Per device-time: structural group, its deficit, continuity and window median.

    The deficit is 1 - median(lower residuals) / median(upper residuals). The
    window median exists only where the last ``minimum_consecutive`` points all
    belong to one stable group.
    """
    require_columns(points, NEEDED, "scored points")
    valid = F.col("response_known") & F.col("residual_ratio").isNotNull() & (F.col("string_current") > 0)
    member = valid & F.col("collective_group_member")
    lower = F.collect_list(F.when(member, F.col("residual_ratio")))
    upper = F.collect_list(F.when(valid & ~F.col("collective_group_member"), F.col("residual_ratio")))
    # one device-time holds at most the channels of a device; dealt out by device once, it is not moved again
    groups = (
        points.repartition(*DEVICE_KEYS)
        .groupBy(*POINT_KEYS)
        .agg(
            F.count_if(valid).cast("int").alias("string_count"),
            F.count_if(member).cast("int").alias("group_size"),
            lower.alias("_lower"),
            upper.alias("_upper"),
            *[F.bit_or(string_bit(F.col("string_no"), F.coalesce(member, F.lit(False)), i)).alias(f"_w{i}") for i in (0, 1)],
        )
        .withColumn("_group", (F.col("group_size") >= settings.minimum_group_strings)
            & (F.col("group_size") <= F.col("string_count") * F.lit(settings.maximum_group_fraction))
            & (F.size("_upper") >= settings.minimum_upper_strings))
        .withColumn("persistent_deficit", F.when(F.col("_group"), 1 - median(F.col("_lower")) / median(F.col("_upper"))))
        .withColumn("_group", F.col("persistent_deficit").isNotNull())
        .drop("_lower", "_upper")
    )
    line = runs.Timeline(DEVICE_KEYS, "event_time", settings.interval_minutes)
    joined = continuity_of_sets(groups, settings.membership_overlap_threshold, line, "persistent").withColumnRenamed(
        "persistent_overlap", "persistent_membership_overlap"
    )
    recent = (
        Window.partitionBy(*DEVICE_KEYS).orderBy("event_time").rowsBetween(-(settings.minimum_consecutive - 1), 0)
    )
    complete = F.col("persistent_consecutive") >= settings.minimum_consecutive
    return joined.withColumn(
        "persistent_window_median_deficit",
        F.when(complete, F.percentile("persistent_deficit", F.lit(0.5)).over(recent)),
    )


def fit_persistent(
    points: DataFrame, settings: PersistentSettings = PersistentSettings(), groups: DataFrame | None = None
) -> tuple[PersistentModel, dict[str, float]]:
    """Deficit thresholds from window-complete groups, robustly capped.

    ``groups`` are the points' :func:`group_deficits`, staged, where they serve
    the application too.
    """
    if groups is None:
        groups = stage(group_deficits(points, settings), "persistent-groups")
    samples = groups.where(F.col("persistent_window_median_deficit").isNotNull()).select(
        *DEVICE_KEYS,
        "string_count",
        F.col("persistent_window_median_deficit").alias("value"),
        local_date("event_time", settings.timezone).alias("day"),
    )
    counts = groups.agg(
        F.count("persistent_deficit").alias("structural"), F.count("persistent_window_median_deficit").alias("complete")
    ).first()
    report = {"structural_candidate_rows": counts["structural"], "candidate_rows": counts["complete"]}
    if counts["complete"]:
        thresholds = fit_context_thresholds(
            samples, settings.hierarchy(), settings.robust_mad_multiplier, settings.minimum_deficit
        )
    else:
        # nothing to learn from: only the floor is left
        spark = points.sparkSession
        keys = "plant_id string, device_no string, string_count int, threshold double"
        empty = spark.createDataFrame([], keys)
        thresholds = ContextThresholds(
            empty.drop("string_count"),
            empty.drop("device_no"),
            empty.drop("plant_id", "device_no"),
            settings.minimum_deficit,
        )
    report["global_threshold"] = thresholds.global_threshold
    return PersistentModel(settings, thresholds), report


def apply_persistent(
    points: DataFrame, model: PersistentModel, strict_column: str = "hier_strict_alert", groups: DataFrame | None = None
) -> DataFrame:
    """Add the persistent branch beside an existing strict alert.

    The threshold is compared with the median of the window, not with each
    point; alerts go to the members at the current point.
    """
    settings = model.settings
    groups = with_context_threshold(
        group_deficits(points, settings) if groups is None else groups, model.thresholds, "persistent_threshold", "persistent_threshold_level", "string_count"
    )
    raw = F.coalesce(F.col("persistent_deficit") >= F.col("persistent_threshold"), F.lit(False))
    confirmed = F.coalesce(
        F.col("persistent_window_median_deficit") >= F.col("persistent_threshold"), F.lit(False)
    )
    groups = groups.withColumn("persistent_raw_alert", raw.cast("int")).withColumn(
        "persistent_event_alert", confirmed.cast("int")
    )
    result = points.join(groups.drop("string_count", "group_size"), list(POINT_KEYS), "left")
    member = (
        (F.col("persistent_event_alert") == 1)
        & F.col("collective_group_member")
        & F.col("response_known")
        & (F.col("string_current") > 0)
    )
    result = result.withColumn(
        "persistent_collective_member_alert", F.coalesce(member, F.lit(False)).cast("int")
    )
    if strict_column in result.columns:
        result = result.withColumn(
            "combined_alert", F.greatest(F.col(strict_column).cast("int"), "persistent_collective_member_alert")
        )
    return result


def persistent_events(points: DataFrame, interval_minutes: int = 5) -> DataFrame:
    """Member alerts of each string as events."""
    line = runs.Timeline(STRING_KEYS, "event_time", interval_minutes)
    return runs.collapse(
        points,
        line,
        F.col("persistent_collective_member_alert") == 1,
        [
            F.max("persistent_window_median_deficit").alias("maximum_deficit"),
            F.min("string_current").alias("minimum_current"),
            F.min("residual_ratio").alias("minimum_residual_ratio"),
        ],
    )
