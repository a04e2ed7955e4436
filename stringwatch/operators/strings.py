"""String detector on raw currents: peer ratio, LOF score, streaks and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringwatch.config import LofSettings
from stringwatch.functions.arrays import let, median
from stringwatch.functions.lof import lof_scores
from stringwatch.operators import runs
from stringwatch.operators.channels import configured, readings
from stringwatch.operators.quantiles import quantiles
from stringwatch.schema import POINT_KEYS, SOURCE_PLANT, STRING_KEYS, number, require_columns
from stringwatch.storage import stage


def row_eligible(frame: DataFrame, settings: LofSettings) -> Column:
    """Daylight-like, running rows; optional columns count where present."""
    ratio = F.col("active_power_ratio")
    tests = [ratio.between(settings.minimum_power_ratio, settings.maximum_power_ratio)]
    if "status_code" in frame.columns:
        tests.append(number("status_code").isin(*[float(s) for s in settings.eligible_status_codes]))
    for name in ("main_string_count", "valid_current_string_count"):
        if name in frame.columns:
            tests.append(number(name) > 0)
    return reduce(lambda a, b: a & b, tests)


def score_strings(frame: DataFrame, settings: LofSettings = LofSettings(minimum_strings=4)) -> DataFrame:
    """Long, scored strings of eligible wide rows.

    A wide row already holds its whole peer group, so there is no shuffle:
    ratios and scores are array expressions, and the row is exploded last.
    """
    require_columns(frame, ("event_time", "device_no", "active_power", "rated_power"), "device table")
    source = frame if "plant_id" in frame.columns else frame.withColumn("plant_id", F.lit(None).cast("string"))
    strings = F.filter(readings(source), configured)
    zero = F.lit(float(settings.zero_current_threshold))
    needed = max(settings.minimum_strings, settings.n_neighbors + 1)

    source = source.select(
        "event_time",
        "plant_id",
        F.col("device_no").cast("string").alias("device_no"),
        number("active_power").alias("active_power"),
        number("rated_power").alias("rated_power"),
        *[
            c
            for c in ("status_code", "main_string_count", "valid_current_string_count", SOURCE_PLANT)
            if c in frame.columns
        ],
        strings.alias("_strings"),
    ).withColumn(
        "active_power_ratio", F.when(F.col("rated_power") > 0, F.col("active_power") / F.col("rated_power"))
    )
    source = source.where(row_eligible(source, settings))

    def scored(strings: Column) -> Column:
        peers = F.filter(strings, lambda s: s["current"] > zero)

        def from_peers(p: Column) -> Column:
            level = F.when(F.size(p) >= needed, median(F.transform(p, lambda s: s["current"])))
            return let(level, lambda m: F.when(m > zero, from_ratios(p, F.transform(p, lambda s: s["current"] / m))))

        def from_ratios(p: Column, ratios: Column) -> Column:
            return let(
                ratios,
                lambda r: F.arrays_zip(
                    F.transform(p, lambda s: s["string_no"]).alias("n"),
                    r.alias("r"),
                    lof_scores(r, settings.n_neighbors, settings.distance_floor).alias("s"),
                ),
            )

        return let(peers, from_peers)

    source = source.withColumn("_scored", scored(F.col("_strings")))

    def output(string: Column) -> Column:
        peer = F.get(F.filter(F.col("_scored"), lambda p: p["n"] == string["string_no"]), 0)
        return let(
            peer,
            lambda p: F.struct(
                string["string_no"].alias("string_no"),
                string["current"].alias("string_current"),
                string["status"].cast("int").alias("string_status"),
                p["r"].alias("string_current_ratio"),
                p["s"].alias("lof_score"),
                p.isNotNull().alias("lof_eligible"),
                (string["current"] <= zero).cast("int").alias("zero_current_alert"),
                F.coalesce(string["status"] == 2, F.lit(False)).alias("weak_low_current_label"),
                F.coalesce(string["status"] == 4, F.lit(False)).alias("weak_zero_current_label"),
            ),
        )

    return source.select(
        "event_time",
        "plant_id",
        "device_no",
        "active_power",
        "rated_power",
        "active_power_ratio",
        *([SOURCE_PLANT] if SOURCE_PLANT in frame.columns else []),
        F.inline(F.transform("_strings", output)),
    )


def fit_string_threshold(
    frame: DataFrame, settings: LofSettings = LofSettings()
) -> tuple[LofSettings, dict[str, float]]:
    """Quantile of normal scores as alert threshold, and a report.

    Normal means scored and, where any status is known, status 1.
    """
    scored = stage(
        score_strings(frame, settings).select(*POINT_KEYS, "lof_eligible", "string_status", "lof_score", "zero_current_alert"),
        "string-scores",
    )
    counts = scored.agg(
        F.count(F.lit(1)).alias("string_samples"),
        F.count_if("lof_eligible").alias("eligible_nonzero_samples"),
        F.sum("zero_current_alert").alias("zero_current_samples"),
        F.count("string_status").alias("known_status"),
        F.max(F.when(F.col("lof_eligible") & (F.col("string_status") == 1), F.col("lof_score"))).alias("top_normal"),
        F.max("lof_score").alias("top"),
    ).first()
    normal = scored.where("lof_eligible")
    if counts["known_status"]:
        normal = normal.where("string_status = 1")
    wide = scored.select(*POINT_KEYS).distinct().count()
    row = quantiles(normal, [], "lof_score", [settings.quantile, 0.5]).first()
    if row is None:
        raise ValueError("the history has no normal string with a score, so no threshold can be fitted")
    fitted = settings.derive(threshold=row["q"][0])
    report = {
        "wide_samples": wide,
        "string_samples": counts["string_samples"],
        "eligible_nonzero_samples": counts["eligible_nonzero_samples"],
        "normal_calibration_samples": row["n"],
        "zero_current_samples": counts["zero_current_samples"] or 0,
        "score_quantile": settings.quantile,
        "threshold": row["q"][0],
        "score_median": row["q"][1],
        "score_maximum": counts["top_normal"] if counts["known_status"] else counts["top"],
    }
    return fitted, report


def string_timeline(frame: DataFrame, interval_minutes: int, chunk_minutes: int | None = None) -> runs.Timeline:
    """Rows of one string; of mapped plants, of one string of one source plant."""
    source = (SOURCE_PLANT,) if SOURCE_PLANT in frame.columns else ()
    return runs.Timeline((*STRING_KEYS, *source), "event_time", interval_minutes, chunk_minutes)


def add_string_alerts(scored: DataFrame, settings: LofSettings, chunk_minutes: int | None = None) -> DataFrame:
    """Raw, persistent and combined alerts of scored strings.

    Zero current alerts at once; low current needs consecutive raw alerts.
    """
    if settings.threshold is None:
        raise ValueError("settings have no fitted threshold")
    raw = (
        F.col("lof_eligible")
        & (F.col("lof_score") >= settings.threshold)
        & (F.col("string_current_ratio") <= 1.0 - settings.minimum_relative_drop)
    )
    result = scored.withColumn("lof_raw_alert", F.coalesce(raw, F.lit(False)).cast("int"))
    line = string_timeline(scored, settings.interval_minutes, chunk_minutes)
    result = runs.with_streak(result, line, F.col("lof_raw_alert") == 1, "lof_consecutive")
    return result.withColumn(
        "lof_alert", (F.col("lof_consecutive") >= settings.minimum_consecutive).cast("int")
    ).withColumn("combined_alert", F.greatest("zero_current_alert", "lof_alert"))


def apply_string_detector(frame: DataFrame, settings: LofSettings, chunk_minutes: int | None = None) -> DataFrame:
    """Score wide rows and raise alerts with fitted settings."""
    return add_string_alerts(score_strings(frame, settings), settings, chunk_minutes)


def string_events(
    points: DataFrame,
    alert_column: str = "combined_alert",
    interval_minutes: int = 5,
    chunk_minutes: int | None = None,
) -> DataFrame:
    """Contiguous alerts of a string as events, named by string and start."""
    require_columns(points, (*STRING_KEYS, "event_time", alert_column), "string points")
    extra = {
        "zero_current_points": F.sum("zero_current_alert"),
        "lof_points": F.sum("lof_alert"),
        "minimum_current": F.min("string_current"),
        "minimum_current_ratio": F.min("string_current_ratio"),
        "maximum_lof_score": F.max("lof_score"),
    }
    source = {
        "zero_current_points": "zero_current_alert",
        "lof_points": "lof_alert",
        "minimum_current": "string_current",
        "minimum_current_ratio": "string_current_ratio",
        "maximum_lof_score": "lof_score",
    }
    aggregates = [value.alias(name) for name, value in extra.items() if source[name] in points.columns]
    return runs.collapse(
        points, string_timeline(points, interval_minutes, chunk_minutes), F.col(alert_column).cast("boolean"), aggregates
    )
