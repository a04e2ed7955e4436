"""Predictions against labels, by point and by event."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringwatch.functions.timegrid import minutes_between
from stringwatch.operators import intervals, runs
from stringwatch.operators.quantiles import quantiles
from stringwatch.schema import DEVICE_KEYS, POINT_KEYS


def device_time_alerts(points: DataFrame, alert_column: str, eligible_column: str) -> DataFrame:
    """Strings rolled up to device-times."""
    alert, eligible = F.col(alert_column).cast("int"), F.col(eligible_column).cast("int")
    return points.groupBy(*POINT_KEYS).agg(
        F.max(alert).alias("detected"),
        F.max(eligible).alias("score_eligible"),
        F.sum(alert).alias("alerted_strings"),
        F.count(F.lit(1)).alias("output_strings"),
    )


def align_labels(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions with a label flag."""
    keys = labels.select(*POINT_KEYS).distinct().withColumn("label", F.lit(1))
    return predictions.join(keys, list(POINT_KEYS), "left").withColumn("label", F.coalesce("label", F.lit(0)))


def label_coverage(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """How many label points have a prediction at all."""
    keys = labels.select(*POINT_KEYS).distinct()
    seen = predictions.select(*POINT_KEYS).distinct().withColumn("_seen", F.lit(1))
    return (
        keys.join(seen, list(POINT_KEYS), "left")
        .agg(
            F.count(F.lit(1)).alias("label_points_total"),
            F.count("_seen").alias("label_points_covered"),
        )
        .select(
            "*",
            (F.col("label_points_total") - F.col("label_points_covered")).alias("label_points_uncovered"),
            _ratio("label_points_covered", "label_points_total", 100.0).alias("label_coverage_percent"),
        )
    )


def _ratio(numerator: str, denominator: str, factor: float = 1.0) -> Column:
    n, d = F.col(numerator), F.col(denominator)
    return F.when(d > 0, n / d * F.lit(factor)).otherwise(0.0)


def binary_metrics(frame: DataFrame, label: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, precision, recall and F1."""
    y, p = F.col(label).cast("boolean"), F.col(prediction).cast("boolean")
    counts = frame.groupBy(*keys).agg(
        F.count_if(y & p).alias("true_positive"),
        F.count_if(~y & p).alias("false_positive"),
        F.count_if(~y & ~p).alias("true_negative"),
        F.count_if(y & ~p).alias("false_negative"),
    )
    return with_scores(
        counts.withColumn("_predicted", F.col("true_positive") + F.col("false_positive")).withColumn(
            "_actual", F.col("true_positive") + F.col("false_negative")
        ),
        "true_positive",
        "_predicted",
        "true_positive",
        "_actual",
    ).drop("_predicted", "_actual")


def with_scores(frame: DataFrame, hits: str, predicted: str, found: str, actual: str) -> DataFrame:
    frame = frame.withColumn("precision", _ratio(hits, predicted)).withColumn("recall", _ratio(found, actual))
    total = F.col("precision") + F.col("recall")
    return frame.withColumn(
        "f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0)
    )


def alert_events(points: DataFrame, alert: Column, interval_minutes: int = 5, keys: Sequence[str] = DEVICE_KEYS, time: str = "event_time") -> DataFrame:
    """Contiguous alerts per device."""
    line = runs.Timeline(tuple(keys), time, interval_minutes)
    return runs.collapse(points, line, alert).drop("duration_minutes")


def event_matches(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of overlapping predicted and labelled events of one device."""
    return intervals.overlapping(
        predicted.select(
            *DEVICE_KEYS,
            F.col("start_time").alias("prediction_start_time"),
            F.col("end_time").alias("prediction_end_time"),
        ),
        labels.select(
            *DEVICE_KEYS,
            "alarm_event_id",
            F.col("effective_start_time").alias("alarm_start_time"),
            F.col("effective_end_time").alias("alarm_end_time"),
        ),
        DEVICE_KEYS,
        "prediction_start_time",
        "prediction_end_time",
        "alarm_start_time",
        "alarm_end_time",
    )


def event_metrics(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """Precision over predicted events, recall over labelled ones.

    Only whether an event has a partner matters, so neither side is paired with
    all of its partners.
    """
    p = intervals.overlaps_any(
        predicted, labels, DEVICE_KEYS, "start_time", "end_time", "effective_start_time", "effective_end_time", "_hit"
    ).agg(F.count(F.lit(1)).alias("predicted_events"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("predicted_events_hit"))
    t = intervals.overlaps_any(
        labels, predicted, DEVICE_KEYS, "effective_start_time", "effective_end_time", "start_time", "end_time", "_hit"
    ).agg(F.count(F.lit(1)).alias("label_events"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("label_events_hit"))
    both = p.join(t)  # one row each
    return with_scores(
        both.withColumn("false_positive_events", F.col("predicted_events") - F.col("predicted_events_hit")).withColumn(
            "missed_label_events", F.col("label_events") - F.col("label_events_hit")
        ),
        "predicted_events_hit",
        "predicted_events",
        "label_events_hit",
        "label_events",
    )


# --- recall of alarms ------------------------------------------------------


def first_rows(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by its other columns, which must have an order."""
    rest = [c for c in frame.columns if c not in keys]
    if not rest:
        return frame.distinct()
    return frame.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*").select(*frame.columns)


def alarm_point_recall(alarm_points: DataFrame, predictions: DataFrame) -> DataFrame:
    """Alarm points with what the detector said there."""
    points = first_rows(alarm_points, ("alarm_event_id", *POINT_KEYS))
    joined = points.join(
        predictions.withColumn("output_available", F.lit(1)), list(POINT_KEYS), "left"
    )
    filled = ("output_available", "detected", "score_eligible", "alerted_strings", "output_strings")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in filled})


def alarm_event_recall(events: DataFrame, aligned: DataFrame) -> DataFrame:
    """Per alarm: points, detected points, first detection and its delay.

    The delay counts from the raise time, not from the first grid point.
    """
    per_event = aligned.groupBy("alarm_event_id").agg(
        F.count(F.lit(1)).alias("alarm_points"),
        F.sum("detected").alias("detected_points"),
        F.sum("output_available").alias("output_available_points"),
        F.sum("score_eligible").alias("score_eligible_points"),
        F.min(F.when(F.col("detected") == 1, F.col("event_time"))).alias("first_detection_time"),
    )
    counts = ("alarm_points", "detected_points", "output_available_points", "score_eligible_points")
    return (
        first_rows(events, ("alarm_event_id",))
        .join(per_event, "alarm_event_id", "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})
        .withColumn("event_detected", (F.col("detected_points") > 0).cast("int"))
        .withColumn("event_point_recall", _ratio("detected_points", "alarm_points"))
        .withColumn(
            "detection_delay_minutes", minutes_between(F.col("raise_time"), F.col("first_detection_time"))
        )
    )


def point_recall_summary(aligned: DataFrame) -> DataFrame:
    """Point recall per plant and overall (plant_id null)."""
    return (
        aligned.groupingSets([["plant_id"], []], "plant_id")
        .agg(
            F.count(F.lit(1)).alias("alarm_points"),
            F.sum("detected").alias("detected_points"),
            F.sum("output_available").alias("output_available_points"),
            F.sum("score_eligible").alias("score_eligible_points"),
        )
        .withColumns(
            {
                "missed_points": F.col("alarm_points") - F.col("detected_points"),
                "point_recall": _ratio("detected_points", "alarm_points"),
                "output_coverage": _ratio("output_available_points", "alarm_points"),
                "score_eligible_percent": _ratio("score_eligible_points", "alarm_points", 100.0),
            }
        )
    )


def event_recall_summary(events: DataFrame) -> DataFrame:
    """Event recall and detection delays per plant and overall (plant_id null)."""
    scoped = events.select(
        F.explode(F.array(F.lit("plant"), F.lit("overall"))).alias("scope"),
        "plant_id",
        "event_detected",
        "detection_delay_minutes",
    ).withColumn("plant_id", F.when(F.col("scope") == "plant", F.col("plant_id")).otherwise(""))
    counts = scoped.groupBy("scope", "plant_id").agg(
        F.count(F.lit(1)).alias("alarm_events"),
        F.sum("event_detected").alias("detected_events"),
        F.max("detection_delay_minutes").alias("delay_maximum"),
    )
    delays = quantiles(scoped, ["scope", "plant_id"], "detection_delay_minutes", [0.5, 0.9])
    return (
        counts.join(delays, ["scope", "plant_id"], "left")
        .withColumns(
            {
                "missed_events": F.col("alarm_events") - F.col("detected_events"),
                "event_recall": _ratio("detected_events", "alarm_events"),
                "delay_median": F.get("q", 0),
                "delay_p90": F.get("q", 1),
            }
        )
        .drop("q", "n")
    )


# --- every prediction column and scope -------------------------------------


def _long_predictions(predictions: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return predictions.select(
        *keys,
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("prediction_column"), F.col(c).cast("int").alias("predicted")) for c in columns]
            )
        ),
    )


def evaluate_points(
    predictions: DataFrame,
    labels: DataFrame,
    columns: Sequence[str] = ("combined_alert", "lof_alert", "zero_current_alert"),
    station: str = "station_name",
) -> DataFrame:
    """Point metrics for each prediction column, per string and per device."""
    string_keys = [station, "device_no", "string_no", "event_time"]
    device_keys = [station, "device_no", "event_time"]
    long = _long_predictions(predictions, columns, string_keys)
    scopes: Mapping[str, tuple[list[str], DataFrame, DataFrame]] = {
        "string": (string_keys, long, labels.where("label_scope = 'string'")),
        "device": (
            device_keys,
            long.groupBy(*device_keys, "prediction_column").agg(F.max("predicted").alias("predicted")),
            labels,
        ),
    }
    parts = []
    for scope, (keys, rows, truth) in scopes.items():
        marked = truth.select(*keys).distinct().withColumn("label", F.lit(1))
        joined = rows.join(marked, keys, "left").withColumn("label", F.coalesce("label", F.lit(0)))
        part = binary_metrics(joined, "label", "predicted", ["prediction_column"]).withColumn("scope", F.lit(scope))
        parts.append(part)
    result = parts[0].unionByName(parts[1])
    return result.withColumn("positive_labels", F.col("true_positive") + F.col("false_negative"))


def evaluate_events(
    predictions: DataFrame,
    events: DataFrame,
    columns: Sequence[str] = ("combined_alert", "lof_alert", "zero_current_alert"),
    station: str = "station_name",
    interval_minutes: int = 5,
) -> DataFrame:
    """Event metrics for each prediction column, per string and per device scope."""
    string_keys = ("prediction_column", station, "device_no", "string_no")
    device_keys = ("prediction_column", station, "device_no")
    long = _long_predictions(predictions, columns, [station, "device_no", "string_no", "event_time"])
    active = long.where("predicted = 1")
    names = F.explode(F.array(*[F.lit(c) for c in columns]))
    truth = events.withColumn("prediction_column", names)
    parts = []
    for scope, keys in (("string", string_keys), ("device", device_keys)):
        rows = active.select(*keys, "event_time").distinct()
        found = alert_events(rows, F.lit(True), interval_minutes, keys)
        labels = truth.where(F.col("label_scope") == scope).select(*keys, "raise_time", "end_time")
        labels = labels.withColumnRenamed("end_time", "label_end_time")
        p = intervals.overlaps_any(found, labels, keys, "start_time", "end_time", "raise_time", "label_end_time", "_hit")
        t = intervals.overlaps_any(labels, found, keys, "raise_time", "label_end_time", "start_time", "end_time", "_hit")
        side_p = p.groupBy("prediction_column").agg(
            F.count(F.lit(1)).alias("predicted_events"), F.sum("_hit").alias("predicted_events_hit")
        )
        side_t = t.groupBy("prediction_column").agg(
            F.count(F.lit(1)).alias("label_events"), F.sum("_hit").alias("label_events_hit")
        )
        parts.append(side_p.join(side_t, "prediction_column", "full").withColumn("label_scope", F.lit(scope)))
    result = parts[0].unionByName(parts[1]).fillna(0)
    return with_scores(result, "predicted_events_hit", "predicted_events", "label_events_hit", "label_events")


def weak_label_alignment(alerts: DataFrame, labels: DataFrame, statuses: Sequence[int] = (2, 4)) -> DataFrame:
    """Flag alert rows whose device reported an abnormal overall status then."""
    weak = (
        labels.where(F.col("string_overall_status").isin(*statuses))
        .select("plant_id", "device_no", F.col("event_time").alias("target_time"))
        .distinct()
        .withColumn("weak_current_label", F.lit(1))
    )
    return alerts.join(weak, ["plant_id", "device_no", "target_time"], "left").withColumn(
        "weak_current_label", F.coalesce("weak_current_label", F.lit(0))
    )


def distribution_table(frame: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Rows, flagged rows and rates per group."""
    counted = frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        *[F.count_if(F.col(f).cast("boolean")).alias(f"{f}_points") for f in flags],
    )
    return counted.withColumns({f"{f}_rate": F.col(f"{f}_points") / F.col("samples") for f in flags})
