"""Versions of a detector side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringwatch.config import ResidualSettings
from stringwatch.functions.arrays import number_list
from stringwatch.functions.gates import absolute_drop
from stringwatch.functions.timegrid import local_text
from stringwatch.operators import runs
from stringwatch.operators.quantiles import quantiles
from stringwatch.operators.residuals import add_raw_alerts
from stringwatch.schema import DEVICE_KEYS, POINT_KEYS

EMPTY = "array<int>"
#: ends of the comparison cases; those of one version begin with its name
CASES = ("both_same", "both_different", "_only")


def alerted_strings(points: DataFrame, alert: Column, name: str) -> DataFrame:
    """Alerted string numbers of each device-time, as an ascending array."""
    return (
        points.where(F.coalesce(alert.cast("boolean"), F.lit(False)))
        .groupBy(*POINT_KEYS)
        .agg(F.array_sort(F.collect_set(F.col("string_no").cast("int"))).alias(name))
    )


def comparison_case(left: Column, right: Column, left_name: str, right_name: str) -> Column:
    """Which of two string lists alerted, and whether they agree."""
    has_left, has_right = F.size(left) > 0, F.size(right) > 0
    return (
        F.when(has_left & ~has_right, f"{left_name}_only")
        .when(~has_left & has_right, f"{right_name}_only")
        .when(left != right, "both_different")
        .otherwise("both_same")
    )


def compare_two(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Full outer join of two versions' alerted strings per device-time."""
    joined = left.join(right, list(POINT_KEYS), "full")
    none = F.array().cast(EMPTY)
    filled = joined.withColumns({n: F.coalesce(F.col(n), none) for n in (left_name, right_name)})
    return filled.withColumn(
        "comparison_case", comparison_case(F.col(left_name), F.col(right_name), left_name, right_name)
    )


def compare_columns(points: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Several alert columns of one frame, one list each, in one aggregation."""
    return points.groupBy(*POINT_KEYS).agg(
        *[
            F.array_sort(
                F.collect_set(F.when(F.coalesce(F.col(c).cast("boolean"), F.lit(False)), F.col("string_no").cast("int")))
            ).alias(label)
            for label, c in columns.items()
        ]
    )


def comparison_events(points: DataFrame, names: Sequence[str], interval_minutes: int = 5) -> DataFrame:
    """Contiguous compared device-times as events with the union of strings.

    Each point contributes a small set; the union cannot outgrow the channels.
    """
    line = runs.Timeline(DEVICE_KEYS, "event_time", interval_minutes)
    active = points.where(sum((F.size(n) for n in names), F.lit(0)) > 0)

    def tagged(position: int, name: str) -> Column:
        return F.transform(name, lambda s: F.struct(F.lit(position).alias("v"), s.alias("s")))

    named = runs.with_run_start(active, line, "start_time").withColumn(
        "_all",
        F.flatten(F.array(*[tagged(i, n) for i, n in enumerate(names)])),
    )
    spans = named.groupBy(*DEVICE_KEYS, "start_time").agg(
        F.max("event_time").alias("end_time"), F.count(F.lit(1)).alias("alert_time_points")
    )
    sets = (
        named.select(*DEVICE_KEYS, "start_time", F.inline("_all"))
        .groupBy(*DEVICE_KEYS, "start_time")
        .agg(*[F.array_sort(F.collect_set(F.when(F.col("v") == i, F.col("s")))).alias(n) for i, n in enumerate(names)])
    )
    return spans.join(sets, [*DEVICE_KEYS, "start_time"]).withColumn(
        "duration_minutes",
        ((F.unix_micros("end_time") - F.unix_micros("start_time")) / 60_000_000 + interval_minutes).cast("int"),
    )


def as_text(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    """String lists as zero-padded text."""
    return frame.withColumns({n: number_list(F.col(n)) for n in names})


def review_columns(events: DataFrame, timezone: str = "Asia/Shanghai") -> DataFrame:
    """Local times and the blank columns a reviewer fills in."""
    return events.withColumns(
        {
            "raise_time_local": local_text("start_time", timezone),
            "end_time_local": local_text("end_time", timezone),
            "manual_is_low_current": F.lit(""),
            "manual_string_no": F.lit(""),
            "review_note": F.lit(""),
        }
    )


def filtered_strings(left: DataFrame, right: DataFrame, alert: str, diagnostics: Sequence[str]) -> DataFrame:
    """Strings the first version alerts and the second does not, with diagnostics.

    ``isolated_absolute_drop`` is derived where the first version lacks it but
    has the expected and the measured current. Both sides are unique per string
    and time; a repeated key of the second would repeat rows.
    """
    keys = [*POINT_KEYS, "string_no"]
    if "isolated_absolute_drop" not in left.columns and {"expected_current", "string_current"} <= set(left.columns):
        left = left.withColumn("isolated_absolute_drop", absolute_drop(F.col("expected_current"), F.col("string_current")))
    second = right.select(*keys, F.col(alert).cast("boolean").alias("_second"))
    return (
        left.where(F.coalesce(F.col(alert).cast("boolean"), F.lit(False)))
        .join(second, keys, "left")
        .where(~F.coalesce("_second", F.lit(False)))
        .select(*keys, *[c for c in diagnostics if c in left.columns])
    )


def gate_versions(scored: DataFrame, first: ResidualSettings, second: ResidualSettings) -> tuple[DataFrame, DataFrame]:
    """The same scores under two effect gates: each with ``gated_alert``, an isolated or group candidate.

    ``scored`` is read by both, so pass a staged table.
    """
    either = (F.col("isolated_raw_alert") == 1) | (F.col("collective_raw_alert") == 1)
    one, two = (add_raw_alerts(scored, settings).withColumn("gated_alert", either.cast("int")) for settings in (first, second))
    return one, two


def plant_report(events: DataFrame, points: DataFrame, filtered: DataFrame) -> DataFrame:
    """Per plant and overall (plant_id null): events, points and filtered strings, and events and points of every case.

    A plant appears if it has events or points.
    """

    def counted(frame: DataFrame, name: str) -> DataFrame:
        cases = CASES if "comparison_case" in frame.columns else ()
        return frame.groupingSets([["plant_id"], []], "plant_id").agg(
            F.grouping("plant_id").cast("int").alias("overall"),
            F.count(F.lit(1)).alias(name),
            *[F.count_if(F.col("comparison_case").endswith(c)).alias(f"{name}_{c.strip('_')}") for c in cases],
        )

    keys = ["plant_id", "overall"]
    parts = [counted(events, "events"), counted(points, "points"), counted(filtered, "filtered_strings")]
    names = [[c for c in part.columns if c not in keys] for part in parts]
    rows = None
    for part in parts:
        padded = part.select(*keys, *[F.col(c) if c in part.columns else F.lit(None).cast("long").alias(c) for own in names for c in own])
        rows = padded if rows is None else rows.unionByName(padded)
    report = rows.groupBy(*keys).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for own in names for c in own])
    return report.where("overall = 1 or events + points > 0").drop("overall")


def case_counts(frame: DataFrame, keys: Sequence[str] = ("plant_id",)) -> DataFrame:
    """Comparison cases per plant and overall (plant_id null)."""
    sets = [[*keys, "comparison_case"], ["comparison_case"]]
    return frame.groupingSets(sets, *keys, "comparison_case").agg(F.count(F.lit(1)).alias("count"))


def drop_distribution(filtered: DataFrame, value: str = "isolated_absolute_drop", small: float = 0.5) -> DataFrame:
    """Range, median, 90 % quantile and share of small drops of filtered strings."""
    counts = filtered.agg(
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
        F.count_if(F.col(value) < small).alias("below_small"),
    )
    # one row, and one or none
    table = quantiles(filtered, [], value, [0.5, 0.9]).select("n", F.get("q", 0).alias("median"), F.get("q", 1).alias("p90"))
    joined = counts.join(table, F.lit(True), "left")
    return joined.select(*counts.columns, F.coalesce("n", F.lit(0)).alias("samples"), "median", "p90")
