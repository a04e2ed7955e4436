"""Alarms: parsing, scope, grid, interval joins, classification, evaluation."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from stringwatch.functions.arrays import parse_number_list
from stringwatch.operators import alarms, coverage, evaluate, intervals
from stringwatch.sources import alarm_files

T0 = dt.datetime(2026, 6, 1, 10)


def at(minute, second=0):
    return T0 + dt.timedelta(minutes=minute, seconds=second)


@pytest.fixture(scope="module")
def manifest(spark):
    return spark.createDataFrame([("plant one", "device-a"), ("plant one", "device-b")], ["station_name", "device_no"])


def test_parse_number_list(spark):
    frame = spark.createDataFrame([("3",), ("3, 10,11",), ("",), ("10",)], ["t"])
    assert [r[0] for r in frame.select(parse_number_list(F.col("t"))).collect()] == [[3], [3, 10, 11], [], [10]]


def test_read_and_expand(spark, manifest):
    path = f"{tempfile.mkdtemp(prefix='stringwatch-csv-')}/alarms.csv"
    lines = [
        "id,alarm_code,alarm_name,alarm_string,device_no,station_name,raise_time,end_time",
        "zero-1,101002,zero,3, device-a ,plant one,1780279200000,1780279800000",
        "low-1,101001,low,,device-a,plant one,1780279800000,1780280400000",
        "bad,101001,low,,device-a,plant one,x,1780280400000",
        "back,101001,low,,device-a,plant one,1780280400000,1780279800000",
        "code,5,low,,device-a,plant one,1780279800000,1780280400000",
        "other,101001,low,,device-z,plant one,1780279800000,1780280400000",
    ]
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write("\n".join(lines) + "\n")
    events = alarm_files.read_alarm_events(spark, path, manifest)
    report = alarms.read_scope_report(events).first()
    assert (report.alarm_events, report.string_scope_rows, report.device_scope_rows) == (2, 1, 1)
    points = alarms.expand_to_grid(events)
    assert points.count() == 6
    assert {r.label_scope for r in points.collect()} == {"string", "device"}


def test_grid_never_runs_backwards(spark):
    frame = spark.createDataFrame([("a", at(1), at(4)), ("b", at(0), at(0)), ("c", at(1), at(12))], ["id", "raise_time", "end_time"])
    got = {(r.id, r.event_time) for r in alarms.expand_to_grid(frame).collect()}
    assert got == {("b", at(0)), ("c", at(5)), ("c", at(10))}
    assert [r.id for r in alarms.without_grid_points(frame).collect()] == ["a"]


def random_intervals(seed, n, span=3000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.randint(0, span)
        rows.append((rng.choice("ab"), i, start, start + rng.choice([0, 3, 40, 700])))
    return rows


@pytest.mark.parametrize("bucket", [30, 1440])
def test_interval_joins_match_brute_force(spark, bucket):
    rng = random.Random(1)
    points = [(rng.choice("ab"), i, rng.randint(-50, 3100)) for i in range(300)]
    spans = random_intervals(2, 25)
    pf = spark.createDataFrame(points, "device_no string, i int, m int").select(
        "device_no", "i", F.timestamp_seconds(F.col("m") * 60).alias("event_time")
    )
    sf = spark.createDataFrame(spans, "device_no string, j int, a int, b int").select(
        "device_no", "j", F.timestamp_seconds(F.col("a") * 60).alias("start_time"), F.timestamp_seconds(F.col("b") * 60).alias("end_time")
    )
    keys = ["device_no"]
    pairs = {(i, j) for d, i, m in points for e, j, a, b in spans if d == e and a <= m <= b}
    got = intervals.points_in_windows(pf, sf, keys, bucket_minutes=bucket).collect()
    assert len(got) == len(pairs) and {(r.i, r.j) for r in got} == pairs
    inside = {i for d, i, m in points for e, j, a, b in spans if d == e and a - 10 <= m <= b + 10}
    kept = {r.i for r in intervals.exclude_windows(pf, sf, keys, bucket_minutes=bucket).collect()}
    assert kept == {i for _, i, _ in points} - inside
    assert {r.i for r in intervals.keep_windows(pf, sf, keys, buffer_minutes=10, bucket_minutes=bucket).collect()} == inside


@pytest.mark.parametrize("bucket", [30, 1440])
def test_overlaps_match_brute_force(spark, bucket):
    left, right = random_intervals(3, 40), random_intervals(4, 30)

    def frame(rows, i, a, b):
        return spark.createDataFrame(rows, f"device_no string, {i} int, s int, e int").select(
            "device_no", i, F.timestamp_seconds(F.col("s") * 60).alias(a), F.timestamp_seconds(F.col("e") * 60).alias(b)
        )

    lf, rf = frame(left, "i", "la", "lb"), frame(right, "j", "ra", "rb")
    pairs = {(i, j) for d, i, a, b in left for e, j, c, f in right if d == e and b >= c and a <= f}
    got = intervals.overlapping(lf, rf, ["device_no"], "la", "lb", "ra", "rb", bucket).collect()
    assert len(got) == len(pairs) and {(r.i, r.j) for r in got} == pairs
    hit = intervals.overlaps_any(lf, rf, ["device_no"], "la", "lb", "ra", "rb", "hit", bucket).collect()
    assert len(hit) == len(left) and {r.i for r in hit if r.hit} == {i for i, _ in pairs}


def test_classification_ladder(spark):
    rows = [("1", "d", at(5 * i), i != 4) for i in range(9) if i != 6]
    source = spark.createDataFrame(rows, "plant_id string, device_no string, event_time timestamp, current_complete boolean")
    events = [
        ("complete", "1", "d", at(1), at(16)),
        ("incomplete", "1", "d", at(16), at(22)),
        ("missing", "1", "d", at(27), at(36)),
        ("nogrid", "1", "d", at(1), at(2)),
        ("left", "1", "d", at(-10), at(6)),
        ("before", "1", "d", at(-30), at(-20)),
        ("unknown", "1", "x", at(1), at(16)),
        ("unmapped", None, "d", at(1), at(16)),
    ]
    frame = spark.createDataFrame(events, "alarm_event_id string, plant_id string, device_no string, raise_time timestamp, end_time timestamp")
    classified = alarms.classify_events(frame, source)
    got = {r.alarm_event_id: (r.classification, r.range_reason) for r in classified.collect()}
    assert got == {
        "complete": ("complete", "all_expected_points_complete"),
        "incomplete": ("within_range_gap", "missing_timestamp_or_current"),
        "missing": ("within_range_gap", "missing_timestamp_or_current"),
        "nogrid": ("within_range_gap", "no_grid_point"),
        "left": ("partially_outside_range", "left_or_right_boundary_outside"),
        "before": ("outside_production_range", "no_interval_overlap"),
        "unknown": ("outside_production_range", "station_or_device_not_found"),
        "unmapped": ("outside_production_range", "station_or_device_not_found"),
    }
    assert {r.event_time for r in alarms.complete_label_points(classified).collect()} == {at(5), at(10), at(15)}


def test_coverage_ladder(spark):
    wide = spark.createDataFrame(
        [("1", "d", at(0), 2, 1.0, 2.0), ("1", "d", at(0), 2, 9.0, 9.0), ("1", "d", at(5), 2, 1.0, None)],
        "plant_id string, device_no string, event_time timestamp, main_string_count int, string_current_01 double, string_current_02 double",
    )
    devices = spark.createDataFrame([("1", "d")], ["plant_id", "device_no"])
    points = [
        ("1", "d", at(0), "mapped", "complete"),
        ("1", "d", at(5), "mapped", "current_incomplete"),
        ("1", "d", at(10), "mapped", "production_timestamp_missing"),
        ("1", "x", at(0), "mapped", "production_device_missing"),
        ("2", "d", at(0), "mapped", "plant_not_audited"),
        (None, "d", at(0), "station_unmapped", "station_unmapped"),
    ]
    frame = spark.createDataFrame(points, "plant_id string, device_no string, event_time timestamp, station_mapping_status string, want string")
    frame = frame.withColumns(
        {"alarm_event_id": F.coalesce("want", F.lit("")), "alarm_code": F.lit("c"), "station_name": F.lit("s"), "raise_time": F.lit(at(0)), "end_time": F.lit(at(9))}
    )
    plants = spark.createDataFrame([("1",)], ["plant_id"])
    covered = coverage.attach_coverage(frame, coverage.production_rows(wide), devices, plants)
    rows = covered.collect()
    assert all(r.coverage_status == r.want for r in rows) and len(rows) == 6
    assert next(r for r in rows if r.want == "complete").production_row_count == 2
    events = {r.alarm_event_id: r.event_coverage_status for r in coverage.event_coverage(covered).collect()}
    assert events == {p[4]: p[4] for p in points}


def test_evaluation_of_string_predictions(spark):
    predictions = spark.createDataFrame(
        [("s", "device-a", 3, at(5 * i), int(i < 2), int(i < 2), int(i < 2)) for i in range(3)],
        "station_name string, device_no string, string_no int, event_time timestamp, combined_alert int, lof_alert int, zero_current_alert int",
    )
    events = spark.createDataFrame(
        [("zero-1", "s", "device-a", 3, "string", at(0), at(10))],
        "alarm_event_id string, station_name string, device_no string, string_no int, label_scope string, raise_time timestamp, end_time timestamp",
    )
    points = evaluate.evaluate_points(predictions, alarms.expand_to_grid(events))
    row = points.where("prediction_column = 'combined_alert' and scope = 'string'").first()
    assert (row.positive_labels, row.true_positive) == (3, 2)
    row = evaluate.evaluate_events(predictions, events).where("prediction_column = 'combined_alert' and label_scope = 'string'").first()
    assert (row.predicted_events_hit, row.label_events_hit) == (1, 1)


def test_restriction_to_predictions(spark):
    events = spark.createDataFrame([("s", "device-a"), ("t", "device-b")], ["station_name", "device_no"])
    predictions = events.where("station_name = 's'")
    assert alarms.restrict_to_predictions(events, predictions).count() == 1
    assert [tuple(r) for r in alarms.excluded_stations(events, predictions).collect()] == [("t", 1)]
