"""Training features: facts on tiny frames."""

import datetime as dt

import pytest

from stringwatch.operators import training

SETTINGS = training.TrainingSettings()


def rows(spark, values):
    names = "event_time timestamp, plant_id int, device_no string, active_power double, dc_power double, total_power double, rated_power double, device_temperature double, status_code int"
    return spark.createDataFrame(values, names)


def row(time, power, plant=1, status=1, total=None):
    return (time, plant, "same", power, power + 0.5, total, 100.0, 30.0, status)


@pytest.mark.parametrize("chunk", [None, 5])
def test_candidate_needs_a_good_next_step(spark, chunk):
    t = dt.datetime(2026, 5, 1)
    frame = rows(spark, [row(t, 10.0), row(t + dt.timedelta(minutes=5), 11.0), row(t + dt.timedelta(minutes=10), 0.0, status=0)])
    got = training.add_quality_and_targets(frame, SETTINGS, chunk).orderBy("event_time").collect()
    assert [r.candidate_normal for r in got] == [True, False, False]
    assert got[0].target_active_power == 11.0 and all(r.quality_finite for r in got)


def test_target_in_another_split_is_rejected(spark):
    frame = rows(spark, [row(dt.datetime(2026, 5, 31, 15, 55), 10.0), row(dt.datetime(2026, 5, 31, 16), 11.0)])
    got = training.add_quality_and_targets(frame, SETTINGS).collect()
    assert not any(r.candidate_normal for r in got)
    assert sorted(r.split for r in got) == ["train", "validation"]


def test_plants_are_kept_apart(spark):
    t = dt.datetime(2026, 5, 1)
    frame = rows(spark, [row(t, 10.0, 234), row(t + dt.timedelta(minutes=5), 11.0, 234), row(t, 20.0, 892), row(t + dt.timedelta(minutes=5), 21.0, 892)])
    got = training.add_quality_and_targets(frame, SETTINGS).where("target_active_power is not null").collect()
    assert sorted((r.device_key, r.target_active_power) for r in got) == [("234::same", 11.0), ("892::same", 21.0)]


def test_residual_audit_bins(spark):
    frame = spark.createDataFrame(
        [("a", 0.1, 2.0, 5.0), ("a", 0.5, 10.0, 2.0)],
        "device_no string, active_power_ratio double, absolute_error double, baseline_absolute_error double",
    ).withColumn("power_bin", training.power_bin(training.F.col("active_power_ratio")))
    total = training.residual_audit(frame).first()
    assert total.samples == 2 and total.mae_delta == pytest.approx(2.5) and total.win_rate == 0.5
    bins = {r.power_bin: r.mae_delta for r in training.residual_audit(frame, (("power_bin",),)).collect()}
    assert bins == {"10-20%": pytest.approx(-3.0), "40-60%": pytest.approx(8.0)}


def test_windows_and_baselines(spark):
    t = dt.datetime(2026, 1, 1)
    data = [
        (t + dt.timedelta(minutes=5 * i), "p", "a", 10.0 * (i + 1), 0.1 * (i + 1), 100.0, 10.0 * (i + 2), True, 0.1) for i in range(4)
    ]
    frame = spark.createDataFrame(
        data,
        "event_time timestamp, plant_id string, device_no string, active_power double, active_power_ratio double, rated_power double, target_active_power double, candidate_normal boolean, peer_median_ramp_ratio double",
    )
    windows = training.feature_windows(training.baseline_predictions(frame), ["active_power_ratio"], 2)
    got = windows.orderBy("event_time").collect()
    assert [r.baseline_prediction for r in got] == [20.0, 30.0, 40.0]
    assert [r.baseline_residual for r in got] == [10.0] * 3
    assert [r.peer_physical_residual for r in got] == pytest.approx([0.0] * 3)
    assert all(len(r.sequence) == 2 for r in got)


def test_metrics_and_scaler(spark):
    frame = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 3.0), ("b", 5.0, 4.0)], "d string, y double, p double")
    total = training.regression_metrics(frame, "y", "p").first()
    assert total.mae == pytest.approx(2 / 3) and total.bias == pytest.approx(0)
    assert training.regression_metrics(frame, "y", "p", (("d",), ())).count() == 3
    scaled = training.apply_scaler(frame, training.fit_scaler(frame, ["y"])).collect()
    assert sum(r.y for r in scaled) == pytest.approx(0)
