"""Residual detector: peers, branches, continuity, gates."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stringwatch.config import ResidualSettings, WeatherSettings
from stringwatch.operators import irradiance as irr
from stringwatch.operators import residuals as res

START = dt.datetime(2026, 6, 1)
SMALL = ResidualSettings(n_neighbors=2, minimum_peer_devices=2, minimum_strings=4)


def wide(spark, rows):
    """rows: list of {device: currents}, five minutes apart."""
    count = max(len(c) for row in rows for c in row.values())
    data = [
        (START + dt.timedelta(minutes=5 * i), 234, device, len(c), *[float(x) for x in c])
        for i, row in enumerate(rows)
        for device, c in row.items()
    ]
    names = ["event_time", "plant_id", "device_no", "main_string_count"]
    return spark.createDataFrame(data, names + [f"string_current_{i + 1:02d}" for i in range(count)])


def history(spark, strings):
    return wide(spark, [{"a": [x] * strings, "b": [2 * x] * strings, "c": [1.5 * x] * strings} for x in (10, 12, 8)])


def steady(a, strings):
    return {"a": a, "b": [20] * strings, "c": [15] * strings}


@pytest.fixture(scope="module")
def five(spark):
    return res.fit_residual_model(history(spark, 5), SMALL)


@pytest.fixture(scope="module")
def ten(spark):
    return res.fit_residual_model(history(spark, 10), SMALL)


def test_leave_one_out_median_random(spark):
    rng = random.Random(3)
    rows = []
    for t in range(80):
        for d in range(rng.randint(1, 8)):
            rows.append((t, f"d{d}", rng.choice([None, 1.0, 2.0, 2.0, rng.random()])))
    frame = spark.createDataFrame(rows, "t int, d string, v double")
    got = irr.leave_one_out_median(frame, ["t"], "d", "v", "m", "n").collect()
    for r in got:
        others = [v for t, d, v in rows if t == r.t and d != r.d and v is not None]
        assert r.n == len(others)
        assert r.m == (pytest.approx(np.median(others)) if others else None)


def test_common_drop_is_not_alerted(spark, five):
    scored = five.apply(wide(spark, [{"a": [5] * 5, "b": [10] * 5, "c": [7.5] * 5}])).collect()
    assert all(r.virtual_irradiance is not None for r in scored)
    assert not any(r.residual_alert for r in scored)


def test_isolated_and_collective(spark, five):
    rows = [steady([10] * 5, 5)] * 2 + [steady([10, 10, 10, 10, 3], 5)] * 3
    low = five.apply(wide(spark, rows)).where("device_no = 'a' and string_no = 5").orderBy("event_time").collect()
    assert [r.isolated_raw_alert for r in low] == [0, 0, 1, 1, 1]
    assert [r.residual_alert for r in low] == [0, 0, 0, 1, 1]
    assert low[-1].alert_reason == "isolated"
    group = five.apply(wide(spark, [steady([10, 10, 5, 5, 10], 5)] * 2))
    members = group.where("device_no = 'a' and string_no in (3, 4)").collect()
    assert all(r.collective_raw_alert for r in members)


def test_zero_current_is_not_a_residual_alert(spark, five):
    zero = five.apply(wide(spark, [steady([10, 10, 10, 10, 0], 5)] * 2)).where("device_no = 'a' and string_no = 5")
    assert [(r.zero_current_alert, r.residual_alert) for r in zero.collect()] == [(1, 0)] * 2


def test_new_member_alerts_after_the_group_is_confirmed(spark):
    model = res.fit_residual_model(history(spark, 6), SMALL)
    scored = model.apply(wide(spark, [steady([10, 10, 5, 5, 10, 10], 6), steady([10, 10, 5, 5, 7, 10], 6)]))
    second = scored.where("device_no = 'a' and minute(event_time) = 5 and string_no = 5").first()
    assert second.collective_event_alert == 1 and second.collective_event_consecutive == 2
    assert second.collective_member_alert == 1 and second.residual_alert == 1


def flat_points(spark, rule):
    rows = [
        ("234", "a", s, START + dt.timedelta(minutes=5 * t), *rule(t, s), 0)
        for t in range(2)
        for s in range(1, 11)
    ]
    names = "plant_id string, device_no string, string_no int, event_time timestamp, isolated_raw_alert int, collective_raw_alert int, zero_current_alert int"
    return spark.createDataFrame(rows, names)


def test_jaccard_resets_on_sharp_expansion(spark):
    frame = flat_points(spark, lambda t, s: (0, int(s <= (2 if t == 0 else 9))))
    second = res.add_persistence(frame, ResidualSettings()).where("minute(event_time) = 5").first()
    assert second.collective_overlap == 2 / 9
    assert second.collective_event_consecutive == 1 and second.collective_event_alert == 0


def test_mixed_persistence_is_kept(spark):
    frame = flat_points(spark, lambda t, s: (int(t == 0 and s == 1), int(t == 1))).where("string_no <= 2")
    row = res.add_persistence(frame, ResidualSettings()).where("minute(event_time) = 5 and string_no = 1").first()
    assert row.legacy_alert == 1 and row.residual_alert == 1 and row.alert_reason == "mixed_persistence"


def test_group_above_half_is_rejected(spark, ten):
    device = ten.apply(wide(spark, [steady([5] * 6 + [10] * 4, 10)])).where("device_no = 'a'").collect()
    assert all(r.collective_group_size == 0 and r.collective_raw_alert == 0 for r in device)


def test_effect_gate(spark, ten):
    gated = ten.with_settings(ten.settings.derive(minimum_isolated_relative_drop=0.10))
    for current, passes in ((9.4, 0), (7.0, 1)):
        row = gated.apply(wide(spark, [steady([current] + [10] * 9, 10)])).where("device_no = 'a' and string_no = 1").first()
        assert (row.isolated_relative_drop >= 0.10) == bool(passes)
        assert row.isolated_effect_eligible == passes and row.isolated_directional_raw_alert == passes


def weather_frame(spark):
    rows = []
    for step in range(8):
        for device, scale in (("a", 1.0), ("b", 1.5), ("c", 2.0)):
            rows.append((START + dt.timedelta(minutes=5 * step), 234, device, *[(5.0 + step) * scale] * 5))
    names = ["event_time", "plant_id", "device_no"] + [f"string_current_{i:02d}" for i in range(1, 6)]
    weather = spark.createDataFrame(
        [(START + dt.timedelta(minutes=15 * i), 234, g) for i, g in enumerate((100.0, 400.0, 800.0))],
        "time timestamp, plant_id int, forecast_ghi double",
    )
    return spark.createDataFrame(rows, names), weather


def test_weather_is_bounded_and_falls_back(spark):
    frame, weather = weather_frame(spark)
    model = res.fit_residual_model(frame, SMALL)
    context = model.context(frame)
    settings = WeatherSettings(minimum_mapping_samples=2, mapping_bins=3)
    mapping = irr.fit_weather_map(context, weather, settings)
    assert mapping.count() == 1
    rows = irr.condition_context(context, weather, mapping, SMALL, settings).collect()
    both = [r for r in rows if r.raw_virtual_irradiance is not None and r.forecast_available]
    assert both and all(0.8 <= r.conditioned_virtual_irradiance / r.raw_virtual_irradiance <= 1.2 for r in both)
    none = irr.condition_context(context, weather.where("false"), mapping, SMALL, settings).collect()
    assert all(r.conditioned_virtual_irradiance == r.raw_virtual_irradiance for r in none)
    alone = model.context(frame.where("device_no = 'a'"))
    only = [r for r in irr.condition_context(alone, weather, mapping, SMALL, settings).collect() if r.forecast_available]
    assert only and all(r.raw_virtual_irradiance is None for r in only)
    assert all(r.conditioned_virtual_irradiance is not None for r in only)
    assert all(r.conditioned_peer_count >= SMALL.minimum_peer_devices for r in only)


def test_asof_join_random(spark):
    from stringwatch.operators.asof import asof_join

    rng = random.Random(5)
    left = [("p", rng.randint(0, 500), i) for i in range(200)]
    right = [("p", m, float(m)) for m in rng.sample(range(500), 40)]
    at = F.timestamp_seconds(F.col("m") * 60)
    lf = spark.createDataFrame(left, "k string, m int, i int").withColumn("lt", at)
    rf = spark.createDataFrame(right, "k string, m int, v double").withColumn("rt", at)
    got = {r.i: r.v for r in asof_join(lf, rf, ["k"], "lt", "rt", ["v"], 15).collect()}
    assert len(got) == 200
    for _, m, i in left:
        near = [v for _, x, v in right if x <= m and m - x <= 15]
        assert got[i] == (max(near) if near else None)


def test_persistence_moves_points_once(spark):
    """Groups as bits and streaks follow from windows inside a device: one exchange, and the rows of the joined way."""
    rng, rows, start = random.Random(3), [], dt.datetime(2026, 6, 1)
    for device in ("a", "b"):
        minute = 0
        for _ in range(120):
            minute += rng.choice([5, 5, 5, 5, 10])
            low = set(rng.sample([1, 2, 63, 64, 65, 99], rng.randint(0, 5)))
            rows += [(start + dt.timedelta(minutes=minute), "p", device, s, int(rng.random() < 0.2), int(s in low)) for s in (1, 2, 63, 64, 65, 99)]
    schema = "event_time timestamp, plant_id string, device_no string, string_no int, isolated_raw_alert int, collective_raw_alert int"
    points = spark.createDataFrame(rows, schema)
    settings = ResidualSettings(minimum_consecutive=2, collective_overlap_threshold=0.5)
    once = res.add_persistence(points, settings)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    joined = res.add_persistence(points, settings, chunk_minutes=60)
    columns = ["plant_id", "device_no", "string_no", "event_time", "collective_overlap", "collective_event_consecutive", "residual_alert", "alert_reason"]
    order = ["device_no", "event_time", "string_no"]
    got, want = once.select(columns).orderBy(order).collect(), joined.select(columns).orderBy(order).collect()
    assert got == want and any(r.alert_reason == "collective" for r in got)
