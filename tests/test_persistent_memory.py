"""Persistent groups, context thresholds and confirmed-anomaly memory."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stringwatch.config import HierarchySettings, MemorySettings, PersistentSettings
from stringwatch.operators import memory, persistent, thresholds

START = dt.datetime(2026, 6, 1)
LOOSE = PersistentSettings(
    deficit_quantile=0.5,
    minimum_device_samples=1,
    minimum_device_days=1,
    minimum_plant_count_samples=1,
    minimum_plant_count_days=1,
    minimum_count_samples=1,
    minimum_count_days=1,
    shrinkage_k=1,
)


def points(spark, periods=12, ratio=lambda t, s: 0.9, members=lambda t: 3, strings=8, skip=()):
    rows = []
    for t in range(periods):
        if t in skip:
            continue
        for s in range(1, strings + 1):
            low = s <= members(t)
            r = ratio(t, s) if low else 1.0
            rows.append((START + dt.timedelta(minutes=5 * t), "234", "dev-a", s, r, 10 * r, True, low, int(s == 8)))
    return spark.createDataFrame(
        rows,
        "event_time timestamp, plant_id string, device_no string, string_no int, residual_ratio double, "
        "string_current double, response_known boolean, collective_group_member boolean, hier_strict_alert int",
    )


def device_times(scored):
    return scored.select("event_time", "persistent_event_alert").distinct()


@pytest.fixture(scope="module")
def fitted(spark):
    return persistent.fit_persistent(points(spark), LOOSE)


def test_six_continuous_points(spark, fitted):
    model, report = fitted
    assert report["structural_candidate_rows"] == 12 and report["candidate_rows"] == 7
    scored = persistent.apply_persistent(points(spark), model)
    alerts = [r.event_time for r in device_times(scored).where("persistent_event_alert = 1").collect()]
    assert len(alerts) == 7 and min(alerts) == START + dt.timedelta(minutes=25)
    per_string = {r.string_no: r.n for r in scored.groupBy("string_no").agg(F.sum("persistent_collective_member_alert").alias("n")).collect()}
    assert per_string[1] == 7 and per_string[4] == 0
    assert sorted(r.string_no for r in persistent.persistent_events(scored).collect()) == [1, 2, 3]
    # the parallel branch leaves the strict alert alone
    assert scored.where("string_no = 8 and (hier_strict_alert <> 1 or combined_alert <> 1)").count() == 0


def test_a_missing_point_breaks_persistence(spark, fitted):
    scored = persistent.apply_persistent(points(spark, 8, skip=(3,)), fitted[0])
    assert scored.where("persistent_event_alert = 1").count() == 0


def test_threshold_is_for_the_window_median(spark, fitted):
    scored = persistent.apply_persistent(points(spark, 6, lambda t, s: 0.94 if t == 2 else 0.9), fitted[0])
    last = scored.where(F.minute("event_time") == 25).first()
    assert last.persistent_window_median_deficit == pytest.approx(0.1) and last.persistent_event_alert == 1


def test_extreme_tail_is_capped(spark):
    settings = LOOSE.derive(deficit_quantile=0.995)
    model, _ = persistent.fit_persistent(points(spark, 40, lambda t, s: 0.2 if t >= 32 else 0.9), settings)
    assert model.global_threshold < 0.2


def test_expansion_resets_the_group(spark, fitted):
    frame = points(spark, 6, lambda t, s: 0.7, lambda t: 2 if t < 5 else 5, strings=10)
    last = persistent.apply_persistent(frame, fitted[0]).where(F.minute("event_time") == 25).first()
    assert last.persistent_membership_overlap == pytest.approx(2 / 5) and last.persistent_consecutive == 1
    assert last.persistent_event_alert == 0


def test_hierarchy_falls_back_and_shrinks(spark):
    rng = random.Random(2)
    rows = []
    for plant, device, count, n in (("p", "big", 10, 60), ("p", "small", 10, 5), ("q", "other", 8, 40)):
        for i in range(n):
            rows.append((plant, device, count, rng.uniform(1, 3), dt.date(2026, 6, 1 + i % 4)))
    frame = spark.createDataFrame(rows, "plant_id string, device_no string, string_count int, value double, day date")
    settings = HierarchySettings(
        quantile=0.9, minimum_device_samples=50, minimum_device_days=3, minimum_plant_count_samples=50,
        minimum_plant_count_days=3, minimum_count_samples=45, minimum_count_days=3, shrinkage_k=20,
    )
    fitted = thresholds.fit_context_thresholds(frame, settings)
    import numpy as np

    def q(test):
        values = [r[3] for r in rows if test(r)]
        return np.quantile(values, 0.9), len(values)

    top, _ = q(lambda r: True)
    assert fitted.global_threshold == pytest.approx(top)
    c, n = q(lambda r: r[2] == 10)
    count10 = top + n / (n + 20) * (c - top)
    assert [(r.string_count, r.threshold) for r in fitted.counts.collect()] == [(10, pytest.approx(count10))]
    c, n = q(lambda r: r[0] == "p")
    plant10 = count10 + n / (n + 20) * (c - count10)
    assert fitted.plant_counts.first().threshold == pytest.approx(plant10)
    c, n = q(lambda r: r[1] == "big")
    assert fitted.devices.first().threshold == pytest.approx(plant10 + n / (n + 20) * (c - plant10))
    probe = spark.createDataFrame(
        [("p", "big", 10), ("p", "small", 10), ("x", "y", 10), ("x", "y", 3)],
        "plant_id string, device_no string, available_strings int",
    )
    got = thresholds.with_context_threshold(probe, fitted, "t", "l").collect()
    assert sorted(r.l for r in got) == ["count", "device", "global", "plant_count"]


def brute_memory(rows, enter=3, clear=3):
    out, state = {}, {}
    for key, minute, raw, ok in rows:
        previous, active, streak, normals = state.get(key, (None, False, 0, 0))
        if previous is None or minute - previous != 5 or not ok:
            active, streak, normals = False, 0, 0
        alert = False
        if ok:
            if raw:
                streak, normals = streak + 1, 0
                active = active or streak >= enter
                alert = active
            else:
                streak, normals = 0, normals + 1
                if normals >= clear:
                    active = False
        state[key] = (minute, active, streak, normals)
        out[key, minute] = (int(alert), int(ok and active))
    return out


@pytest.mark.parametrize("chunk", [None, 45])
def test_memory_equals_the_automaton(spark, chunk):
    rng = random.Random(9)
    rows = []
    for key in range(3):
        minute = 0
        for _ in range(400):
            minute += rng.choice([5] * 20 + [10])
            rows.append((key, minute, rng.random() < 0.6, rng.random() < 0.97))
    frame = spark.createDataFrame(rows, "string_no int, minute int, raw boolean, ok boolean").select(
        "*", F.lit("p").alias("plant_id"), F.lit("d").alias("device_no"), F.timestamp_seconds(F.col("minute") * 60).alias("event_time")
    )
    result = memory.add_memory(frame, F.col("raw"), F.col("ok"), chunk_minutes=chunk)
    got = {(r.string_no, r.minute): (r.memory_alert, r.memory_active) for r in result.collect()}
    assert got == brute_memory(rows)
    if chunk is None:
        events = memory.reconstruct_events(result).collect()
        assert sum(e.alert_points for e in events) == sum(a for a, _ in got.values())
        assert any(e.confirmed and e.first_alert_time > e.start_time for e in events)
        assert any(not e.confirmed for e in events)
        assert memory.memory_report(result).count() == 2
