"""String detector on raw currents: loop equality, holes, ties, several devices."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stringwatch.config import LofSettings
from stringwatch.operators import strings
from stringwatch.sources import telemetry

NOON = dt.datetime(2026, 3, 14, 12, 0)
# channels of the fleet: numbering has holes
CHANNELS = (1, 2, 4, 7, 8, 9, 12)
RULES = LofSettings(n_neighbors=3, minimum_strings=5, threshold=1.5)


def fleet(spark, rows, statuses=False):
    """Rows of (step, plant, device, power, {channel: current} or {channel: (current, status)})."""
    names = ["event_time", "plant_id", "device_no", "active_power", "rated_power", "status_code"]
    kinds = ["timestamp", "int", "string", "double", "double", "int"]
    names += [f"string_current_{c:02d}" for c in CHANNELS]
    kinds += ["double"] * len(CHANNELS)
    if statuses:
        names += [f"string_status_{c:02d}" for c in CHANNELS]
        kinds += ["int"] * len(CHANNELS)
    data = []
    for step, plant, device, power, values in rows:
        pairs = [values.get(c) for c in CHANNELS]
        currents = [p[0] if isinstance(p, tuple) else p for p in pairs]
        data.append(
            (NOON + dt.timedelta(minutes=5 * step), plant, device, power, 80.0, 1, *currents)
            + (tuple(p[1] if p else None for p in pairs) if statuses else ())
        )
    return spark.createDataFrame(data, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def loop_scores(values, k, floor):
    """Local outlier factor in plain loops; ties go to the earlier string."""
    middle = float(np.median(values))
    ratio = [v / middle for v in values]
    near = []
    for i in range(len(ratio)):
        order = sorted((abs(ratio[i] - ratio[j]), j) for j in range(len(ratio)) if j != i)[:k]
        near.append(order)
    reach = [n[-1][0] for n in near]
    density = [1 / np.mean([max(d, reach[j], floor) for d, j in n]) for n in near]
    return ratio, [np.mean([density[j] for _, j in n]) / density[i] for i, n in enumerate(near)]


def test_scores_equal_plain_loops(spark):
    rng = random.Random(20)
    rows = []
    for step in range(12):
        for device in ("inv-3", "inv-9"):
            present = [c for c in CHANNELS if rng.random() < 0.9]
            rows.append((step, 6, device, 40.0, {c: round(rng.choice([7.5, 8.0, 8.0, rng.uniform(2, 9)]), 2) for c in present}))
    got = {}
    for r in strings.score_strings(fleet(spark, rows), RULES).collect():
        got.setdefault((r.event_time, r.device_no), {})[r.string_no] = r
    for step, _, device, _, values in rows:
        row = got[NOON + dt.timedelta(minutes=5 * step), device]
        assert sorted(row) == sorted(values)
        channels = sorted(values)
        if len(channels) < 5:
            assert all(row[c].lof_score is None for c in channels)
            continue
        ratio, score = loop_scores([values[c] for c in channels], 3, RULES.distance_floor)
        assert [row[c].string_current_ratio for c in channels] == pytest.approx(ratio)
        assert [row[c].lof_score for c in channels] == pytest.approx(score)


def test_dead_and_unconfigured_channels(spark):
    level = {c: (6.0 + c / 100, 1) for c in CHANNELS}
    rows = [(0, 6, "inv-3", 30.0, level | {4: (0.0, 4)}), (1, 6, "inv-3", 30.0, level | {12: (3.0, 0)}), (2, 6, "inv-3", 0.4, level)]
    scored = strings.score_strings(fleet(spark, rows, statuses=True), RULES).collect()
    dead = [r for r in scored if r.zero_current_alert]
    assert [(r.string_no, r.lof_score, r.lof_eligible, r.weak_zero_current_label) for r in dead] == [(4, None, False, True)]
    # a channel of status 0 does not exist, a row without daylight has no strings
    assert sorted((r.event_time.minute, r.string_no) for r in scored) == [(0, c) for c in CHANNELS] + [(5, c) for c in CHANNELS[:-1]]


def test_alerts_wait_for_a_second_point_in_a_row(spark):
    def values(low):
        return {c: 9.0 + c / 50 for c in CHANNELS} | ({7: 5.0} if low else {})

    pattern = {0: True, 1: True, 2: False, 3: True, 5: True, 6: True, 7: True}  # nothing came at step 4
    rows = [(s, plant, "inv-3", 50.0, values(low)) for s, low in pattern.items() for plant in (6, 8)]
    alerts = strings.apply_string_detector(fleet(spark, rows), RULES).where("string_no = 7")
    for plant in ("6", "8"):
        own = alerts.where(F.col("plant_id") == plant).orderBy("event_time").collect()
        assert [r.lof_consecutive for r in own] == [1, 2, 0, 1, 1, 2, 3]
        assert [r.lof_alert for r in own] == [0, 1, 0, 0, 0, 1, 1]
    events = strings.string_events(alerts).orderBy("plant_id", "start_time").collect()
    assert [(e.plant_id, e.points, e.duration_minutes) for e in events] == [(p, n, 5 * n) for p in (6, 8) for n in (1, 2)]


def test_mapped_plants_keep_their_strings_apart(spark):
    low = {c: 9.0 for c in CHANNELS} | {2: 4.0}
    rows = [(0, 6, "inv-3", 50.0, low), (1, 8, "inv-3", 50.0, low), (2, 8, "inv-3", 50.0, low)]
    mapped = telemetry.apply_plant_mapping(fleet(spark, rows), {"8": "6"})
    alerts = strings.apply_string_detector(mapped, RULES)
    assert alerts.count() == 21
    own = alerts.where("string_no = 2").orderBy("event_time").collect()
    assert [(r.source_plant_id, r.lof_consecutive) for r in own] == [("6", 1), ("8", 1), ("8", 2)]
    events = telemetry.restore_plants(strings.string_events(alerts)).collect()
    assert [(e.plant_id, e.model_plant_id, e.points) for e in events] == [("8", "6", 1)]


def test_fitted_threshold_is_the_quantile_of_normal_scores(spark):
    rng = random.Random(3)
    rows = [(s, 6, d, 50.0, {c: (rng.gauss(8, 0.3), rng.choice([1, 1, 1, 2])) for c in CHANNELS}) for s in range(15) for d in ("inv-3", "inv-9")]
    frame = fleet(spark, rows, statuses=True)
    fitted, report = strings.fit_string_threshold(frame, LofSettings(n_neighbors=3, minimum_strings=5, quantile=0.8))
    normal = [r.lof_score for r in strings.score_strings(frame, RULES).where("string_status = 1").collect()]
    assert fitted.threshold == pytest.approx(np.quantile(normal, 0.8))
    assert report["normal_calibration_samples"] == len(normal) and report["wide_samples"] == 30
    assert report["string_samples"] == 30 * len(CHANNELS) and report["score_maximum"] == pytest.approx(max(normal))
    assert LofSettings.from_json(fitted.to_json()) == fitted


def test_nothing_to_fit_and_nothing_to_score(spark):
    dark = fleet(spark, [(0, 6, "inv-3", 0.0, {c: 0.1 for c in CHANNELS})])
    with pytest.raises(ValueError, match="no normal string"):
        strings.fit_string_threshold(dark, RULES)
    assert strings.string_events(strings.apply_string_detector(dark, RULES)).count() == 0
    with pytest.raises(ValueError):
        LofSettings(quantile=0.2)
