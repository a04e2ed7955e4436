"""EWMA chart: eligibility, alerts and equality with the recursion."""

import datetime as dt
import random

import pytest

from stringwatch.config import EwmaSettings
from stringwatch.operators import ewma

MIDNIGHT = dt.datetime(2026, 5, 20)


def residuals(spark, values, minutes=None, share=0.6, device="inv-4"):
    """Forecasts that exceed the output of a 250 kW inverter by ``values`` of its rating."""
    minutes = minutes or range(0, 5 * len(values), 5)
    rows = [
        (MIDNIGHT + dt.timedelta(minutes=m), device, 250.0, 250.0 * share, 250.0 * (share + v), share)
        for m, v in zip(minutes, values)
    ]
    return spark.createDataFrame(rows, list(ewma.RESIDUAL_COLUMNS))


def test_only_plausible_output_counts(spark):
    frames = [residuals(spark, [0.25, -0.04], share=s, device=f"inv-{s}") for s in (0.02, 0.1, 1.1, 1.2)]
    rows = ewma.prepare_residuals(frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])).collect()
    assert {r.device_no: r.ewma_eligible for r in rows} == {"inv-0.02": False, "inv-0.1": True, "inv-1.1": True, "inv-1.2": False}
    assert sorted(r.underproduction_residual for r in rows) == pytest.approx([-0.04] * 4 + [0.25] * 4)


def test_alert_needs_neighbouring_exceedances(spark):
    settings = EwmaSettings(weight=1.0, center=0.0, scale=1.0, threshold=0.5)
    # one alone, two in a row, two with a hole between them
    values, minutes = [0.9, 0.1, 0.8, 0.7, 0.2, 0.9, 0.9], [0, 5, 10, 15, 20, 25, 35]
    rows = ewma.apply_ewma(residuals(spark, values, minutes), settings).orderBy("target_time").collect()
    assert [r.ewma_raw_alert for r in rows] == [1, 0, 1, 1, 0, 1, 1]
    assert [r.ewma_alert for r in rows] == [0, 0, 0, 1, 0, 0, 0]


def test_nothing_to_fit(spark):
    with pytest.raises(ValueError, match="no residual"):
        ewma.fit_ewma(residuals(spark, [0.3, 0.1], share=0.0))


@pytest.mark.parametrize("weight", [0.2, 0.9, 1.0])
def test_closed_form_equals_recursion(spark, weight):
    rng = random.Random(11)
    minutes, now = [], 0
    for i in range(4000):
        now += 10 if rng.random() < 0.001 else 5
        minutes.append(now)
    values = [rng.gauss(0, 0.1) for _ in minutes]
    settings = EwmaSettings(weight=weight, center=0.01, scale=0.05)
    frame = ewma.prepare_residuals(residuals(spark, values, minutes))
    got = [r.ewma_score for r in ewma.ewma_scores(frame, settings).orderBy("target_time").collect()]
    state, previous, expected = 0.0, None, []
    for m, v in zip(minutes, values):
        if previous is None or m - previous != 5:
            state = 0.0
        state = weight * (v - 0.01) / 0.05 + (1 - weight) * state
        expected.append(state)
        previous = m
    assert got == pytest.approx(expected, abs=1e-9)
