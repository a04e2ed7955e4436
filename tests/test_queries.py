"""Registered queries against their SQL on the smallest tables."""

import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as driver  # noqa: E402
from compare import compare, connect  # noqa: E402

SMALLEST = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not pathlib.Path(SMALLEST).exists(), reason="no test tables")

SAMPLE = [
    "string_events",
    "ewma_scores",
    "residual_alerts",
    "hierarchical_thresholds",
    "confirmed_memory",
    "weather_map",
    "alarm_classification",
    "event_metrics",
    "version_comparison_events",
    "event_continuity",
    "training_quality",
    "numbered_events",
]


@pytest.fixture(scope="module")
def checker():
    return connect(SMALLEST)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, checker, name):
    same, text = compare(spark, checker, name, SMALLEST)
    assert same, text


def test_registry_is_consistent():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert len(driver.queries()) > 100


def test_entry_and_complete_detection(spark):
    assert driver.entry(spark).columns[:3] == ["plant_id", "device_no", "string_no"]
    events = driver.queries()["detected_events"](spark, SMALLEST).orderBy("plant_id", "device_no", "string_no", "start_epoch").collect()
    assert events
    for event in events:
        assert event.end_epoch - event.start_epoch == 300 * (event.points - 1)
        assert 0 < event.alert_points <= event.points and 0 <= event.reactivated_points <= event.points
    for one, two in zip(events, events[1:]):
        if one[:3] == two[:3]:  # events of a string neither touch nor overlap
            assert two.start_epoch > one.end_epoch + 300


def test_power_model_is_about_as_good_as_the_mean(spark):
    """The derived targets have no trend, so a sound fit is close to the mean of all rows; a broken one is not."""
    rows = driver.queries()["power_model_predictions"](spark, SMALLEST).collect()
    assert rows and all(r.predicted_power == r.predicted_power for r in rows)
    mean = sum(r.target_active_power for r in rows) / len(rows)
    squared = sum((r.target_active_power - r.predicted_power) ** 2 for r in rows)
    assert squared <= 1.15 * sum((r.target_active_power - mean) ** 2 for r in rows)


def test_shuffles_of_queries_start_finely(spark):
    from stringwatch.plans.driver_views import device_table
    from stringwatch.session import FINE_PARTITIONS, INITIAL_PARTITIONS

    kept = spark.conf.get(INITIAL_PARTITIONS, None)
    spark.conf.unset(INITIAL_PARTITIONS)
    rows = device_table(spark, "/root/testdata/sf0.001")
    assert rows._jdf.queryExecution().toString().count(f", {FINE_PARTITIONS})") > 0
    spark.conf.set(INITIAL_PARTITIONS, "7")
    device_table(spark, "/root/testdata/sf0.001")
    assert spark.conf.get(INITIAL_PARTITIONS) == "7"
    spark.conf.unset(INITIAL_PARTITIONS)
    if kept is not None:
        spark.conf.set(INITIAL_PARTITIONS, kept)
