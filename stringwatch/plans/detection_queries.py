"""The complete detector on the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stringwatch.config import MemorySettings
from stringwatch.plans.alarm_queries import alarm_events
from stringwatch.plans.detection import Calibration, DetectionSettings, calibrate, detect, detected_events
from stringwatch.plans.driver_views import device_table, epoch, weather_table
from stringwatch.plans.registry import query
from stringwatch.plans.residual_queries import HIERARCHY, PERSISTENT, SETTINGS, WEATHER
from stringwatch.storage import staging_path

DETECTION = DetectionSettings(
    residual=SETTINGS,
    hierarchy=HIERARCHY,
    persistent=PERSISTENT,
    memory=MemorySettings(entry_consecutive=2),
    weather=WEATHER,
    exclude_buffer_minutes=0,
)


@query("detected_events")
def complete_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrate without alarm windows, with weather, store the fit, then detect on all rows with the stored one.

    Every stage of it has a query of its own that is compared with SQL.
    """
    rows, weather = device_table(spark, sf_dir), weather_table(spark, sf_dir)
    alarms = alarm_events(spark, sf_dir)
    path = staging_path(spark, "calibration")
    calibrate(rows, alarms, weather, DETECTION, "UTC").save(path)
    fitted = Calibration.load(spark, path)
    events = detected_events(detect(rows, fitted, weather, DETECTION), DETECTION)
    return events.select(
        "plant_id", "device_no", "string_no", epoch("start_time", "start_epoch"), epoch("end_time", "end_epoch"),
        "points", "alert_points", "reactivated_points",
    )
