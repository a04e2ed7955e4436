"""The complete detector: calibration on history, detection on new rows."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringwatch.config import (
    HierarchySettings,
    MemorySettings,
    PersistentSettings,
    ResidualSettings,
    WeatherSettings,
)
from stringwatch.operators import channels, intervals, irradiance, memory, persistent, residuals, thresholds
from stringwatch.sources import sinks
from stringwatch.storage import stage

# fixed values: the either-or gate of 20 % or 0.5 A
EITHER_GATE = {
    "minimum_isolated_relative_drop": 0.20,
    "minimum_isolated_absolute_drop": 0.5,
    "gate_mode": "or",
}


@dataclass(frozen=True)
class DetectionSettings:
    residual: ResidualSettings = field(default_factory=lambda: ResidualSettings(**EITHER_GATE, minimum_consecutive=3))
    hierarchy: HierarchySettings = field(default_factory=HierarchySettings)
    persistent: PersistentSettings = field(default_factory=PersistentSettings)
    memory: MemorySettings = field(default_factory=MemorySettings)
    weather: WeatherSettings = field(default_factory=WeatherSettings)
    exclude_buffer_minutes: int = 10


@dataclass(frozen=True)
class Calibration:
    """Everything detection needs: tables and settings."""

    inventory: DataFrame
    model: residuals.ResidualModel
    weather_map: DataFrame | None
    hierarchy: thresholds.ContextThresholds
    persistent: persistent.PersistentModel

    def save(self, path: str) -> None:
        """One folder per table and setting below ``path``, for use in another process."""
        spark = self.inventory.sparkSession
        sinks.save_model(spark, f"{path}/residual", self.model.settings, {"scales": self.model.scales, "responses": self.model.responses})
        sinks.save_model(spark, f"{path}/persistent", self.persistent.settings)
        tables = {"inventory": self.inventory, "weather-map": self.weather_map}
        ladders = {"hierarchy": self.hierarchy, "groups": self.persistent.thresholds}
        for name, ladder in ladders.items():
            for level in fields(ladder):
                value = getattr(ladder, level.name)
                if isinstance(value, DataFrame):
                    tables[f"{name}/{level.name}"] = value
                else:
                    tables[f"{name}/{level.name}"] = spark.createDataFrame([(value,)], "value double")
        for name, table in tables.items():
            if table is not None:
                table.write.mode("errorifexists").parquet(f"{path}/{name}")
        written = spark.createDataFrame([(name,) for name, table in tables.items() if table is not None], "name string")
        written.coalesce(1).write.json(f"{path}/tables")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Calibration:
        names = {row["name"] for row in spark.read.schema("name string").json(f"{path}/tables").collect()}

        def ladder(name: str) -> thresholds.ContextThresholds:
            values = {}
            for level in fields(thresholds.ContextThresholds):
                table = sinks.load_table(spark, f"{path}/{name}", level.name)
                values[level.name] = table.first()["value"] if table.columns == ["value"] else table
            return thresholds.ContextThresholds(**values)

        residual = f"{path}/residual"
        model = residuals.ResidualModel(
            sinks.load_settings(spark, residual, ResidualSettings),
            sinks.load_table(spark, residual, "scales"),
            sinks.load_table(spark, residual, "responses"),
        )
        return cls(
            sinks.load_table(spark, path, "inventory"),
            model,
            sinks.load_table(spark, path, "weather-map") if "weather-map" in names else None,
            ladder("hierarchy"),
            persistent.PersistentModel(sinks.load_settings(spark, f"{path}/persistent", PersistentSettings), ladder("groups")),
        )


def _context(
    frame: DataFrame,
    model: residuals.ResidualModel,
    inventory: DataFrame,
    weather: DataFrame | None,
    weather_map: DataFrame | None,
    settings: DetectionSettings,
) -> DataFrame:
    context = model.context(frame, inventory)
    if weather is None or weather_map is None:
        return context
    return residuals.with_irradiance(
        irradiance.condition_context(context, weather, weather_map, model.settings, settings.weather)
    )


def calibrate(
    history: DataFrame,
    alarms: DataFrame | None = None,
    weather: DataFrame | None = None,
    settings: DetectionSettings = DetectionSettings(),
    timezone: str = "Asia/Shanghai",
) -> Calibration:
    """Fit all stages on history without known alarm windows.

    ``alarms`` has plant_id, device_no, raise_time and end_time. With weather the
    responses and thresholds are refitted on the conditioned irradiance.
    """
    history = stage(history, "history")
    inventory = stage(channels.channel_inventory(history, timezone=timezone), "inventory")
    if alarms is not None:
        history = stage(
            intervals.exclude_windows(
                history, alarms, start="raise_time", end="end_time", buffer_minutes=settings.exclude_buffer_minutes
            ),
            "history-without-alarms",
        )
    model = residuals.fit_residual_model(history, settings.residual, inventory)
    weather_map = None
    if weather is not None:
        context = stage(model.context(history, inventory), "peer-context")
        weather_map = stage(irradiance.fit_weather_map(context, weather, settings.weather), "weather-map")
        conditioned = irradiance.condition_context(context, weather, weather_map, model.settings, settings.weather)
        model = residuals.fit_residual_model(
            history, settings.residual, inventory, context=conditioned, scales=model.scales
        )
    context = _context(history, model, inventory, weather, weather_map, settings)
    scored = stage(model.score(context), "scored-history")
    hierarchy = thresholds.fit_hierarchy(scored, model.settings, settings.hierarchy)
    groups, _ = persistent.fit_persistent(scored, settings.persistent)
    return Calibration(inventory, model, weather_map, hierarchy, groups)


def detect(
    frame: DataFrame,
    calibration: Calibration,
    weather: DataFrame | None = None,
    settings: DetectionSettings = DetectionSettings(),
) -> DataFrame:
    """Point results: both branches, strict and persistent alerts, memory, final alert."""
    model = calibration.model
    context = _context(frame, model, calibration.inventory, weather, calibration.weather_map, settings)
    points = stage(model.score(context), "scored-points")
    points = residuals.add_persistence(points, model.settings)
    points = thresholds.add_strict_alerts(points, model.settings, calibration.hierarchy, settings.hierarchy)
    points = persistent.apply_persistent(points, calibration.persistent)
    return memory.add_memory(
        points,
        F.col("hier_raw_alert") == 1,
        F.col("residual_ratio").isNotNull() & (F.col("string_current") > 0),
        settings.memory,
        strict_column="combined_alert",
    )


def detected_events(points: DataFrame, settings: DetectionSettings = DetectionSettings()) -> DataFrame:
    """Confirmed events; candidates that were never confirmed are left out."""
    return memory.reconstruct_events(points, settings.memory).where("confirmed = 1")


def unconfirmed_candidates(points: DataFrame, settings: DetectionSettings = DetectionSettings()) -> DataFrame:
    return memory.reconstruct_events(points, settings.memory).where("confirmed = 0")
