"""Parameters of the detectors, with their defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace
from typing import Any, TypeVar

T = TypeVar("T", bound="Settings")


@dataclass(frozen=True)
class Settings:
    """Base with JSON round trip and derivation of variants."""

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def from_json(cls: type[T], text: str) -> T:
        values: dict[str, Any] = json.loads(text)
        for item in fields(cls):
            if isinstance(values.get(item.name), list):
                values[item.name] = tuple(values[item.name])
        return cls(**values)

    def derive(self: T, **changes: Any) -> T:
        """A variant with changed fields; fitted thresholds stay as they are."""
        return replace(self, **changes)


def _check(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


@dataclass(frozen=True)
class LofSettings(Settings):
    """String detector on raw currents."""

    n_neighbors: int = 5
    quantile: float = 0.995
    threshold: float | None = None
    minimum_power_ratio: float = 0.10
    maximum_power_ratio: float = 1.10
    zero_current_threshold: float = 0.0
    minimum_relative_drop: float = 0.10
    minimum_strings: int = 6
    minimum_consecutive: int = 2
    interval_minutes: int = 5
    distance_floor: float = 0.01
    eligible_status_codes: tuple[int, ...] = (1, 4)

    def __post_init__(self) -> None:
        _check(self.n_neighbors >= 1, "n_neighbors must be positive")
        _check(self.minimum_strings >= 2, "minimum_strings must be at least two")
        _check(0 <= self.minimum_power_ratio < self.maximum_power_ratio, "power-ratio bounds are invalid")
        _check(self.distance_floor > 0, "distance_floor must be positive")
        _check(0.5 < self.quantile < 1, "quantile must be in (0.5, 1)")
        _check(0 <= self.minimum_relative_drop < 1, "minimum_relative_drop must be in [0, 1)")
        _check(self.minimum_consecutive >= 1 and self.interval_minutes >= 1, "persistence settings must be positive")


@dataclass(frozen=True)
class EwmaSettings(Settings):
    """Control chart on forecast residuals."""

    weight: float = 0.2
    quantile: float = 0.995
    threshold: float | None = None
    center: float | None = None
    scale: float | None = None
    minimum_power_ratio: float = 0.10
    maximum_power_ratio: float = 1.10
    minimum_consecutive: int = 2
    interval_minutes: int = 5

    def __post_init__(self) -> None:
        _check(0 < self.weight <= 1, "weight must be in (0, 1]")
        _check(0.5 < self.quantile < 1, "quantile must be in (0.5, 1)")
        _check(0 <= self.minimum_power_ratio < self.maximum_power_ratio, "power-ratio bounds are invalid")
        _check(self.minimum_consecutive >= 1 and self.interval_minutes >= 1, "persistence settings must be positive")


@dataclass(frozen=True)
class ResidualSettings(Settings):
    """String detector on residuals against peer irradiance.

    ``residual_quantile``, ``minimum_collective_gap`` and
    ``minimum_virtual_irradiance`` have no published default; these are ours.
    """

    version: str = "residual-base"
    n_neighbors: int = 5
    lof_quantile: float = 0.995
    residual_quantile: float = 0.005
    collective_gap_quantile: float = 0.995
    minimum_collective_gap: float = 0.05
    minimum_collective_strings: int = 2
    maximum_collective_fraction: float = 0.50
    collective_overlap_threshold: float = 0.50
    minimum_isolated_relative_drop: float = 0.0
    minimum_isolated_absolute_drop: float = 0.0
    gate_mode: str = "and"
    minimum_peer_devices: int = 5
    minimum_strings: int = 4
    minimum_consecutive: int = 2
    interval_minutes: int = 5
    zero_current_threshold: float = 0.0
    minimum_virtual_irradiance: float = 0.02
    distance_floor: float = 0.01
    lof_threshold: float | None = None
    residual_threshold: float | None = None
    gap_threshold: float | None = None

    def __post_init__(self) -> None:
        _check(0 <= self.minimum_isolated_relative_drop < 1, "relative drop must be in [0, 1)")
        _check(self.minimum_isolated_absolute_drop >= 0, "absolute drop must be non-negative")
        _check(self.gate_mode in ("and", "or"), "gate_mode is 'and' or 'or'")
        _check(self.minimum_consecutive >= 1 and self.interval_minutes >= 1, "persistence settings must be positive")


@dataclass(frozen=True)
class HierarchySettings(Settings):
    """Minima and shrinkage of context thresholds."""

    quantile: float = 0.995
    minimum_device_samples: int = 10_000
    minimum_device_days: int = 20
    minimum_plant_count_samples: int = 20_000
    minimum_plant_count_days: int = 20
    minimum_count_samples: int = 20_000
    minimum_count_days: int = 20
    shrinkage_k: float = 5_000.0
    minimum_consecutive: int = 3
    interval_minutes: int = 5
    timezone: str = "Asia/Shanghai"
    version: str = "hierarchy"


@dataclass(frozen=True)
class PersistentSettings(Settings):
    """Persistent mild group deficit."""

    deficit_quantile: float = 0.995
    minimum_deficit: float = 0.03
    minimum_group_strings: int = 2
    maximum_group_fraction: float = 0.50
    minimum_upper_strings: int = 1
    membership_overlap_threshold: float = 0.67
    minimum_consecutive: int = 6
    robust_mad_multiplier: float = 6.0
    minimum_device_samples: int = 500
    minimum_device_days: int = 10
    minimum_plant_count_samples: int = 2_000
    minimum_plant_count_days: int = 10
    minimum_count_samples: int = 2_000
    minimum_count_days: int = 10
    shrinkage_k: float = 500.0
    interval_minutes: int = 5
    timezone: str = "Asia/Shanghai"

    def hierarchy(self) -> HierarchySettings:
        return HierarchySettings(
            quantile=self.deficit_quantile,
            minimum_device_samples=self.minimum_device_samples,
            minimum_device_days=self.minimum_device_days,
            minimum_plant_count_samples=self.minimum_plant_count_samples,
            minimum_plant_count_days=self.minimum_plant_count_days,
            minimum_count_samples=self.minimum_count_samples,
            minimum_count_days=self.minimum_count_days,
            shrinkage_k=self.shrinkage_k,
            interval_minutes=self.interval_minutes,
            timezone=self.timezone,
        )


@dataclass(frozen=True)
class MemorySettings(Settings):
    """Confirmed-anomaly memory."""

    entry_consecutive: int = 3
    clear_consecutive: int = 3
    interval_minutes: int = 5


@dataclass(frozen=True)
class WeatherSettings(Settings):
    """Conditioning of peer irradiance with forecast irradiance."""

    candidate_offsets_minutes: tuple[int, ...] = (0,)
    tolerance_minutes: int = 15
    minimum_mapping_samples: int = 100
    mapping_bins: int = 20
    maximum_correction: float = 0.20
    minimum_peer_weight: float = 0.65
    maximum_peer_weight: float = 0.85


def derive_persistence(
    base: ResidualSettings,
    hierarchy: HierarchySettings,
    minimum_consecutive: int,
    base_version: str,
    hierarchy_version: str,
) -> tuple[ResidualSettings, HierarchySettings]:
    """Change only the number of confirming points of both calibrations."""
    _check(minimum_consecutive >= 2, "minimum_consecutive must be at least 2")
    _check(base.interval_minutes == hierarchy.interval_minutes, "base and hierarchical intervals do not match")
    return (
        base.derive(version=base_version, minimum_consecutive=minimum_consecutive),
        hierarchy.derive(version=hierarchy_version, minimum_consecutive=minimum_consecutive),
    )
