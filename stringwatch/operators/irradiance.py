"""Virtual irradiance from peer devices, optionally conditioned with a forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stringwatch.config import ResidualSettings, WeatherSettings
from stringwatch.functions.arrays import median
from stringwatch.functions.isotonic import isotonic
from stringwatch.functions.timegrid import shift_minutes
from stringwatch.operators.asof import asof_join
from stringwatch.operators.channels import inventory_by_device, readings
from stringwatch.operators.quantiles import average_ranks, bounded_quantile, quantiles, quantiles_of_columns
from stringwatch.schema import DEVICE_KEYS, key_text, require_columns
from stringwatch.storage import stage

SCALE_QUANTILE = 0.95


def peer_source(frame: DataFrame, settings: ResidualSettings, inventory: DataFrame | None = None) -> DataFrame:
    """Device rows with their configured strings and representative current.

    The representative is the median of positive configured currents. Without an
    inventory every channel with a finite current counts as configured.
    """
    require_columns(frame, (*DEVICE_KEYS, "event_time"), "device table")
    rows = frame.withColumns({"plant_id": key_text("plant_id"), "device_no": key_text("device_no")})
    strings = readings(rows)
    if inventory is not None:
        rows = rows.join(inventory_by_device(inventory), list(DEVICE_KEYS), "left")
        strings = F.filter(
            strings,
            lambda s: F.coalesce(F.array_contains("configured_strings", s["string_no"]), F.lit(False)),
        )
    strings = F.filter(strings, lambda s: s["current"].isNotNull())
    zero = F.lit(float(settings.zero_current_threshold))
    return rows.select(
        *DEVICE_KEYS,
        "event_time",
        F.transform(
            strings, lambda s: F.struct(s["string_no"].alias("string_no"), s["current"].alias("current"))
        ).alias("strings"),
    ).withColumn(
        "representative",
        median(F.transform(F.filter("strings", lambda s: s["current"] > zero), lambda s: s["current"])),
    )


def fit_device_scale(source: DataFrame) -> DataFrame:
    """95 % quantile of each device's representative current."""
    return bounded_quantile(source, DEVICE_KEYS, "representative", SCALE_QUANTILE, "device_scale").drop("n")


def leave_one_out_median(
    frame: DataFrame, group: Sequence[str], member: str, value: str, name: str, count: str
) -> DataFrame:
    """Median of the other members' values and how many there are.

    Dropping one of n sorted values moves the median by at most one place, so
    three middle values of the group serve every member; no list is built.
    """
    everyone = Window.partitionBy(*group)
    result = frame.withColumn(
        "_rank", F.when(F.col(value).isNotNull(), F.row_number().over(everyone.orderBy(F.col(value).asc_nulls_last(), member)) - 1)
    ).withColumn("_n", F.count(value).over(everyone))
    result = result.withColumn("_middle", F.floor(F.greatest(F.col("_n") - 2, F.lit(0)) / 2))
    result = result.withColumns(
        {
            f"_v{i}": F.max(F.when(F.col("_rank") == F.col("_middle") + i, F.col(value))).over(everyone)
            for i in range(3)
        }
    )
    others = F.col("_n") - F.col("_rank").isNotNull().cast("int")

    def pick(position: Column) -> Column:
        shifted = position + F.coalesce((position >= F.col("_rank")).cast("int"), F.lit(0)) - F.col("_middle")
        return F.when(shifted == 0, F.col("_v0")).when(shifted == 1, F.col("_v1")).when(shifted == 2, F.col("_v2"))

    middle = (pick(F.floor((others - 1) / 2)) + pick(F.floor(others / 2))) / 2
    return result.withColumn(name, F.when(others > 0, middle)).withColumn(count, others.cast("int")).drop(
        "_rank", "_n", "_middle", "_v0", "_v1", "_v2"
    )


def peer_irradiance(source: DataFrame, scales: DataFrame, settings: ResidualSettings) -> DataFrame:
    """Median normalised output of the other devices of the plant.

    Null when fewer than ``minimum_peer_devices`` others report.
    """
    scaled = source.join(scales, list(DEVICE_KEYS), "left").withColumn(
        "device_level", F.when(F.col("device_scale") > 0, F.col("representative") / F.col("device_scale"))
    )
    result = leave_one_out_median(
        scaled, ("plant_id", "event_time"), "device_no", "device_level", "_peer", "peer_count"
    )
    return result.withColumn(
        "raw_virtual_irradiance", F.when(F.col("peer_count") >= settings.minimum_peer_devices, F.col("_peer"))
    ).drop("_peer", "device_level", "device_scale")


# --- forecast conditioning -------------------------------------------------


def attach_forecast(context: DataFrame, weather: DataFrame, settings: WeatherSettings, offset: Column | int) -> DataFrame:
    """Latest forecast slot at or before the device time, slots shifted back by ``offset``."""
    slots = weather.select(
        key_text("plant_id").alias("plant_id"),
        shift_minutes(F.col("time"), -offset if isinstance(offset, Column) else F.lit(-offset)).alias("slot_time"),
        F.col("forecast_ghi").cast("double").alias("forecast_ghi"),
    ).where(F.col("forecast_ghi").isNotNull() & ~F.isnan("forecast_ghi"))
    return asof_join(
        context, slots, ["plant_id"], "event_time", "slot_time", ["forecast_ghi"], settings.tolerance_minutes
    ).drop("matched_slot_time")


def spearman(frame: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """Rank correlation per group with the number of pairs."""
    pairs = frame.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    left_ranks = average_ranks(pairs, keys, left, "_rank_left")
    right_ranks = average_ranks(pairs, keys, right, "_rank_right")
    return (
        pairs.groupBy(*keys, left, right)
        .agg(F.count(F.lit(1)).alias("_pairs"))
        .join(left_ranks, [*keys, left])
        .join(right_ranks, [*keys, right])
        .groupBy(*keys)
        .agg(*_weighted_correlation("_rank_left", "_rank_right", "_pairs"))
        .select(*keys, "samples", _correlation_value().alias("spearman"))
    )


def _weighted_correlation(x: str, y: str, weight: str) -> list[Column]:
    w, a, b = F.col(weight), F.col(x), F.col(y)
    return [
        F.sum(w).alias("samples"),
        F.sum(w * a).alias("_a"),
        F.sum(w * b).alias("_b"),
        F.sum(w * a * b).alias("_ab"),
        F.sum(w * a * a).alias("_aa"),
        F.sum(w * b * b).alias("_bb"),
    ]


def _correlation_value() -> Column:
    n = F.col("samples")
    covariance = F.col("_ab") - F.col("_a") * F.col("_b") / n
    spread = (F.col("_aa") - F.col("_a") * F.col("_a") / n) * (F.col("_bb") - F.col("_b") * F.col("_b") / n)
    return F.when(spread > 0, covariance / F.sqrt(spread))


def weather_pairs(context: DataFrame, weather: DataFrame, settings: WeatherSettings) -> DataFrame:
    """Forecast and peer irradiance of every device time, for each candidate offset."""
    candidates = [
        attach_forecast(context, weather, settings, offset)
        .where(F.col("raw_virtual_irradiance").isNotNull() & F.col("forecast_ghi").isNotNull())
        .select("plant_id", "forecast_ghi", "raw_virtual_irradiance", F.lit(offset).alias("source_offset_minutes"))
        for offset in settings.candidate_offsets_minutes
    ]
    pairs = candidates[0]
    for more in candidates[1:]:
        pairs = pairs.unionByName(more)
    return stage(pairs, "weather-pairs")


def offset_correlations(pairs: DataFrame) -> DataFrame:
    """Samples and rank correlation of every plant and offset."""
    return spearman(pairs, ["plant_id", "source_offset_minutes"], "forecast_ghi", "raw_virtual_irradiance")


def fit_weather_map(context: DataFrame, weather: DataFrame, settings: WeatherSettings) -> DataFrame:
    """Per plant: time offset and monotone forecast-to-irradiance anchors.

    The offset with the higher rank correlation to peer irradiance wins, the
    smaller one on a tie. Anchors are medians in forecast-quantile bins, with an
    isotonic fit weighted by the rows of the bins. Plants below the sample
    minimum are left out.
    """
    pairs = weather_pairs(context, weather, settings)
    best = (
        offset_correlations(pairs)
        .where(F.col("samples") >= settings.minimum_mapping_samples)
        .groupBy("plant_id")
        .agg(
            F.max_by(
                F.struct("source_offset_minutes", "samples", "spearman"),
                F.struct(F.coalesce("spearman", F.lit(-2.0)), -F.col("source_offset_minutes")),
            ).alias("best")
        )
        .select("plant_id", "best.*")
    )
    best = stage(best, "weather-offsets")
    chosen = stage(pairs.join(best.select("plant_id", "source_offset_minutes"), ["plant_id", "source_offset_minutes"]), "weather-chosen")
    edges = quantiles(
        chosen, ["plant_id"], "forecast_ghi", [i / settings.mapping_bins for i in range(1, settings.mapping_bins)]
    ).select("plant_id", F.array_distinct("q").alias("_edges"))
    binned = stage(
        chosen.join(edges, "plant_id").select(
            "plant_id",
            F.size(F.filter("_edges", lambda e: e < F.col("forecast_ghi"))).alias("bin"),
            "forecast_ghi",
            "raw_virtual_irradiance",
        ),
        "weather-bins",
    )
    medians = (
        quantiles_of_columns(binned, ["plant_id", "bin"], ["forecast_ghi", "raw_virtual_irradiance"], [0.5])
        .groupBy("plant_id", "bin")
        .agg(
            F.max(F.when(F.col("column") == "forecast_ghi", F.get("q", 0))).alias("anchor_ghi"),
            F.max(F.when(F.col("column") != "forecast_ghi", F.get("q", 0))).alias("value"),
            F.max(F.when(F.col("column") != "forecast_ghi", F.col("n"))).alias("weight"),
        )
    )
    # one entry per bin, so the list is as long as the number of bins
    listed = medians.groupBy("plant_id").agg(F.sort_array(F.collect_list(F.struct("anchor_ghi", "value", "weight"))).alias("_bins"))
    anchors = F.transform(
        F.arrays_zip("_bins", isotonic(F.col("_bins")).alias("_fit")),
        lambda z: F.struct(z["_bins"]["anchor_ghi"].alias("anchor_ghi"), z["_fit"].alias("anchor_g")),
    )
    return best.join(listed.select("plant_id", anchors.alias("anchors")), "plant_id")


def interpolate(value: Column, anchors: Column) -> Column:
    """Piecewise linear through (anchor_ghi, anchor_g), flat outside."""
    below = F.size(F.filter(anchors, lambda a: a["anchor_ghi"] <= value))
    low, high = F.get(anchors, below - 1), F.get(anchors, below)
    width = high["anchor_ghi"] - low["anchor_ghi"]
    sloped = low["anchor_g"] + (high["anchor_g"] - low["anchor_g"]) * (value - low["anchor_ghi"]) / width
    return (
        F.when(value.isNull() | (F.size(anchors) <= 0), None)
        .when(below == 0, high["anchor_g"])
        .when(below == F.size(anchors), low["anchor_g"])
        .otherwise(sloped)
    )


def condition_context(
    context: DataFrame,
    weather: DataFrame,
    weather_map: DataFrame,
    base: ResidualSettings,
    settings: WeatherSettings = WeatherSettings(),
) -> DataFrame:
    """Blend peer irradiance with the mapped forecast, within bounds.

    Peers only: peers. Forecast only: mapped forecast. Both: the forecast is
    clipped around the peers and weighted less the more peers report.
    """
    offsets = weather_map.select("plant_id", "source_offset_minutes")
    shifted = (
        weather.withColumn("plant_id", key_text("plant_id"))
        .join(offsets, "plant_id")
        .withColumn("time", shift_minutes(F.col("time"), -F.col("source_offset_minutes")))
    )
    rows = attach_forecast(context, shifted, settings, 0).join(
        weather_map.select("plant_id", "anchors"), "plant_id", "left"
    )
    peer, forecast, n = F.col("raw_virtual_irradiance"), F.col("forecast_irradiance"), F.col("peer_count")
    bound = settings.maximum_correction
    clipped = F.least(F.greatest(forecast, peer * (1 - bound)), peer * (1 + bound))
    span = settings.maximum_peer_weight - settings.minimum_peer_weight
    extra = (n - base.minimum_peer_devices) / F.lit(float(base.minimum_peer_devices))
    weight = F.least(
        F.greatest(settings.minimum_peer_weight + span * extra, F.lit(settings.minimum_peer_weight)),
        F.lit(settings.maximum_peer_weight),
    )
    return (
        rows.withColumn("forecast_irradiance", interpolate(F.col("forecast_ghi"), F.col("anchors")))
        .drop("anchors")
        .withColumn("forecast_available", forecast.isNotNull())
        .withColumn(
            "conditioned_virtual_irradiance",
            F.when(peer.isNotNull() & forecast.isNotNull(), weight * peer + (1 - weight) * clipped).otherwise(
                F.coalesce(peer, forecast)
            ),
        )
        .withColumn(
            "conditioned_peer_count",
            F.when(
                peer.isNull() & forecast.isNotNull(), F.greatest(n, F.lit(base.minimum_peer_devices))
            ).otherwise(n),
        )
    )
