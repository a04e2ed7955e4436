"""String detector on residuals: response, expected current, isolated and group branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stringwatch.config import ResidualSettings
from stringwatch.functions.arrays import let, median
from stringwatch.functions.gaps import largest_gap
from stringwatch.functions.gates import absolute_drop, effect_gate, relative_drop
from stringwatch.functions.lof import lof_scores
from stringwatch.operators import runs
from stringwatch.operators.irradiance import fit_device_scale, peer_irradiance, peer_source
from stringwatch.operators.quantiles import bounded_quantile, quantiles, quantiles_of_columns
from stringwatch.schema import DEVICE_KEYS, POINT_KEYS, STRING_KEYS
from stringwatch.storage import stage

IRRADIANCE = "virtual_irradiance"


def fit_responses(context: DataFrame, settings: ResidualSettings) -> DataFrame:
    """Median current per unit irradiance of every string."""
    zero = F.lit(float(settings.zero_current_threshold))
    usable = context.where(F.col(IRRADIANCE) >= settings.minimum_virtual_irradiance)
    long = usable.select(
        *DEVICE_KEYS,
        F.col(IRRADIANCE).alias("_g"),
        F.inline(F.filter("strings", lambda s: s["current"] > zero)),
    ).select(*STRING_KEYS, (F.col("current") / F.col("_g")).alias("_ratio"))
    return bounded_quantile(long, STRING_KEYS, "_ratio", 0.5, "response").drop("n")


def responses_by_device(responses: DataFrame) -> DataFrame:
    """One map string -> response per device; no larger than its channels."""
    return responses.groupBy(*DEVICE_KEYS).agg(
        F.map_from_entries(F.collect_list(F.struct("string_no", "response"))).alias("responses")
    )


def score_residuals(context: DataFrame, responses: DataFrame, settings: ResidualSettings) -> DataFrame:
    """Residuals, their LOF scores and the largest-gap group of every device-time.

    The device row is the peer group, so after the per-device responses are
    joined everything is computed inside the row and exploded last.
    """
    zero = F.lit(float(settings.zero_current_threshold))
    g = F.col(IRRADIANCE)
    needed = max(settings.minimum_strings, settings.n_neighbors + 1)
    rows = context.join(responses_by_device(responses), list(DEVICE_KEYS), "left")
    usable = g >= settings.minimum_virtual_irradiance

    def with_residual(string: Column) -> Column:
        response = F.try_element_at("responses", string["string_no"])
        return let(
            F.when(usable & (response > 0), response * g),
            lambda expected: F.struct(
                string["string_no"].alias("string_no"),
                string["current"].alias("current"),
                response.isNotNull().alias("response_known"),
                expected.alias("expected"),
                F.when(expected > 0, string["current"] / expected).alias("r"),
            ),
        )

    rows = rows.withColumn("_strings", F.transform("strings", with_residual)).withColumn(
        "_valid", F.filter("_strings", lambda s: s["r"].isNotNull() & (s["current"] > zero))
    )
    ratios = F.transform("_valid", lambda s: s["r"])
    enough = F.size("_valid") >= needed
    rows = rows.withColumns(
        {
            "available_strings": F.size("_valid"),
            "residual_median": F.when(F.size("_valid") > 0, median(ratios)),
            "_scores": F.when(enough, lof_scores(ratios, settings.n_neighbors, settings.distance_floor)),
            "_group": F.when(
                F.size("_valid") >= settings.minimum_strings,
                largest_gap(
                    F.transform("_valid", lambda s: F.struct(s["r"], s["string_no"])),
                    settings.minimum_collective_strings,
                    settings.maximum_collective_fraction,
                ),
            ),
        }
    ).withColumn("_numbers", F.transform("_valid", lambda s: s["string_no"]))

    def output(string: Column) -> Column:
        # zero when the string is not among the scored ones
        place = F.array_position("_numbers", string["string_no"]).cast("int")
        return F.struct(
            string["string_no"].alias("string_no"),
            string["current"].alias("string_current"),
            string["response_known"].alias("response_known"),
            string["expected"].alias("expected_current"),
            string["r"].alias("residual_ratio"),
            F.get("_scores", place - 1).alias("lof_score"),
            (string["current"] <= zero).cast("int").alias("zero_current_alert"),
            F.coalesce(F.array_contains("_group.members", string["string_no"]), F.lit(False)).alias(
                "collective_group_member"
            ),
        )

    return rows.select(
        *POINT_KEYS,
        IRRADIANCE,
        "peer_count",
        "available_strings",
        "residual_median",
        F.col("_group.gap").alias("collective_gap"),
        F.coalesce("_group.size", F.lit(0)).alias("collective_group_size"),
        F.col("_group.median").alias("collective_group_median"),
        F.inline(F.transform("_strings", output)),
    ).withColumn("lof_eligible", F.col("lof_score").isNotNull())


def with_drops(scored: DataFrame, settings: ResidualSettings) -> DataFrame:
    """Relative and absolute drop and whether they pass the gate."""
    relative = relative_drop(F.col("residual_ratio"), F.col("residual_median"))
    absolute = absolute_drop(F.col("expected_current"), F.col("string_current"))
    gate = effect_gate(
        settings.gate_mode,
        F.col("isolated_relative_drop"),
        F.col("isolated_absolute_drop"),
        settings.minimum_isolated_relative_drop,
        settings.minimum_isolated_absolute_drop,
    )
    return (
        scored.withColumn("isolated_relative_drop", relative)
        .withColumn("isolated_absolute_drop", absolute)
        .withColumn("isolated_effect_eligible", gate.cast("int"))
    )


def add_raw_alerts(scored: DataFrame, settings: ResidualSettings) -> DataFrame:
    """Raw candidates of the isolated and of the group branch."""
    zero = float(settings.zero_current_threshold)
    positive = F.col("string_current") > zero
    isolated = (
        F.col("lof_eligible")
        & F.col("response_known")
        & positive
        & (F.col("lof_score") >= settings.lof_threshold)
        & (F.col("residual_ratio") < F.col("residual_median"))
        & (F.col("isolated_effect_eligible") == 1)
    )
    group = (
        F.col("collective_group_member")
        & positive
        & (F.col("collective_gap") >= settings.gap_threshold)
        & (F.col("collective_group_median") <= settings.residual_threshold)
    )
    result = with_drops(scored, settings)
    flag = F.coalesce(isolated, F.lit(False)).cast("int")
    return result.withColumns(
        {
            "isolated_raw_alert": flag,
            "isolated_directional_raw_alert": flag,
            "collective_raw_alert": F.coalesce(group, F.lit(False)).cast("int"),
        }
    )


def group_continuity(
    points: DataFrame, member: Column, minimum_strings: int, overlap: float, line: runs.Timeline, prefix: str
) -> DataFrame:
    """Per device-time: overlap of its members with the previous set, and streak."""
    flag = F.coalesce(member, F.lit(False))
    groups = points.groupBy(*POINT_KEYS).agg(*[F.bit_or(string_bit(F.col("string_no"), flag, i)).alias(f"_w{i}") for i in (0, 1)])
    return continuity_of_sets(groups.withColumn("_group", F.bit_count("_w0") + F.bit_count("_w1") >= minimum_strings), overlap, line, prefix)


def _overlap_of_sets(previous: str) -> Column:
    """Members in both sets over members in one of them."""

    def count(join: str) -> Column:
        return sum((F.bit_count(getattr(F.col(f"_w{i}"), join)(F.col(f"{previous}_w{i}"))) for i in (0, 1)), F.lit(0))

    return count("bitwiseAND") / count("bitwiseOR")


def continuity_of_sets(groups: DataFrame, overlap: float, line: runs.Timeline, prefix: str) -> DataFrame:
    """Overlap and streak of device-times whose members are bits in ``_w0`` and ``_w1``; ``_group`` tells which are groups.

    A group continues when the previous device-time lies one interval back, had
    a group, and the member sets overlap enough.
    """
    columns = {"_previous_time": F.col(line.time), "_previous_w0": F.col("_w0"), "_previous_w1": F.col("_w1"), "_previous_group": F.col("_group")}
    groups = runs.with_previous(groups, line, columns)
    connected = F.col("_group") & runs.follows(line) & F.coalesce(F.col("_previous_group"), F.lit(False))
    groups = groups.withColumn(f"{prefix}_overlap", F.when(connected, _overlap_of_sets("_previous")))
    starts = F.col("_group") & ~F.coalesce(F.col(f"{prefix}_overlap") >= overlap, F.lit(False))
    groups = runs.with_latest_time(groups, line, {"_start": starts})
    return groups.withColumn(
        f"{prefix}_consecutive", F.when(F.col("_group"), runs.run_length(line, "_start")).otherwise(0)
    ).drop(*columns, "_start", "_group", "_w0", "_w1")


def string_bit(string_no: Column, flag: Column, word: int) -> Column:
    """The bit of a flagged string in one of two 64-bit words, which hold 128 strings."""
    place = string_no.cast("int") - 1
    inside = flag & (place >= 64 * word) & (place < 64 * (word + 1))
    return F.when(inside, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long"))


def with_group_continuity(
    points: DataFrame, member: Column, minimum_strings: int, overlap: float, line: runs.Timeline, prefix: str
) -> DataFrame:
    """As :func:`group_continuity`, but on the points themselves: each gets overlap and streak of its device-time.

    The members of a device-time are two words of bits. Everything follows from
    windows inside a device, so points dealt out by device are not moved again.
    """
    at = Window.partitionBy(*line.keys, line.time)
    micros = F.unix_micros(line.time)
    whole = Window.partitionBy(*line.keys).orderBy(micros)
    earlier = whole.rangeBetween(Window.unboundedPreceding, -1)
    upto = whole.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    flag = F.coalesce(member, F.lit(False))
    result = points.withColumns({f"_w{i}": F.bit_or(string_bit(F.col("string_no"), flag, i)).over(at) for i in (0, 1)})
    result = result.withColumn("_group", F.bit_count("_w0") + F.bit_count("_w1") >= minimum_strings)
    result = result.withColumn("_previous", F.last(F.struct(F.col(line.time).alias("time"), "_w0", "_w1", "_group")).over(earlier))

    follows = F.coalesce(micros - F.unix_micros("_previous.time") == line.interval_micros, F.lit(False))
    connected = F.col("_group") & follows & F.coalesce(F.col("_previous._group"), F.lit(False))
    result = result.withColumn(f"{prefix}_overlap", F.when(connected, _overlap_of_sets("_previous.")))
    starts = F.col("_group") & ~F.coalesce(F.col(f"{prefix}_overlap") >= overlap, F.lit(False))
    result = result.withColumn("_start", F.max(F.when(starts, F.col(line.time))).over(upto))
    return result.withColumn(
        f"{prefix}_consecutive", F.when(F.col("_group"), runs.run_length(line, "_start")).otherwise(0)
    ).drop("_w0", "_w1", "_group", "_previous", "_start")


def add_persistence(points: DataFrame, settings: ResidualSettings, chunk_minutes: int | None = None) -> DataFrame:
    """Confirmed alerts: isolated streaks, continued groups, and their mixture.

    The mixture keeps a streak of either kind alive; alerts only it explains get
    the reason ``mixed_persistence``.
    """
    device_line = runs.Timeline(DEVICE_KEYS, "event_time", settings.interval_minutes, chunk_minutes)
    string_line = runs.Timeline(STRING_KEYS, "event_time", settings.interval_minutes, chunk_minutes)
    isolated, member = F.col("isolated_raw_alert") == 1, F.col("collective_raw_alert") == 1
    settled = (settings.minimum_collective_strings, settings.collective_overlap_threshold, device_line, "collective")
    if chunk_minutes is None:
        # one exchange: all that follows stays inside a device
        result = with_group_continuity(points.repartition(*DEVICE_KEYS), member, *settled)
    else:
        result = points.join(group_continuity(points, member, *settled), list(POINT_KEYS), "left")
    result = result.withColumnRenamed("collective_consecutive", "collective_event_consecutive")
    confirmed = F.col("collective_event_consecutive") >= settings.minimum_consecutive
    result = result.withColumn("collective_event_alert", F.coalesce(confirmed, F.lit(False)).cast("int"))
    result = runs.with_streak(result, string_line, isolated, "isolated_consecutive")
    result = runs.with_streak(result, string_line, isolated | member, "mixed_consecutive")
    single = F.col("isolated_consecutive") >= settings.minimum_consecutive
    grouped = (F.col("collective_event_alert") == 1) & member
    mixed = F.col("mixed_consecutive") >= settings.minimum_consecutive
    return result.withColumns(
        {
            "isolated_alert": single.cast("int"),
            "collective_member_alert": grouped.cast("int"),
            "legacy_alert": mixed.cast("int"),
            "residual_alert": (single | grouped | mixed).cast("int"),
            "alert_reason": F.when(single & grouped, "both")
            .when(single, "isolated")
            .when(grouped, "collective")
            .when(mixed, "mixed_persistence")
            .otherwise(""),
        }
    )


def with_irradiance(context: DataFrame) -> DataFrame:
    """Use the conditioned irradiance where there is one, else the peers'."""
    if "conditioned_virtual_irradiance" in context.columns:
        return context.withColumn(IRRADIANCE, F.col("conditioned_virtual_irradiance"))
    return context.withColumn(IRRADIANCE, F.col("raw_virtual_irradiance"))


def build_context(
    frame: DataFrame, scales: DataFrame, settings: ResidualSettings, inventory: DataFrame | None = None
) -> DataFrame:
    """Device rows with peer irradiance as their virtual irradiance."""
    return with_irradiance(peer_irradiance(peer_source(frame, settings, inventory), scales, settings))


def fit_thresholds(scored: DataFrame, settings: ResidualSettings) -> ResidualSettings:
    """LOF, low-residual and gap thresholds from all scored history."""
    low = (
        with_drops(scored, settings)
        .where("lof_eligible and response_known")
        .where(F.col("string_current") > float(settings.zero_current_threshold))
    )
    asked = [settings.lof_quantile, settings.residual_quantile]
    found = {r["column"]: r["q"] for r in quantiles_of_columns(low, [], ["lof_score", "residual_ratio"], asked).collect()}  # two rows
    gaps = scored.where(F.col("collective_gap").isNotNull()).groupBy(*POINT_KEYS).agg(
        F.first("collective_gap").alias("collective_gap")
    )
    gap = quantiles(gaps, [], "collective_gap", [settings.collective_gap_quantile]).first()
    if len(found) < 2:
        raise ValueError("No eligible residual scores remain for calibration")
    widest = gap["q"][0] if gap else 0.0
    return settings.derive(
        lof_threshold=found["lof_score"][0],
        residual_threshold=found["residual_ratio"][1],
        gap_threshold=max(widest, settings.minimum_collective_gap),
    )


class ResidualModel:
    """Fitted state of the residual detector: two tables and the settings."""

    def __init__(self, settings: ResidualSettings, scales: DataFrame, responses: DataFrame):
        self.settings = settings
        self.scales = scales
        self.responses = responses

    def context(self, frame: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
        return build_context(frame, self.scales, self.settings, inventory)

    def score(self, context: DataFrame) -> DataFrame:
        return add_raw_alerts(score_residuals(context, self.responses, self.settings), self.settings)

    def apply(self, frame: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
        return add_persistence(self.score(self.context(frame, inventory)), self.settings)

    def with_settings(self, settings: ResidualSettings) -> "ResidualModel":
        return ResidualModel(settings, self.scales, self.responses)


def fit_residual_model(
    frame: DataFrame,
    settings: ResidualSettings = ResidualSettings(),
    inventory: DataFrame | None = None,
    context: DataFrame | None = None,
    scales: DataFrame | None = None,
) -> ResidualModel:
    """Scales, responses and thresholds from history without known alarms.

    Pass a conditioned ``context`` with its ``scales`` to refit on it.
    """
    if context is None or scales is None:
        source = stage(peer_source(frame, settings, inventory), "peers")
        scales = stage(fit_device_scale(source), "device-scales")
        context = with_irradiance(peer_irradiance(source, scales, settings))
    else:
        context = with_irradiance(context)
    context = stage(context, "context")
    responses = stage(fit_responses(context, settings), "string-responses")
    scored = stage(score_residuals(context, responses, settings), "residual-scores")
    return ResidualModel(fit_thresholds(scored, settings), scales, responses)
