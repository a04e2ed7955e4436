"""One effect gate against two: comparison points and events, filtered strings, and packages per plant combined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringwatch.functions.timegrid import local_text
from stringwatch.operators import compare, residuals
from stringwatch.operators.numbering import event_id
from stringwatch.plans.alarm_queries import TZ, txt
from stringwatch.plans.driver_views import device_table, epoch
from stringwatch.plans.registry import query
from stringwatch.plans.residual_queries import KEYS_SQL, SETTINGS, SQL_SCALE, keys, model, r6
from stringwatch.sources import plant_tables
from stringwatch.storage import stage, staging_path

# fixed values: the two gates that are compared, a relative minimum alone and with one in ampere
EFFECT = SETTINGS.derive(minimum_isolated_relative_drop=0.10, minimum_isolated_absolute_drop=0.0, gate_mode="and")
DUAL = SETTINGS.derive(minimum_isolated_relative_drop=0.10, minimum_isolated_absolute_drop=5.0, gate_mode="and")
NAMES = ["effect_gate", "dual_gate"]
DIAGNOSTICS = [
    "string_current", "expected_current", "isolated_absolute_drop", "isolated_relative_drop",
    "residual_ratio", "residual_median", "lof_score",
]


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted, context = model(spark, sf_dir)
    return stage(residuals.score_residuals(context, fitted.responses, SETTINGS), "residual-scores")


def gated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return compare.gate_versions(scored_rows(spark, sf_dir), EFFECT, DUAL)


def gated_points(one: DataFrame, two: DataFrame) -> DataFrame:
    alert = F.col("gated_alert") == 1
    first, second = (compare.alerted_strings(f, alert, n) for f, n in zip((one, two), NAMES))
    return compare.compare_two(first, second, *NAMES)


def gated_events(points: DataFrame) -> DataFrame:
    events = compare.comparison_events(points, NAMES)
    return events.withColumn("comparison_case", compare.comparison_case(F.col(NAMES[0]), F.col(NAMES[1]), *NAMES))


SQL_GATES = (
    SQL_SCALE
    + f""",
gp as (
  select *, coalesce(score is not null and known and c > 0 and score >= 1.5 and r < rmed and drel >= 0.1, false) or col as one,
         coalesce(score is not null and known and c > 0 and score >= 1.5 and r < rmed and drel >= 0.1 and dabs >= 5, false) or col as two
  from cand),
gl as (
  select plant, dev, epoch, coalesce(list(s order by s) filter (where one), []) as a, coalesce(list(s order by s) filter (where two), []) as b
  from gp group by plant, dev, epoch),
gc as (
  select *, case when len(b) = 0 then 'effect_gate_only' when len(a) = 0 then 'dual_gate_only' when a <> b then 'both_different' else 'both_same' end as cs
  from gl where len(a) > 0 or len(b) > 0),
g0 as (select *, coalesce(epoch - lag(epoch) over (partition by plant, dev order by epoch) <> 300, true) as nw from gc),
g1 as (select *, sum(nw::int) over (partition by plant, dev order by epoch) as run from g0),
gs as (select plant, dev, run, min(epoch) as x, max(epoch) as y, count(*) as n from g1 group by plant, dev, run),
ga as (select plant, dev, run, list(distinct e order by e) as a from (select plant, dev, run, unnest(a) as e from g1) group by all),
gb as (select plant, dev, run, list(distinct e order by e) as b from (select plant, dev, run, unnest(b) as e from g1) group by all),
ge as (
  select gs.*, coalesce(a, []) as a, coalesce(b, []) as b,
         case when b is null then 'effect_gate_only' when a is null then 'dual_gate_only' when a <> b then 'both_different' else 'both_same' end as cs
  from gs left join ga using (plant, dev, run) left join gb using (plant, dev, run)),
gf as (select * from gp where one and not two)
"""
)


def sql_local(column: str) -> str:
    return f"strftime(to_timestamp({column} + 28800)::timestamp, '%Y-%m-%d %H:%M:%S')"


@query(
    "gate_comparison_points",
    f"with {SQL_GATES} select {KEYS_SQL}, {txt('a')} as effect_gate, {txt('b')} as dual_gate, cs as comparison_case from gc",
)
def gate_comparison_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = compare.as_text(gated_points(*gated(spark, sf_dir)), NAMES)
    return points.select(*keys(), *NAMES, "comparison_case")


@query(
    "gate_comparison_events",
    f"""with {SQL_GATES} select cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, {sql_local('x')} as raise_time_local,
 {sql_local('y')} as end_time_local, {txt('a')} as effect_gate, {txt('b')} as dual_gate, cs as comparison_case, n as alert_time_points,
 cast((y - x) // 60 + 5 as integer) as duration_minutes, '' as manual_is_low_current, '' as manual_string_no, '' as review_note from ge""",
)
def gate_comparison_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = compare.as_text(gated_events(gated_points(*gated(spark, sf_dir))), NAMES)
    return compare.review_columns(events, TZ).drop("start_time", "end_time")


@query(
    "gate_filtered_strings",
    f"""with {SQL_GATES} select cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, {sql_local('epoch')} as event_time_local,
 lpad(cast(s as varchar), 2, '0') as string_no, round(c + 1e-9, 6) as string_current, round(expected + 1e-9, 6) as expected_current,
 round(dabs + 1e-9, 6) as isolated_absolute_drop, round(drel, 6) as isolated_relative_drop, round(r, 6) as residual_ratio,
 round(rmed, 6) as residual_median, round(score, 6) as lof_score from gf""",
)
def gate_filtered_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare.filtered_strings(*gated(spark, sf_dir), "gated_alert", DIAGNOSTICS)
    # amperes are short binary fractions here: keep them off rounding ties
    amperes = {c: F.round(F.col(c) + 1e-9, 6).alias(c) for c in DIAGNOSTICS[:3]}
    return found.select(
        "plant_id", "device_no", local_text("event_time", TZ).alias("event_time_local"),
        F.lpad(F.col("string_no").cast("string"), 2, "0").alias("string_no"), *amperes.values(), *r6(*DIAGNOSTICS[3:]),
    )


@query(
    "gate_drop_distribution",
    f"""with {SQL_GATES} select count(dabs) as samples, round(min(dabs) + 1e-9, 6) as minimum, round(median(dabs) + 1e-9, 6) as median,
 round(quantile_cont(dabs, 0.9) + 1e-9, 6) as p90, round(max(dabs) + 1e-9, 6) as maximum, count(*) filter (where dabs < 0.5) as below_small from gf""",
)
def gate_drop_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    filtered = stage(compare.filtered_strings(*gated(spark, sf_dir), "gated_alert", DIAGNOSTICS), "filtered")
    found = compare.drop_distribution(filtered)
    return found.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("minimum", "maximum", "median", "p90")})


# --- packages per plant ----------------------------------------------------

EVENTS = "row bigint, event_id string, device_no string, start_epoch bigint, end_epoch bigint, effect_gate string, dual_gate string, comparison_case string, alert_time_points bigint"
POINTS = "row bigint, device_no string, event_epoch bigint, effect_gate string, dual_gate string, comparison_case string"
FILTERED = "row bigint, device_no string, event_epoch bigint, string_no int, isolated_absolute_drop double"


def columns_of(ddl: str) -> list[str]:
    return [field.split()[0] for field in ddl.split(", ")]


def plant_packages(spark: SparkSession, sf_dir: str, names: Sequence[str] = ("events", "points", "filtered")) -> dict[str, DataFrame]:
    """Comparison tables written per plant, with numbers of each plant's own, and read again; of those that are named."""
    one, two = gated(spark, sf_dir)
    points = stage(gated_points(one, two), "gate-points")

    def events() -> DataFrame:
        rows = compare.as_text(gated_events(points), NAMES).withColumns(
            {"start_epoch": F.unix_seconds("start_time"), "end_epoch": F.unix_seconds("end_time")}
        )
        return plant_tables.numbered_by_plant(rows, ["device_no", "start_epoch"]).withColumn("event_id", event_id("gates", F.col("row")))

    def texts() -> DataFrame:
        rows = compare.as_text(points, NAMES).withColumn("event_epoch", F.unix_seconds("event_time"))
        return plant_tables.numbered_by_plant(rows, ["device_no", "event_epoch"])

    def filtered() -> DataFrame:
        rows = compare.filtered_strings(one, two, "gated_alert", DIAGNOSTICS).withColumn("event_epoch", F.unix_seconds("event_time"))
        return plant_tables.numbered_by_plant(rows, ["device_no", "event_epoch", "string_no"])

    # numbering writes its rows, so a table is made only if it is wanted
    tables = {"events": (events, EVENTS), "points": (texts, POINTS), "filtered": (filtered, FILTERED)}
    root, found = staging_path(spark, "packages"), {}
    for name in names:
        table, ddl = tables[name]
        plant_tables.write_plant_tables(table().select("plant_id", *columns_of(ddl)), f"{root}/{name}")
        found[name] = plant_tables.read_plant_tables(spark, f"{root}/{name}", ddl)
    return found


@query(
    "combined_plant_tables",
    f"""with {SQL_GATES}, gn as (
  select *, cast(plant as varchar) as p, row_number() over (partition by plant order by cast(dev as varchar), x) as own from ge)
select row_number() over (order by p, own) as row, 'plant-' || p || '-gates-' || lpad(cast(own as varchar), 6, '0') as event_id, p as plant_id,
 cast(dev as varchar) as device_no, x as start_epoch, y as end_epoch, {txt('a')} as effect_gate, {txt('b')} as dual_gate, cs as comparison_case, n as alert_time_points from gn""",
)
def combined_plant_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    combined = plant_tables.combine_plant_tables(plant_packages(spark, sf_dir, ["events"])["events"])
    # CSV has no empty text beside null
    return combined.withColumns({n: F.coalesce(n, F.lit("")) for n in NAMES})


def sql_cases(table: str, name: str) -> str:
    return f"""select grouping(plant) as o, plant, count(*) as {name}, count(*) filter (where cs = 'both_same') as {name}_both_same,
 count(*) filter (where cs = 'both_different') as {name}_both_different, count(*) filter (where cs like '%_only') as {name}_only
 from {table} group by grouping sets ((plant), ())"""


@query(
    "combined_plant_report",
    f"""with {SQL_GATES}, re as ({sql_cases('ge', 'events')}), rp as ({sql_cases('gc', 'points')}),
rf as (select grouping(plant) as o, plant, count(*) as filtered_strings from gf group by grouping sets ((plant), ()))
select cast(rp.plant as varchar) as plant_id, re.* exclude (o, plant), rp.* exclude (o, plant), coalesce(filtered_strings, 0) as filtered_strings
from rp join re on rp.o = re.o and rp.plant is not distinct from re.plant left join rf on rp.o = rf.o and rp.plant is not distinct from rf.plant""",
)
def combined_plant_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = plant_packages(spark, sf_dir)
    return compare.plant_report(packages["events"], packages["points"], packages["filtered"])
