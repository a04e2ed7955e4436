"""Queries on alarms: parsing, coverage, extraction, evaluation, comparison, review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringwatch.functions.arrays import number_list
from stringwatch.operators import alarms, channels, compare, coverage, evaluate, extract, intervals, review, runs, strings
from stringwatch.plans.driver_views import (
    SQL_ALARMS,
    SQL_VIEWS,
    device_table,
    epoch,
    raw_alarm_table,
    station_table,
    table,
)
from stringwatch.plans.registry import query
from stringwatch.plans.string_queries import SETTINGS, SQL_SCORES
from stringwatch.sources import alarm_files, sinks
from stringwatch.storage import stage, staging_path

TZ = "Asia/Shanghai"
KEYS_SQL = "cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, epoch as event_epoch"


def keys():
    return "plant_id", "device_no", epoch("event_time", "event_epoch")


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def alarm_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed alarms with their plant; unmapped stations have none."""
    return alarms.with_plant(alarms.clean_alarm_events(raw_alarm_table(spark, sf_dir)), station_table(spark, sf_dir))


def alert_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strings.apply_string_detector(device_table(spark, sf_dir), SETTINGS)


def completeness_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device rows with a completeness flag."""
    return channels.with_completeness(device_table(spark, sf_dir).withColumn("main_string_count", F.lit(9)))


SQL_A = f"{SQL_VIEWS},{SQL_ALARMS}"


@query(
    "alarm_events_parsed",
    f"""with {SQL_A} select cast(id as varchar) as alarm_event_id, code as alarm_code, cast(dev as varchar) as device_no,
 cast(plant as varchar) as plant_id, rt as raise_epoch, et as end_epoch,
 case when plant is null then 'station_unmapped' else 'mapped' end as station_mapping_status from alc""",
)
def alarm_events_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alarm_events(spark, sf_dir).select(
        "alarm_event_id", "alarm_code", "device_no", "plant_id", epoch("raise_time", "raise_epoch"),
        epoch("end_time", "end_epoch"), "station_mapping_status",
    )


@query(
    "alarm_label_scope",
    f"""with {SQL_A} select cast(id as varchar) as alarm_event_id, case when len(strings) > 0 then 'string' else 'device' end as label_scope,
 cast(s as integer) as string_no from alc left join lateral (select unnest(strings) as s) on true""",
)
def alarm_label_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alarms.with_label_scope(alarm_events(spark, sf_dir)).select("alarm_event_id", "label_scope", "string_no")


@query(
    "alarm_files_of_manifest",
    f"""with {SQL_A} select cast(id as varchar) as alarm_event_id, code as alarm_code, 'station-' || cast(st_plant as varchar) as station_name,
 cast(dev as varchar) as device_no, rt as raise_epoch, et as end_epoch, case when len(strings) > 0 then 'string' else 'device' end as label_scope,
 cast(s as integer) as string_no
 from (select * from al where code in ('101001', '101002') and dev in (select s_suppkey from supplier)) left join lateral (select unnest(strings) as s) on true""",
)
def alarm_files_of_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms written as CSV files with a byte-order mark and read again, for the devices that a manifest lists."""
    path, raw = staging_path(spark, "alarm-files"), raw_alarm_table(spark, sf_dir)
    raw.withColumnRenamed("id", "\ufeffid").write.option("header", "true").csv(path)
    plant = F.floor(F.col("s_suppkey") / 10).cast("string")
    manifest = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("station-"), plant).alias("station_name"), F.col("s_suppkey").cast("string").alias("device_no")
    )
    return alarm_files.read_alarm_events(spark, path, manifest).select(
        "alarm_event_id", "alarm_code", "station_name", "device_no", epoch("raise_time", "raise_epoch"),
        epoch("end_time", "end_epoch"), "label_scope", "string_no",
    )


SQL_GRID = (
    SQL_A
    + """,
ap as (
  select *, unnest(generate_series(-((-rt) // 300) * 300 + case when rt % 300 = 0 then 0 else 300 end, et // 300 * 300, 300)) as epoch
  from alc where -((-rt) // 300) * 300 + case when rt % 300 = 0 then 0 else 300 end <= et // 300 * 300)
"""
)
# integer division truncates towards zero, so the ceiling is written out
SQL_GRID = SQL_GRID.replace(
    "-((-rt) // 300) * 300 + case when rt % 300 = 0 then 0 else 300 end", "(rt + 299) // 300 * 300"
)


@query(
    "alarm_grid_points",
    f"with {SQL_GRID} select cast(id as varchar) as alarm_event_id, cast(dev as varchar) as device_no, epoch as event_epoch from ap",
)
def alarm_grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = alarms.expand_to_grid(alarm_events(spark, sf_dir))
    return points.select("alarm_event_id", "device_no", epoch("event_time", "event_epoch"))


@query(
    "alarms_without_grid_points",
    f"with {SQL_A} select cast(id as varchar) as alarm_event_id from alc where (rt + 299) // 300 * 300 > et // 300 * 300",
)
def alarms_without_grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alarms.without_grid_points(alarm_events(spark, sf_dir)).select("alarm_event_id")


SQL_CLASS = (
    SQL_GRID
    + """,
cr as (select plant, dev, epoch, valid_strings >= 9 as ok from meta),
rg as (select plant, dev, min(epoch) as f, max(epoch) as l, count(*) as raw_rows, count(*) filter (where ok) as clean_rows from cr group by plant, dev),
c0 as (
  select a.id, a.code, a.plant, a.dev, a.rt, a.et, rg.f, rg.l,
         case when rg.f is not null and a.et >= rg.f and a.rt <= rg.l then greatest(a.rt, rg.f) end as es,
         case when rg.f is not null and a.et >= rg.f and a.rt <= rg.l then least(a.et, rg.l) end as ee
  from alc a left join rg on a.plant = rg.plant and a.dev = rg.dev),
c1 as (
  select *, coalesce(greatest((ee // 300 * 300 - (es + 299) // 300 * 300) // 300 + 1, 0), 0) as expected from c0),
c2 as (
  select c1.id, count(cr.epoch) as present, count(*) filter (where not cr.ok) as incomplete
  from c1 left join cr on c1.plant = cr.plant and c1.dev = cr.dev and cr.epoch between c1.es and c1.ee group by c1.id),
c3 as (
  select c1.*, c2.present, c2.incomplete, expected - present as missing,
    case when es is null then 'outside_production_range' when rt < f or et > l then 'partially_outside_range'
         when expected - present > 0 or incomplete > 0 or expected = 0 then 'within_range_gap' else 'complete' end as cls,
    case when f is null then 'station_or_device_not_found' when es is null then 'no_interval_overlap'
         when rt < f or et > l then 'left_or_right_boundary_outside' when expected = 0 then 'no_grid_point'
         when expected - present > 0 or incomplete > 0 then 'missing_timestamp_or_current' else 'all_expected_points_complete' end as reason
  from c1 join c2 using (id)),
lp as (
  select id, code, plant, dev, unnest(generate_series((es + 299) // 300 * 300, ee // 300 * 300, 300)) as epoch
  from c3 where cls = 'complete')
"""
)


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(
        alarms.classify_events(alarm_events(spark, sf_dir), completeness_rows(spark, sf_dir)), "classified-alarms"
    )


def label_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alarms.complete_label_points(classified(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fully covered alarms and their grid points, from one classification."""
    events = classified(spark, sf_dir)
    return events.where("classification = 'complete'"), alarms.complete_label_points(events)


@query(
    "device_ranges",
    f"""with {SQL_CLASS} select cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, raw_rows, clean_rows,
 f as first_epoch, l as last_epoch from rg""",
)
def device_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alarms.device_ranges(completeness_rows(spark, sf_dir)).select(
        "plant_id", "device_no", "raw_rows", "clean_rows",
        epoch("device_first_event_time", "first_epoch"), epoch("device_last_event_time", "last_epoch"),
    )


@query(
    "alarm_classification",
    f"""with {SQL_CLASS} select cast(id as varchar) as alarm_event_id, cls as classification, reason as range_reason, expected as expected_points,
 present as present_points, missing as missing_points, incomplete as current_incomplete_points, es as effective_start_epoch, ee as effective_end_epoch from c3""",
)
def alarm_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select(
        "alarm_event_id", "classification", "range_reason", "expected_points", "present_points", "missing_points",
        "current_incomplete_points", epoch("effective_start_time", "effective_start_epoch"),
        epoch("effective_end_time", "effective_end_epoch"),
    )


@query(
    "complete_label_points",
    f"with {SQL_CLASS} select cast(id as varchar) as alarm_event_id, {KEYS_SQL} from lp",
)
def complete_label_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_points(spark, sf_dir).select("alarm_event_id", *keys())


# --- coverage --------------------------------------------------------------

SQL_COVER = (
    SQL_GRID
    + """,
pc as (
  select m.plant, m.dev, m.epoch, m.valid_strings as finite, min(p.c) as lo, max(p.c) as hi
  from meta m left join pts p using (plant, dev, slot) group by all),
cv as (
  select ap.id, ap.code, ap.st_plant, ap.plant, ap.dev, ap.rt, ap.et, ap.epoch, pc.finite, pc.lo, pc.hi,
    case when ap.plant is null then 'station_unmapped' when ap.plant not in (select plant from meta) then 'plant_not_audited'
         when ap.dev not in (select dev from meta) then 'production_device_missing'
         when pc.epoch is null then 'production_timestamp_missing' when pc.finite < 9 then 'current_incomplete' else 'complete' end as status
  from ap left join pc on ap.plant = pc.plant and ap.dev = pc.dev and ap.epoch = pc.epoch),
ce as (
  select id, plant, count(*) as grid_points, count(*) filter (where status = 'complete') as good, count(*) filter (where status = 'current_incomplete') as part,
         count(*) filter (where status <> 'station_unmapped') as mapped, count(*) filter (where status = 'plant_not_audited') as na,
         count(*) filter (where status not in ('production_device_missing', 'station_unmapped', 'plant_not_audited')) as here,
         min(lo) as lo, max(hi) as hi from cv group by id, plant),
ce2 as (
  select *, case when mapped = 0 then 'station_unmapped' when na = grid_points then 'plant_not_audited' when here = 0 then 'production_device_missing'
     when good + part = 0 then 'production_timestamp_missing' when good + part < grid_points then 'production_timestamp_partial'
     when part > 0 then 'current_incomplete' else 'complete' end as ev_status from ce)
"""
)


def covered_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = alarms.expand_to_grid(alarm_events(spark, sf_dir))
    devices = device_table(spark, sf_dir)
    rows = devices.withColumn("main_string_count", F.lit(9))
    return coverage.attach_coverage(points, coverage.production_rows(rows), devices, devices.select("plant_id").distinct())


@query(
    "alarm_point_coverage",
    f"""with {SQL_COVER} select cast(id as varchar) as alarm_event_id, cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, epoch as event_epoch,
 status as coverage_status, cast(coalesce(finite, 0) as integer) as current_finite_count, round(lo, 6) as current_minimum, round(hi, 6) as current_maximum from cv""",
)
def alarm_point_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covered_points(spark, sf_dir).select(
        "alarm_event_id", *keys(), "coverage_status", "current_finite_count", *r6("current_minimum", "current_maximum")
    )


@query(
    "alarm_event_coverage",
    f"""with {SQL_COVER} select cast(id as varchar) as alarm_event_id, grid_points, good as complete_current_points, part as current_incomplete_points,
 round(good * 100.0 / grid_points, 6) as coverage_percent, ev_status as event_coverage_status, round(lo, 6) as minimum_current, round(hi, 6) as maximum_current from ce2""",
)
def alarm_event_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.event_coverage(covered_points(spark, sf_dir)).select(
        "alarm_event_id", "grid_points", "complete_current_points", "current_incomplete_points",
        *r6("coverage_percent"), "event_coverage_status", *r6("minimum_current", "maximum_current"),
    )


@query(
    "coverage_status_counts",
    f"with {SQL_COVER} select cast(plant as varchar) as plant_id, ev_status as event_coverage_status, count(*) as count from ce2 group by all",
)
def coverage_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = coverage.event_coverage(covered_points(spark, sf_dir))
    return coverage.status_counts(events, "event_coverage_status", "plant_id")


# --- extraction ------------------------------------------------------------

SQL_EXTRACT = (
    SQL_CLASS
    + """,
pr as (select * from meta),
wt as (
  select plant, t - o * 300 as epoch, bool_and(o > 0) as warm
  from (select distinct plant, epoch as t from lp), (select unnest([0, 1, 2, 3]) as o) group by all),
cx as (
  select p.plant, p.dev, p.epoch, p.active_power, w.warm,
         (select string_agg(cast(id as varchar), ',' order by cast(id as varchar)) from (select distinct id from lp where lp.plant = p.plant and lp.dev = p.dev and lp.epoch = p.epoch)) as ids
  from pr p join wt w on p.plant = w.plant and p.epoch = w.epoch)
"""
)


def production(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All device rows, from a source apart from the one that classified the alarms."""
    return device_table(spark, sf_dir)


@query(
    "alarm_currents",
    f"""with {SQL_EXTRACT} select cast(id as varchar) as alarm_event_id, cast(lp.plant as varchar) as plant_id, cast(lp.dev as varchar) as device_no,
 lp.epoch as event_epoch, round(active_power, 6) as active_power from lp join pr using (plant, dev, epoch)""",
)
def alarm_currents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.label_currents(production(spark, sf_dir), label_points(spark, sf_dir)).select(
        "alarm_event_id", *keys(), *r6("active_power")
    )


def written_production(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device rows written by plant and local date, as a scan that knows the types of its partitions."""
    path, rows = staging_path(spark, "production"), production(spark, sf_dir)
    sinks.write_partitioned(rows, path, timezone=TZ)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{n} {k}" for n, k in kinds.items() if n != "plant_id") + ", plant_id string, date date"
    return spark.read.schema(schema).parquet(path)


@query(
    "alarm_currents_by_day",
    f"""with {SQL_EXTRACT} select cast(id as varchar) as alarm_event_id, cast(lp.plant as varchar) as plant_id, cast(lp.dev as varchar) as device_no,
 lp.epoch as event_epoch, round(active_power, 6) as active_power from lp join pr using (plant, dev, epoch)""",
)
def alarm_currents_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a partitioned table: only plant-days with a label are read."""
    labels = stage(label_points(spark, sf_dir), "labels")
    rows = extract.rows_of_label_days(written_production(spark, sf_dir), labels, "2026-01-01", "2030-12-31", TZ)
    return extract.label_currents(rows, labels).select("alarm_event_id", *keys(), *r6("active_power"))


@query(
    "missing_alarm_points",
    f"""with {SQL_EXTRACT} select cast(id as varchar) as alarm_event_id, {KEYS_SQL} from lp
 where not exists (select 1 from pr where pr.plant = lp.plant and pr.dev = lp.dev and pr.epoch = lp.epoch)""",
)
def missing_alarm_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.missing_labels(production(spark, sf_dir), label_points(spark, sf_dir)).select("alarm_event_id", *keys())


@query(
    "labelled_device_rows",
    f"""with {SQL_EXTRACT} select {KEYS_SQL}, round(active_power, 6) as active_power from pr
 where exists (select 1 from lp where pr.plant = lp.plant and pr.dev = lp.dev and pr.epoch = lp.epoch)""",
)
def labelled_device_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.labelled_rows(production(spark, sf_dir), label_points(spark, sf_dir))
    return rows.select(*keys(), *r6("active_power"))


@query(
    "peer_context_rows",
    f"""with {SQL_EXTRACT} select {KEYS_SQL}, cast(warm as integer) as is_warmup, cast(ids is not null as integer) as is_alarm_target, ids as alarm_event_id from cx""",
)
def peer_context_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.peer_context(production(spark, sf_dir), label_points(spark, sf_dir))
    return rows.select(
        *keys(), F.col("is_warmup").cast("int").alias("is_warmup"),
        F.col("is_alarm_target").cast("int").alias("is_alarm_target"), "alarm_event_id",
    )


@query(
    "alarm_window_exclusion",
    f"""with {SQL_A} select {KEYS_SQL}, round(active_power, 6) as active_power from meta
 where not exists (select 1 from alc where alc.plant = meta.plant and alc.dev = meta.dev and meta.epoch between rt - 600 and et + 600)""",
)
def alarm_window_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = intervals.exclude_windows(
        device_table(spark, sf_dir), alarm_events(spark, sf_dir), start="raise_time", end="end_time", buffer_minutes=10
    )
    return kept.select(*keys(), *r6("active_power"))


# --- evaluation ------------------------------------------------------------

SQL_EVAL = (
    SQL_SCORES
    + ","
    + SQL_CLASS[len(SQL_VIEWS) + 1 :]
    + """,
pred as (
  select plant, dev, epoch, max(combined::int) as det, max((score is not null)::int) as el, sum(combined::int) as na, count(*) as no from alert group by plant, dev, epoch),
lk as (select distinct plant, dev, epoch from lp),
aln as (
  select p.*, (lk.epoch is not null)::int as y from pred p left join lk using (plant, dev, epoch)),
pe0 as (select *, coalesce(epoch - lag(epoch) over (partition by plant, dev order by epoch) <> 300, true) as nw from pred where det = 1),
pe1 as (select *, sum(nw::int) over (partition by plant, dev order by epoch) as run from pe0),
pev as (select plant, dev, min(epoch) as a, max(epoch) as b, count(*) as points from pe1 group by plant, dev, run),
lev as (select id, plant, dev, rt, es, ee from c3 where cls = 'complete'),
alp as (
  select lp.id, lp.plant, lp.dev, lp.epoch, (p.epoch is not null)::int as av, coalesce(det, 0) as det, coalesce(el, 0) as el, coalesce(na, 0) as na, coalesce(no, 0) as no
  from lp left join pred p using (plant, dev, epoch)),
aev as (
  select lev.id, lev.plant, lev.rt, count(a.epoch) as n, coalesce(sum(det), 0) as d, coalesce(sum(av), 0) as av, coalesce(sum(el), 0) as el,
         min(a.epoch) filter (where det = 1) as f from lev left join alp a on lev.id = a.id group by all)
"""
)


def rolled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.device_time_alerts(alert_points(spark, sf_dir), "combined_alert", "lof_eligible")


@query(
    "device_time_rollup",
    f"""with {SQL_EVAL} select {KEYS_SQL}, det as detected, el as score_eligible, cast(na as bigint) as alerted_strings, no as output_strings from pred""",
)
def device_time_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolled_up(spark, sf_dir).select(*keys(), "detected", "score_eligible", "alerted_strings", "output_strings")


@query(
    "labelled_predictions",
    f"with {SQL_EVAL} select {KEYS_SQL}, det as detected, y as label from aln",
)
def labelled_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.align_labels(rolled_up(spark, sf_dir), label_points(spark, sf_dir)).select(*keys(), "detected", "label")


@query(
    "label_coverage",
    f"""with {SQL_EVAL}, k as (select count(*) as t, count(p.epoch) as c from lk left join pred p using (plant, dev, epoch))
select t as label_points_total, c as label_points_covered, t - c as label_points_uncovered, round(c * 100.0 / t, 6) as label_coverage_percent from k""",
)
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = evaluate.label_coverage(rolled_up(spark, sf_dir), label_points(spark, sf_dir))
    return result.withColumn("label_coverage_percent", F.round("label_coverage_percent", 6))


SQL_METRICS = """
  count(*) filter (where y = 1 and det = 1) as true_positive, count(*) filter (where y = 0 and det = 1) as false_positive,
  count(*) filter (where y = 0 and det = 0) as true_negative, count(*) filter (where y = 1 and det = 0) as false_negative,
  round(coalesce(count(*) filter (where y = 1 and det = 1) / nullif(count(*) filter (where det = 1), 0), 0), 6) as precision,
  round(coalesce(count(*) filter (where y = 1 and det = 1) / nullif(count(*) filter (where y = 1), 0), 0), 6) as recall,
  round(coalesce(2.0 * count(*) filter (where y = 1 and det = 1) / nullif(count(*) filter (where det = 1) + count(*) filter (where y = 1), 0), 0), 6) as f1
"""


@query(
    "binary_metrics",
    f"""with {SQL_EVAL} select 'all' as rows_used, {SQL_METRICS} from aln union all select 'eligible', {SQL_METRICS} from aln where el = 1""",
)
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = evaluate.align_labels(rolled_up(spark, sf_dir), label_points(spark, sf_dir))
    both = aligned.select("*", F.explode(F.when(F.col("score_eligible") == 1, F.array(F.lit("all"), F.lit("eligible"))).otherwise(F.array(F.lit("all")))).alias("rows_used"))
    metrics = evaluate.binary_metrics(both, "label", "detected", ["rows_used"])
    return metrics.select(
        "rows_used", "true_positive", "false_positive", "true_negative", "false_negative", *r6("precision", "recall", "f1")
    )


def predicted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.alert_events(rolled_up(spark, sf_dir), F.col("detected") == 1)


@query(
    "event_matches",
    f"""with {SQL_EVAL} select cast(p.plant as varchar) as plant_id, cast(p.dev as varchar) as device_no, cast(l.id as varchar) as alarm_event_id,
 p.a as prediction_start, p.b as prediction_end, l.es as alarm_start, l.ee as alarm_end
 from pev p join lev l on p.plant = l.plant and p.dev = l.dev and p.b >= l.es and p.a <= l.ee""",
)
def event_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = evaluate.event_matches(predicted_events(spark, sf_dir), labels(spark, sf_dir)[0])
    return matches.select(
        "plant_id", "device_no", "alarm_event_id", epoch("prediction_start_time", "prediction_start"),
        epoch("prediction_end_time", "prediction_end"), epoch("alarm_start_time", "alarm_start"), epoch("alarm_end_time", "alarm_end"),
    )


@query(
    "event_metrics",
    f"""with {SQL_EVAL},
hp as (select p.*, exists (select 1 from lev l where p.plant = l.plant and p.dev = l.dev and p.b >= l.es and p.a <= l.ee) as hit from pev p),
hl as (select l.*, exists (select 1 from pev p where p.plant = l.plant and p.dev = l.dev and p.b >= l.es and p.a <= l.ee) as hit from lev l),
hc as (select (select count(*) from hp) as p, (select count(*) from hp where hit) as ph, (select count(*) from hl) as l, (select count(*) from hl where hit) as lh)
select p as predicted_events, ph as predicted_events_hit, l as label_events, lh as label_events_hit, p - ph as false_positive_events, l - lh as missed_label_events,
 round(ph / p, 6) as precision, round(lh / l, 6) as recall, round(2 * (ph / p) * (lh / l) / (ph / p + lh / l), 6) as f1 from hc""",
)
def event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = stage(predicted_events(spark, sf_dir), "predicted-events")
    result = evaluate.event_metrics(predicted, labels(spark, sf_dir)[0])
    return result.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def aligned_alarm_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.alarm_point_recall(label_points(spark, sf_dir), rolled_up(spark, sf_dir))


def recalled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, points = labels(spark, sf_dir)
    aligned = evaluate.alarm_point_recall(points, rolled_up(spark, sf_dir))
    return evaluate.alarm_event_recall(events, aligned)


@query(
    "alarm_point_recall",
    f"""with {SQL_EVAL} select cast(id as varchar) as alarm_event_id, {KEYS_SQL}, av as output_available, det as detected, el as score_eligible,
 cast(na as bigint) as alerted_strings, no as output_strings from alp""",
)
def alarm_point_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_alarm_points(spark, sf_dir).select(
        "alarm_event_id", *keys(), "output_available", "detected", "score_eligible", "alerted_strings", "output_strings"
    )


@query(
    "alarm_event_recall",
    f"""with {SQL_EVAL} select cast(id as varchar) as alarm_event_id, n as alarm_points, cast(d as bigint) as detected_points, cast(av as bigint) as output_available_points,
 cast(el as bigint) as score_eligible_points, cast(d > 0 as integer) as event_detected, round(case when n > 0 then d / n else 0 end, 6) as event_point_recall,
 round((f - rt) / 60.0, 6) as detection_delay_minutes from aev""",
)
def alarm_event_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recalled_events(spark, sf_dir).select(
        "alarm_event_id", "alarm_points", "detected_points", "output_available_points", "score_eligible_points",
        "event_detected", *r6("event_point_recall", "detection_delay_minutes"),
    )


@query(
    "point_recall_summary",
    f"""with {SQL_EVAL} select cast(plant as varchar) as plant_id, count(*) as alarm_points, cast(sum(det) as bigint) as detected_points,
 cast(sum(av) as bigint) as output_available_points, cast(sum(el) as bigint) as score_eligible_points, cast(count(*) - sum(det) as bigint) as missed_points,
 round(sum(det) / count(*), 6) as point_recall, round(sum(av) / count(*), 6) as output_coverage, round(sum(el) * 100.0 / count(*), 6) as score_eligible_percent
 from alp group by grouping sets ((plant), ())""",
)
def point_recall_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = evaluate.point_recall_summary(aligned_alarm_points(spark, sf_dir))
    return result.withColumns({c: F.round(c, 6) for c in ("point_recall", "output_coverage", "score_eligible_percent")})


@query(
    "event_recall_summary",
    f"""with {SQL_EVAL}, sc2 as (select 'plant' as scope, cast(plant as varchar) as plant_id, * exclude (plant) from aev union all select 'overall', '', * exclude (plant) from aev)
select scope, plant_id, count(*) as alarm_events, cast(sum((d > 0)::int) as bigint) as detected_events, cast(count(*) - sum((d > 0)::int) as bigint) as missed_events,
 round(sum((d > 0)::int) / count(*), 6) as event_recall, round(quantile_cont((f - rt) / 60.0, 0.5), 6) as delay_median,
 round(quantile_cont((f - rt) / 60.0, 0.9), 6) as delay_p90, round(max((f - rt) / 60.0), 6) as delay_maximum from sc2 group by scope, plant_id""",
)
def event_recall_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stage(recalled_events(spark, sf_dir), "event-recall")
    return evaluate.event_recall_summary(events).select(
        "scope", "plant_id", "alarm_events", "detected_events", "missed_events",
        *r6("event_recall", "delay_median", "delay_p90", "delay_maximum"),
    )


def station_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(alert_points(spark, sf_dir), "string-alerts").withColumn("station_name", F.concat(F.lit("station-"), "plant_id"))


def scoped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(alarms.with_label_scope(alarm_events(spark, sf_dir)), "scoped-alarms")


SQL_SCOPED = (
    SQL_SCORES
    + ","
    + SQL_ALARMS
    + """,
lab as (select id, st_plant as st, dev, rt, et, len(strings) > 0 as str, s from alc left join lateral (select unnest(strings) as s) on true),
lpt as (
  select *, unnest(generate_series((rt + 299) // 300 * 300, et // 300 * 300, 300)) as epoch from lab where (rt + 299) // 300 * 300 <= et // 300 * 300),
pl as (
  select 'combined_alert' as col, plant as st, dev, s, epoch, combined::int as p from alert
  union all select 'lof_alert', plant, dev, s, epoch, lof_alert::int from alert
  union all select 'zero_current_alert', plant, dev, s, epoch, zero::int from alert),
pd as (select col, st, dev, epoch, max(p) as p from pl group by all)
"""
)


@query(
    "evaluation_by_column_points",
    f"""with {SQL_SCOPED},
ej as (
  select col, 'string' as scope, p as det, (exists (select 1 from lpt where str and lpt.st = pl.st and lpt.dev = pl.dev and lpt.s = pl.s and lpt.epoch = pl.epoch))::int as y from pl
  union all
  select col, 'device', p, (exists (select 1 from lpt where lpt.st = pd.st and lpt.dev = pd.dev and lpt.epoch = pd.epoch))::int from pd)
select col as prediction_column, scope, {SQL_METRICS}, count(*) filter (where y = 1) as positive_labels from ej group by col, scope""",
)
def evaluation_by_column_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = alarms.expand_to_grid(scoped_labels(spark, sf_dir))
    result = evaluate.evaluate_points(station_predictions(spark, sf_dir), labels)
    return result.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    "evaluation_by_column_events",
    f"""with {SQL_SCOPED},
xs as (select col, st, dev, s, epoch from pl where p = 1), xd as (select distinct col, st, dev, cast(null as bigint) as s, epoch from pl where p = 1),
xa as (select 'string' as scope, * from xs union all select 'device', * from xd),
x0 as (select *, coalesce(epoch - lag(epoch) over (partition by scope, col, st, dev, s order by epoch) <> 300, true) as nw from xa),
x1 as (select *, sum(nw::int) over (partition by scope, col, st, dev, s order by epoch) as run from x0),
xe as (select scope, col, st, dev, s, min(epoch) as a, max(epoch) as b from x1 group by scope, col, st, dev, s, run),
le as (select case when str then 'string' else 'device' end as scope, col, id, st, dev, s, rt, et from lab, (select unnest(['combined_alert', 'lof_alert', 'zero_current_alert']) as col)),
xh as (select *, exists (select 1 from le where le.scope = xe.scope and le.col = xe.col and le.st = xe.st and le.dev = xe.dev and (le.s = xe.s or xe.scope = 'device') and xe.b >= le.rt and xe.a <= le.et) as hit from xe),
lh as (select *, exists (select 1 from xe where le.scope = xe.scope and le.col = xe.col and le.st = xe.st and le.dev = xe.dev and (le.s = xe.s or xe.scope = 'device') and xe.b >= le.rt and xe.a <= le.et) as hit from le),
xc as (select scope, col, count(*) as p, count(*) filter (where hit) as ph from xh group by all),
lc as (select scope, col, count(*) as l, count(*) filter (where hit) as lh from lh group by all)
select col as prediction_column, scope as label_scope, coalesce(p, 0) as predicted_events, coalesce(ph, 0) as predicted_events_hit,
 coalesce(l, 0) as label_events, coalesce(lh, 0) as label_events_hit, round(coalesce(ph / nullif(p, 0), 0), 6) as precision, round(coalesce(lh / nullif(l, 0), 0), 6) as recall,
 round(coalesce(2 * (ph / p) * (lh / l) / nullif(ph / p + lh / l, 0), 0), 6) as f1
from xc full join lc using (scope, col)""",
)
def evaluation_by_column_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = evaluate.evaluate_events(station_predictions(spark, sf_dir), scoped_labels(spark, sf_dir))
    return result.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    "alarms_within_coverage",
    f"""with {SQL_SCOPED} select cast(id as varchar) as alarm_event_id from alc
 where exists (select 1 from alert where alert.plant = alc.st_plant and alert.dev = alc.dev)""",
)
def alarms_within_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = station_predictions(spark, sf_dir)
    return alarms.restrict_to_predictions(alarm_events(spark, sf_dir), predictions).select("alarm_event_id")


@query(
    "alarms_outside_coverage",
    f"""with {SQL_SCOPED} select 'station-' || cast(st_plant as varchar) as station_name, count(*) as excluded_events from alc
 where not exists (select 1 from alert where alert.plant = alc.st_plant and alert.dev = alc.dev) group by 1""",
)
def alarms_outside_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = station_predictions(spark, sf_dir)
    return alarms.excluded_stations(alarm_events(spark, sf_dir), predictions)


# --- comparison ------------------------------------------------------------

SQL_COMPARE = (
    SQL_SCORES
    + """,
vv as (select *, raw or zero as one, raw and score >= 1.8 or zero as two from alert),
vl as (
  select plant, dev, epoch, coalesce(list(s order by s) filter (where one), []) as a, coalesce(list(s order by s) filter (where two), []) as b,
         coalesce(list(s order by s) filter (where lof_alert), []) as c from vv group by plant, dev, epoch),
vc as (
  select *, case when len(a) > 0 and len(b) = 0 then 'loose_only' when len(a) = 0 and len(b) > 0 then 'tight_only' when a <> b then 'both_different' else 'both_same' end as cs
  from vl where len(a) > 0 or len(b) > 0),
v0 as (select *, coalesce(epoch - lag(epoch) over (partition by plant, dev order by epoch) <> 300, true) as nw from vc),
v1 as (select *, sum(nw::int) over (partition by plant, dev order by epoch) as run from v0),
vs as (select plant, dev, run, min(epoch) as x, max(epoch) as y, count(*) as n from v1 group by plant, dev, run),
va as (select plant, dev, run, list(distinct e order by e) as a from (select plant, dev, run, unnest(a) as e from v1) group by all),
vb as (select plant, dev, run, list(distinct e order by e) as b from (select plant, dev, run, unnest(b) as e from v1) group by all)
"""
)


def txt(column: str) -> str:
    """Number list of the checking engine as text."""
    return f"coalesce(array_to_string(list_transform({column}, lambda v: lpad(cast(v as varchar), 2, '0')), ','), '')"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loose and a tight alert column of the same points."""
    points = stage(alert_points(spark, sf_dir), "string-alerts")
    zero = F.col("zero_current_alert") == 1
    raw = F.col("lof_raw_alert") == 1
    return points.withColumn("loose", raw | zero).withColumn(
        "tight", F.coalesce((raw & (F.col("lof_score") >= 1.8)) | zero, F.lit(False))
    )


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = versions(spark, sf_dir)
    return compare.compare_two(
        compare.alerted_strings(points, F.col("loose"), "loose"),
        compare.alerted_strings(points, F.col("tight"), "tight"),
        "loose",
        "tight",
    )


@query(
    "version_comparison_points",
    f"with {SQL_COMPARE} select {KEYS_SQL}, {txt('a')} as loose, {txt('b')} as tight, cs as comparison_case from vc",
)
def version_comparison_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = compare.as_text(compared(spark, sf_dir), ["loose", "tight"])
    return result.select(*keys(), "loose", "tight", "comparison_case")


@query(
    "version_comparison_events",
    f"""with {SQL_COMPARE} select cast(vs.plant as varchar) as plant_id, cast(vs.dev as varchar) as device_no, x as start_epoch, y as end_epoch, n as alert_time_points,
 {txt('a')} as loose, {txt('b')} as tight, cast((y - x) // 60 + 5 as integer) as duration_minutes,
 case when a is not null and b is null then 'loose_only' when a is null and b is not null then 'tight_only' when a <> b then 'both_different' else 'both_same' end as comparison_case
 from vs left join va using (plant, dev, run) left join vb using (plant, dev, run)""",
)
def version_comparison_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = compare.comparison_events(compared(spark, sf_dir), ["loose", "tight"])
    events = events.withColumn(
        "comparison_case", compare.comparison_case(F.col("loose"), F.col("tight"), "loose", "tight")
    )
    return compare.as_text(events, ["loose", "tight"]).select(
        "plant_id", "device_no", epoch("start_time", "start_epoch"), epoch("end_time", "end_epoch"),
        "alert_time_points", "loose", "tight", "duration_minutes", "comparison_case",
    )


@query(
    "comparison_case_counts",
    f"with {SQL_COMPARE} select cast(plant as varchar) as plant_id, cs as comparison_case, count(*) as count from vc group by grouping sets ((plant, cs), (cs))",
)
def comparison_case_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.case_counts(compared(spark, sf_dir))


@query(
    "three_way_comparison",
    f"with {SQL_COMPARE} select {KEYS_SQL}, {txt('a')} as loose, {txt('b')} as tight, {txt('c')} as persistent from vl",
)
def three_way_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"loose": "loose", "tight": "tight", "persistent": "lof_alert"}
    result = compare.compare_columns(versions(spark, sf_dir), names)
    return compare.as_text(result, list(names)).select(*keys(), *names)


@query(
    "filtered_strings",
    f"""with {SQL_COMPARE} select {KEYS_SQL}, cast(s as integer) as string_no, round(c, 6) as string_current, round(score, 6) as lof_score from vv where one and not coalesce(two, false)""",
)
def filtered_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = versions(spark, sf_dir)
    first = points.withColumn("alert", F.col("loose"))
    second = points.withColumn("alert", F.col("tight"))
    result = compare.filtered_strings(first, second, "alert", ["string_current", "lof_score"])
    return result.select(*keys(), "string_no", *r6("string_current", "lof_score"))


@query(
    "drop_distribution",
    f"""with {SQL_COMPARE}, f as (select c as v from vv where one and not coalesce(two, false))
select round(min(v), 6) as minimum, round(max(v), 6) as maximum, count(*) filter (where v < 5) as below_small, count(*) as samples,
 round(median(v), 6) as median, round(quantile_cont(v, 0.9), 6) as p90 from f""",
)
def drop_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = versions(spark, sf_dir)
    filtered = stage(points.where("loose and not tight").select("string_current"), "filtered")
    result = compare.drop_distribution(filtered, "string_current", 5.0)
    return result.withColumns({c: F.round(c, 6) for c in ("minimum", "maximum", "median", "p90")})


# --- review ----------------------------------------------------------------

SQL_REVIEW = (
    SQL_SCORES
    + ","
    + SQL_ALARMS
    + """,
rw as (
  select a.id, p.plant, p.dev, p.epoch, p.s, p.c, p.r, p.lof_alert, row_number() over (partition by a.id, p.plant, p.dev, p.epoch order by p.c, p.s) as rk,
         count(*) over (partition by a.id, p.plant, p.dev, p.epoch) as n
  from alc a join alert p on a.plant = p.plant and a.dev = p.dev and p.epoch between a.rt and a.et)
"""
)


def review_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = alarm_events(spark, sf_dir).select(
        "alarm_event_id", "plant_id", "device_no",
        F.col("raise_time").alias("window_start"), F.col("end_time").alias("window_end"),
    )
    return review.window_points(alert_points(spark, sf_dir), windows, "alarm_event_id", TZ)


@query(
    "alarm_review_points",
    f"""with {SQL_REVIEW} select cast(id as varchar) as alarm_event_id, {KEYS_SQL}, cast(s as integer) as string_no, round(c, 6) as string_current,
 cast(rk as integer) as current_rank_ascending, n as strings_at_timestamp, cast(rk = 1 as integer) as is_lowest_current from rw""",
)
def alarm_review_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_points(spark, sf_dir).select(
        "alarm_event_id", *keys(), "string_no", *r6("string_current"), "current_rank_ascending",
        "strings_at_timestamp", F.col("is_lowest_current").cast("int").alias("is_lowest_current"),
    )


@query(
    "alarm_review_summary",
    f"""with {SQL_REVIEW} select cast(id as varchar) as alarm_event_id, cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no,
 count(distinct epoch) as timestamps, count(*) as rows, cast(arg_min(s, struct_pack(c := c, e := epoch, s := s)) as integer) as lowest_string_no,
 round(min(c), 6) as minimum_current, cast(sum(lof_alert::int) as bigint) as lof_alert from rw group by id, plant, dev""",
)
def alarm_review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = review.window_summary(review_points(spark, sf_dir), "alarm_event_id", ["lof_alert"])
    return summary.select(
        "alarm_event_id", "plant_id", "device_no", "timestamps", "rows", "lowest_string_no", *r6("minimum_current"), "lof_alert"
    )


SQL_DEVICE_EVENTS = (
    SQL_SCORES
    + """,
de0 as (select plant, dev, epoch, list(s order by s) as ss from alert where combined group by plant, dev, epoch),
de1 as (select *, coalesce(epoch - lag(epoch) over (partition by plant, dev order by epoch) <> 300, true) as nw from de0),
de2 as (select *, sum(nw::int) over (partition by plant, dev order by epoch) as run from de1),
de3 as (select plant, dev, min(epoch) over (partition by plant, dev, run) as st, epoch, ss from de2)
"""
)


@query(
    "points_with_event_start",
    f"with {SQL_DEVICE_EVENTS} select {KEYS_SQL}, st as start_epoch, {txt('ss')} as string_no from de3",
)
def points_with_event_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = compare.alerted_strings(alert_points(spark, sf_dir), F.col("combined_alert"), "string_no")
    named = runs.with_run_start(listed, runs.Timeline(("plant_id", "device_no")), "start_time")
    return named.select(*keys(), epoch("start_time", "start_epoch"), number_list(F.col("string_no")).alias("string_no"))


@query(
    "first_events_for_review",
    f"""with {SQL_DEVICE_EVENTS}, e as (select plant, dev, st, max(epoch) as en, count(*) as points from de3 group by plant, dev, st)
select cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, st as start_epoch, en as end_epoch, points
from e order by st, cast(plant as varchar), cast(dev as varchar) limit 10""",
)
def first_events_for_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = compare.alerted_strings(alert_points(spark, sf_dir), F.col("combined_alert"), "string_no")
    events = runs.collapse(listed, runs.Timeline(("plant_id", "device_no")), F.lit(True))
    return review.top_events(events, 10, ["start_time", "plant_id", "device_no"]).select(
        "plant_id", "device_no", epoch("start_time", "start_epoch"), epoch("end_time", "end_epoch"), "points"
    )


@query(
    "numbered_events",
    f"""with {SQL_DEVICE_EVENTS}, e as (select plant, dev, st, max(epoch) as en from de3 group by plant, dev, st)
select cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, st as start_epoch, en as end_epoch,
 'event-' || lpad(cast(row_number() over (order by cast(plant as varchar), cast(dev as varchar), st) as varchar), 6, '0') as event_id from e""",
)
def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stringwatch.operators.numbering import with_event_ids

    listed = compare.alerted_strings(alert_points(spark, sf_dir), F.col("combined_alert"), "string_no")
    events = runs.collapse(listed, runs.Timeline(("plant_id", "device_no")), F.lit(True))
    numbered = with_event_ids(events, ["plant_id", "device_no", "start_time"])
    return numbered.select(
        "plant_id", "device_no", epoch("start_time", "start_epoch"), epoch("end_time", "end_epoch"), "event_id"
    )


@query(
    "manual_review_rows",
    f"""with {SQL_REVIEW},
mr as (
  select a.id, m.plant, m.dev, m.epoch, m.slot from alc a join meta m on a.plant = m.plant and a.dev = m.dev and m.epoch between a.rt and a.et
  where a.plant is not null and m.epoch % 300 = 0),
ml as (select plant, dev, epoch, list(s order by s) as ss from alert where combined and c > 0 and s <= 9 group by plant, dev, epoch)
select cast(id as varchar) as alarm_event_id, cast(mr.plant as varchar) as plant_id, cast(mr.dev as varchar) as device_no,
 strftime(to_timestamp(mr.epoch + 28800)::timestamp, '%Y-%m-%d %H:%M:%S') as event_time_local, round(p.c, 6) as string_current_01, 'TRUE' as baseline,
 coalesce({txt('ss').replace("coalesce(", "").replace(", '')", "")}, 'FALSE') as detector
from mr left join ml using (plant, dev, epoch) left join pts p on p.plant = mr.plant and p.dev = mr.dev and p.slot = mr.slot and p.s = 1""",
)
def manual_review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = alarms.expand_to_grid(alarm_events(spark, sf_dir).where("plant_id is not null"))
    rows = device_table(spark, sf_dir).withColumn("main_string_count", F.lit(9))
    currents = extract.label_currents(rows, labels)
    result = review.manual_review(
        currents, alarm_events(spark, sf_dir), {"detector": alert_points(spark, sf_dir)}, {"detector": "combined_alert"}, TZ
    )
    return result.select(
        "alarm_event_id", "plant_id", "device_no", "event_time_local", *r6("string_current_01"), "baseline", "detector"
    )
