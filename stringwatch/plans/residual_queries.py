"""Queries of the residual detector, its thresholds, groups and memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringwatch.config import (
    HierarchySettings,
    MemorySettings,
    PersistentSettings,
    ResidualSettings,
    WeatherSettings,
    derive_persistence,
)
from stringwatch.functions.arrays import number_list
from stringwatch.functions.gates import effect_gate
from stringwatch.operators import irradiance, memory, persistent, residuals, thresholds
from stringwatch.plans import detection
from stringwatch.plans.driver_views import SQL_VIEWS, SQL_WEATHER, device_table, epoch, weather_table
from stringwatch.plans.registry import query
from stringwatch.sources import sinks
from stringwatch.storage import stage, staging_path

KEYS_SQL = "cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, epoch as event_epoch"
SETTINGS = ResidualSettings(
    lof_threshold=1.5,
    residual_threshold=0.9,
    gap_threshold=0.2,
    minimum_isolated_relative_drop=0.20,
    minimum_isolated_absolute_drop=0.5,
    gate_mode="or",
)
HIERARCHY = HierarchySettings(
    quantile=0.9,
    minimum_device_samples=60,
    minimum_device_days=2,
    minimum_plant_count_samples=150,
    minimum_plant_count_days=2,
    minimum_count_samples=500,
    minimum_count_days=2,
    shrinkage_k=50.0,
    minimum_consecutive=2,
    timezone="UTC",
)
PERSISTENT = PersistentSettings(
    deficit_quantile=0.5,
    membership_overlap_threshold=0.2,
    minimum_consecutive=2,
    minimum_device_samples=2,
    minimum_device_days=1,
    minimum_plant_count_samples=5,
    minimum_plant_count_days=1,
    minimum_count_samples=20,
    minimum_count_days=1,
    shrinkage_k=10.0,
    timezone="UTC",
)


def keys():
    return "plant_id", "device_no", epoch("event_time", "event_epoch")


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def model(spark: SparkSession, sf_dir: str) -> tuple[residuals.ResidualModel, DataFrame]:
    """Fitted scales and responses, and the context they were fitted on."""
    source = stage(irradiance.peer_source(device_table(spark, sf_dir), SETTINGS), "peers")
    scales = irradiance.fit_device_scale(source)
    context = stage(
        residuals.with_irradiance(irradiance.peer_irradiance(source, scales, SETTINGS)), "context"
    )
    responses = residuals.fit_responses(context, SETTINGS)
    return residuals.ResidualModel(SETTINGS, scales, responses), context


def scored_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted, context = model(spark, sf_dir)
    return stage(fitted.score(context), "residual-points")


SQL_SCALE = (
    SQL_VIEWS
    + """,
rep as (
  select m.plant, m.dev, m.slot, m.epoch, p.m from meta m
  left join (select plant, dev, slot, median(c) as m from pts where c > 0 group by all) p using (plant, dev, slot)),
scl as (select plant, dev, quantile_cont(m, 0.95) as sc from rep where m is not null group by all),
lev as (select r.*, case when sc > 0 then m / sc end as u from rep r left join scl using (plant, dev)),
vg as (
  select a.plant, a.dev, a.slot, a.epoch, any_value(a.m) as m, count(b.u) as peers,
         case when count(b.u) >= 5 then median(b.u) end as g
  from lev a left join lev b on a.plant = b.plant and a.slot = b.slot and a.dev <> b.dev
  group by a.plant, a.dev, a.slot, a.epoch),
rsp as (
  select plant, dev, s, median(c / g) as a from pts join vg using (plant, dev, slot)
  where g >= 0.02 and c > 0 group by all),
rr as (
  select p.plant, p.dev, p.slot, p.s, p.c, v.epoch, v.g, v.peers, rsp.a is not null as known,
         case when v.g >= 0.02 and rsp.a > 0 then rsp.a * v.g end as expected
  from pts p join vg v using (plant, dev, slot) left join rsp using (plant, dev, s)),
rv as (select *, case when expected > 0 then c / expected end as r from rr),
val as (
  select *, count(*) over g as n, median(r) over g as rmed, row_number() over (partition by plant, dev, slot order by r, s) as rk,
         lead(r) over (partition by plant, dev, slot order by r, s) - r as gap
  from rv where r is not null and c > 0 window g as (partition by plant, dev, slot)),
near as (
  select a.plant, a.dev, a.slot, a.s, b.s as j, abs(a.r - b.r) as d,
         row_number() over (partition by a.plant, a.dev, a.slot, a.s order by abs(a.r - b.r), b.s) as k
  from val a join val b on a.plant = b.plant and a.dev = b.dev and a.slot = b.slot and a.s <> b.s
  where a.n >= 6),
knn as (select * from near where k <= 5),
kdist as (select plant, dev, slot, s, max(d) as kd from knn group by all),
lrd as (
  select a.plant, a.dev, a.slot, a.s, 1.0 / avg(greatest(a.d, b.kd, 0.01)) as l
  from knn a join kdist b on a.plant = b.plant and a.dev = b.dev and a.slot = b.slot and a.j = b.s group by all),
lof as (
  select a.plant, a.dev, a.slot, a.s, avg(b.l) / any_value(o.l) as score
  from knn a join lrd b on a.plant = b.plant and a.dev = b.dev and a.slot = b.slot and a.j = b.s
  join lrd o on a.plant = o.plant and a.dev = o.dev and a.slot = o.slot and a.s = o.s
  group by a.plant, a.dev, a.slot, a.s),
best as (
  select plant, dev, slot, any_value(n) as n, max(gap) as gap, arg_max(rk, struct_pack(g := gap, k := -rk)) as k
  from val where n >= 4 and n > 2 and rk >= 2 and rk < n group by plant, dev, slot),
grp as (
  select b.plant, b.dev, b.slot, any_value(b.gap) as gap, any_value(case when b.k <= b.n * 0.5 then b.k else 0 end) as size,
         median(v.r) filter (where b.k <= b.n * 0.5 and v.rk <= b.k) as low
  from best b join val v using (plant, dev, slot) group by b.plant, b.dev, b.slot),
sc as (
  select rv.plant, rv.dev, rv.slot, rv.epoch, rv.s, rv.c, rv.g, rv.peers, rv.known, rv.expected, rv.r,
         dm.rmed, coalesce(dm.n, 0) as n, lof.score, grp.gap, coalesce(grp.size, 0) as size, grp.low,
         coalesce(val.rk <= grp.size, false) as member,
         1 - rv.r / dm.rmed as drel, rv.expected - rv.c as dabs
  from rv left join (select plant, dev, slot, any_value(rmed) as rmed, any_value(n) as n from val group by all) dm using (plant, dev, slot)
  left join lof using (plant, dev, slot, s) left join grp using (plant, dev, slot) left join val using (plant, dev, slot, s)),
cand as (
  select *, coalesce(drel >= 0.2, false) or coalesce(dabs >= 0.5, false) as gate,
         coalesce(score is not null and known and c > 0 and score >= 1.5 and r < rmed
                  and (coalesce(drel >= 0.2, false) or coalesce(dabs >= 0.5, false)), false) as iso,
         coalesce(member and c > 0 and gap >= 0.2 and low <= 0.9, false) as col
  from sc)
"""
)


@query(
    "device_scale",
    f"with {SQL_SCALE} select cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, round(sc, 6) as device_scale from scl",
)
def device_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = stage(irradiance.peer_source(device_table(spark, sf_dir), SETTINGS), "peers")
    return irradiance.fit_device_scale(source).select("plant_id", "device_no", *r6("device_scale"))


@query(
    "peer_irradiance",
    f"""with {SQL_SCALE} select {KEYS_SQL}, round(m, 6) as representative, cast(peers as integer) as peer_count,
 round(g, 6) as raw_virtual_irradiance from vg""",
)
def peer_irradiance(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, context = model(spark, sf_dir)
    return context.select(*keys(), *r6("representative"), "peer_count", *r6("raw_virtual_irradiance"))


@query(
    "string_response",
    f"""with {SQL_SCALE} select cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no,
 cast(s as integer) as string_no, round(a, 6) as response from rsp""",
)
def string_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model(spark, sf_dir)[0].responses.select("plant_id", "device_no", "string_no", *r6("response"))


@query(
    "residual_scores",
    f"""with {SQL_SCALE} select {KEYS_SQL}, cast(s as integer) as string_no, round(expected + 1e-9, 6) as expected_current,
 round(r, 6) as residual_ratio, round(rmed, 6) as residual_median, round(score, 6) as lof_score,
 cast(n as integer) as available_strings, round(drel, 6) as isolated_relative_drop,
 round(dabs + 1e-9, 6) as isolated_absolute_drop, cast(gate as integer) as isolated_effect_eligible,
 cast(iso as integer) as isolated_raw_alert from cand""",
)
def residual_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    # amperes are short binary fractions here: keep them off rounding ties
    amperes = {c: F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("expected_current", "isolated_absolute_drop")}
    return scored_points(spark, sf_dir).select(
        *keys(), "string_no",
        amperes["expected_current"],
        *r6("residual_ratio", "residual_median", "lof_score"),
        "available_strings",
        *r6("isolated_relative_drop"),
        amperes["isolated_absolute_drop"],
        "isolated_effect_eligible", "isolated_raw_alert",
    )


@query(
    "largest_gap_groups",
    f"""with {SQL_SCALE} select {KEYS_SQL}, cast(s as integer) as string_no, round(gap, 6) as collective_gap,
 cast(size as integer) as collective_group_size, round(low, 6) as collective_group_median,
 cast(member as integer) as member, cast(col as integer) as collective_raw_alert from cand""",
)
def largest_gap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_points(spark, sf_dir).select(
        *keys(), "string_no", *r6("collective_gap"), "collective_group_size", *r6("collective_group_median"),
        F.col("collective_group_member").cast("int").alias("member"), "collective_raw_alert",
    )


@query(
    "effect_gates",
    f"""with {SQL_SCALE} select {KEYS_SQL}, cast(s as integer) as string_no,
 cast(coalesce(drel >= 0.1, false) as integer) as relative_gate,
 cast(coalesce(drel >= 0.1, false) and coalesce(dabs >= 0.5, false) as integer) as dual_gate,
 cast(coalesce(drel >= 0.2, false) or coalesce(dabs >= 0.5, false) as integer) as either_gate from cand""",
)
def effect_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    relative, absolute = F.col("isolated_relative_drop"), F.col("isolated_absolute_drop")
    return scored_points(spark, sf_dir).select(
        *keys(), "string_no",
        effect_gate("and", relative, absolute, 0.10, 0.0).cast("int").alias("relative_gate"),
        effect_gate("and", relative, absolute, 0.10, 0.5).cast("int").alias("dual_gate"),
        effect_gate("or", relative, absolute, 0.20, 0.5).cast("int").alias("either_gate"),
    )


SQL_PERSIST = (
    SQL_SCALE
    + """,
dt as (
  select plant, dev, slot, epoch, list(s order by s) filter (where col) as mem from cand group by all),
dt2 as (
  select *, coalesce(len(mem), 0) >= 2 as isg,
         lag(epoch) over w as pe, lag(mem) over w as pm, lag(coalesce(len(mem), 0) >= 2) over w as pg
  from dt window w as (partition by plant, dev order by epoch)),
dt3 as (
  select *, case when isg and coalesce(epoch - pe = 300, false) and coalesce(pg, false)
       then len(list_intersect(mem, pm)) * 1.0 / len(list_distinct(list_concat(mem, pm))) end as ov from dt2),
dt4 as (
  select *, sum(case when isg and not coalesce(ov >= 0.5, false) then 1 else 0 end) over (partition by plant, dev order by epoch) as run from dt3),
dt5 as (
  select *, case when isg then row_number() over (partition by plant, dev, run, isg order by epoch) else 0 end as cons from dt4),
pp as (
  select cand.*, dt5.ov, dt5.cons, dt5.cons >= 2 as cev from cand join dt5 using (plant, dev, slot)),
p1 as (
  select *, iso or col as mix, row_number() over g as rn,
         coalesce(epoch - lag(epoch) over g <> 300, true) as brk from pp
  window g as (partition by plant, dev, s order by epoch)),
p2 as (
  select *,
    case when iso then rn - coalesce(max(case when not iso then rn when brk then rn - 1 end) over g, 0) else 0 end as iso_n,
    case when mix then rn - coalesce(max(case when not mix then rn when brk then rn - 1 end) over g, 0) else 0 end as mix_n
  from p1 window g as (partition by plant, dev, s order by epoch rows unbounded preceding)),
p3 as (select *, iso_n >= 2 as si, cev and col as sg, mix_n >= 2 as sm from p2)
"""
)


@query(
    "residual_alerts",
    f"""with {SQL_PERSIST} select {KEYS_SQL}, cast(s as integer) as string_no,
 cast(iso_n as integer) as isolated_consecutive, cast(mix_n as integer) as mixed_consecutive,
 round(ov, 6) as collective_overlap, cast(cons as integer) as collective_event_consecutive,
 cast(cev as integer) as collective_event_alert, cast(sg as integer) as collective_member_alert,
 cast(si or sg or sm as integer) as residual_alert,
 case when si and sg then 'both' when si then 'isolated' when sg then 'collective' when sm then 'mixed_persistence' else '' end as alert_reason
 from p3""",
)
def residual_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = residuals.add_persistence(scored_points(spark, sf_dir), SETTINGS)
    return alerts.select(
        *keys(), "string_no", "isolated_consecutive", "mixed_consecutive", *r6("collective_overlap"),
        "collective_event_consecutive", "collective_event_alert", "collective_member_alert",
        "residual_alert", "alert_reason",
    )


SQL_PERSIST_THREE = SQL_PERSIST
for _point in ("dt5.cons >= {} as cev", "iso_n >= {} as si", "mix_n >= {} as sm"):
    SQL_PERSIST_THREE = SQL_PERSIST_THREE.replace(_point.format(2), _point.format(3))


@query(
    "derived_persistence_alerts",
    f"""with {SQL_PERSIST_THREE} select {KEYS_SQL}, cast(s as integer) as string_no, cast(cev as integer) as collective_event_alert,
 cast(si or sg or sm as integer) as residual_alert from p3""",
)
def derived_persistence_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored calibration derived to one more confirming point; scores stay as they are."""
    path = staging_path(spark, "calibration")
    sinks.save_model(spark, f"{path}/residual", SETTINGS)
    sinks.save_model(spark, f"{path}/hierarchy", HIERARCHY)
    base = sinks.load_settings(spark, f"{path}/residual", ResidualSettings)
    derived, _ = derive_persistence(base, sinks.load_settings(spark, f"{path}/hierarchy", HierarchySettings), 3, "three-points", "three-points")
    alerts = residuals.add_persistence(scored_points(spark, sf_dir), derived)
    return alerts.select(*keys(), "string_no", "collective_event_alert", "residual_alert")


@query(
    "residual_thresholds",
    f"""with {SQL_SCALE} select
 (select round(quantile_cont(score, 0.995), 6) from sc where score is not null and known and c > 0) as lof_threshold,
 (select round(quantile_cont(r, 0.005), 6) from sc where score is not null and known and c > 0) as residual_threshold,
 (select round(greatest(quantile_cont(gap, 0.995), 0.05), 6) from best) as gap_threshold""",
)
def residual_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = residuals.fit_thresholds(scored_points(spark, sf_dir), SETTINGS)
    row = (fitted.lof_threshold, fitted.residual_threshold, fitted.gap_threshold)
    names = ["lof_threshold", "residual_threshold", "gap_threshold"]
    return spark.createDataFrame([row], names).select(*r6(*names))


SQL_HIER = (
    SQL_PERSIST
    + """,
smp as (
  select plant, dev, n as cnt, score as v, epoch // 86400 as day from cand
  where score is not null and known and c > 0 and r < rmed and gate),
t0 as (select quantile_cont(v, 0.9) as t from smp),
q1 as (select cnt, count(*) as m, count(distinct day) as days, quantile_cont(v, 0.9) as q from smp group by cnt),
t1 as (select cnt, t0.t + m / (m + 50.0) * (q - t0.t) as t from q1, t0 where m >= 500 and days >= 2),
q2 as (select plant, cnt, count(*) as m, count(distinct day) as days, quantile_cont(v, 0.9) as q from smp group by plant, cnt),
t2 as (
  select plant, cnt, coalesce(t1.t, t0.t) + m / (m + 50.0) * (q - coalesce(t1.t, t0.t)) as t
  from q2 left join t1 using (cnt) cross join t0 where m >= 150 and days >= 2),
q3 as (select plant, dev, count(*) as m, count(distinct day) as days, quantile_cont(v, 0.9) as q from smp group by plant, dev),
use as (select plant, dev, arg_max(cnt, struct_pack(m := m, c := -cnt)) as cnt from (select plant, dev, cnt, count(*) as m from smp group by all) group by plant, dev),
t3 as (
  select plant, dev, coalesce(t2.t, t1.t, t0.t) + m / (m + 50.0) * (q - coalesce(t2.t, t1.t, t0.t)) as t
  from q3 join use using (plant, dev) left join t2 using (plant, cnt) left join t1 using (cnt) cross join t0
  where m >= 60 and days >= 2),
ctx as (
  select p3.*, coalesce(t3.t, t2.t, t1.t, t0.t) as thr,
         case when t3.t is not null then 'device' when t2.t is not null then 'plant_count' when t1.t is not null then 'count' else 'global' end as lvl
  from p3 left join t3 using (plant, dev) left join t2 on p3.plant = t2.plant and p3.n = t2.cnt
  left join t1 on p3.n = t1.cnt cross join t0),
h1 as (
  select *, coalesce(score is not null and known and c > 0 and score >= thr and r < rmed and gate, false) as hraw from ctx),
h2 as (
  select *, case when hraw then rn - coalesce(max(case when not hraw then rn when brk then rn - 1 end) over g, 0) else 0 end as hn
  from h1 window g as (partition by plant, dev, s order by epoch rows unbounded preceding)),
h3 as (select *, hn >= 2 or sg as strict from h2)
"""
)


def strict_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_points(spark, sf_dir)
    fitted = thresholds.fit_hierarchy(scored, SETTINGS, HIERARCHY)
    alerts = residuals.add_persistence(scored, SETTINGS)
    return thresholds.add_strict_alerts(alerts, SETTINGS, fitted, HIERARCHY)


@query(
    "hierarchical_thresholds",
    f"""with {SQL_HIER}
 select 'global' as level, '' as k1, '' as k2, round(t, 6) as threshold from t0
 union all select 'count', cast(cnt as varchar), '', round(t, 6) from t1
 union all select 'plant_count', cast(plant as varchar), cast(cnt as varchar), round(t, 6) from t2
 union all select 'device', cast(plant as varchar), cast(dev as varchar), round(t, 6) from t3""",
)
def hierarchical_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = thresholds.fit_hierarchy(scored_points(spark, sf_dir), SETTINGS, HIERARCHY)
    parts = [
        spark.createDataFrame([("global", "", "", fitted.global_threshold)], "level string, k1 string, k2 string, threshold double"),
        fitted.counts.select(F.lit("count"), F.col("string_count").cast("string"), F.lit(""), "threshold"),
        fitted.plant_counts.select(F.lit("plant_count"), "plant_id", F.col("string_count").cast("string"), "threshold"),
        fitted.devices.select(F.lit("device"), "plant_id", "device_no", "threshold"),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result.withColumn("threshold", F.round("threshold", 6))


@query(
    "strict_hierarchical_alerts",
    f"""with {SQL_HIER} select {KEYS_SQL}, cast(s as integer) as string_no, round(thr, 6) as isolated_hier_lof_threshold,
 lvl as isolated_hier_threshold_level, cast(hraw as integer) as hier_raw_alert, cast(hn as integer) as hier_consecutive,
 cast(strict as integer) as hier_strict_alert from h3""",
)
def strict_hierarchical_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict_points(spark, sf_dir).select(
        *keys(), "string_no", *r6("isolated_hier_lof_threshold"), "isolated_hier_threshold_level",
        "hier_raw_alert", "hier_consecutive", "hier_strict_alert",
    )


# the automaton itself, one recursion step per row of a string
SQL_MEMORY = (
    SQL_PERSIST
    + """,
mseq as (
  select plant, dev, slot, s, epoch, c, iso as raw, r is not null and c > 0 as ok,
         row_number() over (partition by plant, dev, s order by epoch) as i from p3),
mem as (
  select plant, dev, slot, s, epoch, i, ok, ok and raw as raw,
         case when ok and raw then 1 else 0 end as streak, case when ok and not raw then 1 else 0 end as normals,
         ok and raw and 1 >= 2 as act
  from mseq where i = 1
  union all
  select n.plant, n.dev, n.slot, n.s, n.epoch, n.i, n.ok, n.ok and n.raw,
         case when n.ok and n.raw then case when m.ok and n.epoch - m.epoch = 300 then m.streak else 0 end + 1 else 0 end,
         case when n.ok and not n.raw then case when m.ok and n.epoch - m.epoch = 300 then m.normals else 0 end + 1 else 0 end,
         case when not n.ok then false
              when n.raw then (m.ok and n.epoch - m.epoch = 300 and m.act)
                   or case when m.ok and n.epoch - m.epoch = 300 then m.streak else 0 end + 1 >= 2
              else m.ok and n.epoch - m.epoch = 300 and m.act and m.normals + 1 < 3 end
  from mem m join mseq n on m.plant = n.plant and m.dev = n.dev and m.s = n.s and n.i = m.i + 1),
mfin as (
  select mem.*, raw and act as alert, raw and act and streak < 2 as again, p3.sg,
         (raw and act) or p3.sg as fin
  from mem join p3 using (plant, dev, slot, s)),
evi as (
  select *, sum(case when nw then 1 else 0 end) over (partition by plant, dev, s order by epoch) as run from (
    select *, coalesce(epoch - lag(epoch) over (partition by plant, dev, s order by epoch) <> 300, true) as nw
    from mfin where raw or fin)),
mev as (
  select plant, dev, s, min(epoch) as a, max(epoch) as b, count(*) as points, min(epoch) filter (where fin) as f,
         sum(fin::int) as alerts, sum(again::int) as again, max(fin::int) as confirmed
  from evi group by plant, dev, s, run)
"""
)
MEMORY = MemorySettings(entry_consecutive=2, clear_consecutive=3)


def remembered(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = residuals.add_persistence(scored_points(spark, sf_dir), SETTINGS)
    return memory.add_memory(
        alerts,
        F.col("isolated_raw_alert") == 1,
        F.col("residual_ratio").isNotNull() & (F.col("string_current") > 0),
        MEMORY,
        strict_column="collective_member_alert",
    )


@query(
    "confirmed_memory",
    f"""with recursive {SQL_MEMORY} select {KEYS_SQL}, cast(s as integer) as string_no, cast(raw as integer) as memory_raw_anomaly,
 cast(streak as integer) as memory_entry_streak, cast(normals as integer) as memory_normal_streak,
 cast(act as integer) as memory_active, cast(again as integer) as memory_reactivated_alert,
 cast(alert as integer) as memory_alert, cast(fin as integer) as final_alert from mfin""",
)
def confirmed_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remembered(spark, sf_dir).select(
        *keys(), "string_no", "memory_raw_anomaly", "memory_entry_streak", "memory_normal_streak",
        "memory_active", "memory_reactivated_alert", "memory_alert", "final_alert",
    )


@query(
    "reconstructed_events",
    f"""with recursive {SQL_MEMORY} select cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no,
 cast(s as integer) as string_no, a as start_epoch, b as end_epoch, points, f as first_alert_epoch,
 cast(alerts as bigint) as alert_points, cast(again as bigint) as reactivated_points, cast(confirmed as integer) as confirmed from mev""",
)
def reconstructed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.reconstruct_events(remembered(spark, sf_dir), MEMORY).select(
        "plant_id", "device_no", "string_no", epoch("start_time", "start_epoch"), epoch("end_time", "end_epoch"),
        "points", epoch("first_alert_time", "first_alert_epoch"), "alert_points", "reactivated_points", "confirmed",
    )


@query(
    "unconfirmed_candidates",
    f"""with recursive {SQL_MEMORY} select cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no,
 cast(s as integer) as string_no, a as start_epoch, b as end_epoch, points from mev where confirmed = 0""",
)
def unconfirmed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate events that no alert ever confirmed."""
    return detection.unconfirmed_candidates(remembered(spark, sf_dir), detection.DetectionSettings(memory=MEMORY)).select(
        "plant_id", "device_no", "string_no", epoch("start_time", "start_epoch"), epoch("end_time", "end_epoch"), "points"
    )


@query(
    "memory_report",
    f"""with recursive {SQL_MEMORY} select cast(plant as varchar) as plant_id, count(*) as rows,
 cast(sum(raw::int) as bigint) as raw_anomaly_points, cast(sum(act::int) as bigint) as memory_active_rows,
 cast(sum(again::int) as bigint) as memory_reactivated_points, cast(sum(fin::int) as bigint) as alert_points
 from mfin group by grouping sets ((plant), ())""",
)
def memory_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.memory_report(remembered(spark, sf_dir))


SQL_GROUPS = (
    SQL_SCALE
    + """,
gd as (
  select plant, dev, slot, epoch, count(*) filter (where known and r is not null and c > 0) as cnt,
         count(*) filter (where known and r is not null and c > 0 and member) as size,
         median(r) filter (where known and r is not null and c > 0 and member) as lo,
         median(r) filter (where known and r is not null and c > 0 and not member) as up,
         list(s order by s) filter (where known and r is not null and c > 0 and member) as mem
  from sc group by all),
gs as (select *, case when size >= 2 and size <= cnt * 0.5 and up is not null then 1 - lo / up end as def from gd),
g1 as (
  select *, lag(epoch) over w as pe, lag(mem) over w as pm, lag(def) over w as pd from gs
  window w as (partition by plant, dev order by epoch)),
g2 as (
  select *, case when def is not null and coalesce(epoch - pe = 300, false) and pd is not null
    then len(list_intersect(mem, pm)) * 1.0 / len(list_distinct(list_concat(mem, pm))) end as ov from g1),
g3 as (
  select *, sum(case when def is not null and not coalesce(ov >= 0.2, false) then 1 else 0 end) over (partition by plant, dev order by epoch) as run from g2),
g4 as (
  select *, case when def is not null then row_number() over (partition by plant, dev, run, def is not null order by epoch) else 0 end as cons from g3),
g5 as (
  select *, case when cons >= 2 then (def + pd) / 2 end as wmed from g4),
ps as (select plant, dev, cnt, wmed as v, epoch // 86400 as day from g5 where wmed is not null),
lvls as (
  select 'global' as l, '' as k1, '' as k2, * from ps
  union all select 'count', cast(cnt as varchar), '', * from ps
  union all select 'plant_count', cast(plant as varchar), cast(cnt as varchar), * from ps
  union all select 'device', cast(plant as varchar), cast(dev as varchar), * from ps),
lm as (select l, k1, k2, count(*) as m, count(distinct day) as days, median(v) as md, quantile_cont(v, 0.5) as q from lvls group by l, k1, k2),
la as (select l, k1, k2, median(abs(v - md)) as mad from lvls join lm using (l, k1, k2) group by l, k1, k2),
lq as (select l, k1, k2, m, days, least(q, md + 6 * 1.4826 * mad) as q from lm join la using (l, k1, k2)),
u0 as (select greatest(q, 0.03) as t from lq where l = 'global'),
u1 as (select cast(k1 as bigint) as cnt, greatest(u0.t + m / (m + 10.0) * (q - u0.t), 0.03) as t from lq, u0 where l = 'count' and m >= 20),
u2 as (
  select cast(k1 as bigint) as plant, cast(k2 as bigint) as cnt,
         greatest(coalesce(u1.t, u0.t) + m / (m + 10.0) * (q - coalesce(u1.t, u0.t)), 0.03) as t
  from lq left join u1 on cast(lq.k2 as bigint) = u1.cnt cross join u0 where l = 'plant_count' and m >= 5),
uu as (select plant, dev, arg_max(cnt, struct_pack(m := m, c := -cnt)) as cnt from (select plant, dev, cnt, count(*) as m from ps group by all) group by plant, dev),
u3 as (
  select uu.plant, uu.dev, greatest(coalesce(u2.t, u1.t, u0.t) + m / (m + 10.0) * (q - coalesce(u2.t, u1.t, u0.t)), 0.03) as t
  from lq join uu on lq.k1 = cast(uu.plant as varchar) and lq.k2 = cast(uu.dev as varchar)
  left join u2 on u2.plant = uu.plant and u2.cnt = uu.cnt left join u1 on u1.cnt = uu.cnt cross join u0
  where l = 'device' and m >= 2),
g6 as (
  select g5.*, coalesce(u3.t, u2.t, u1.t, u0.t) as thr,
         case when u3.t is not null then 'device' when u2.t is not null then 'plant_count' when u1.t is not null then 'count' else 'global' end as lvl
  from g5 left join u3 on g5.plant = u3.plant and g5.dev = u3.dev left join u2 on g5.plant = u2.plant and g5.cnt = u2.cnt
  left join u1 on g5.cnt = u1.cnt cross join u0)
"""
)


@query(
    "persistent_groups",
    f"""with {SQL_GROUPS} select {KEYS_SQL}, cast(cnt as integer) as string_count, round(def, 6) as persistent_deficit,
 round(ov, 6) as persistent_membership_overlap, cast(cons as integer) as persistent_consecutive,
 round(wmed, 6) as persistent_window_median_deficit from g5""",
)
def persistent_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persistent.group_deficits(scored_points(spark, sf_dir), PERSISTENT).select(
        *keys(), "string_count", *r6("persistent_deficit", "persistent_membership_overlap"),
        "persistent_consecutive", *r6("persistent_window_median_deficit"),
    )


@query(
    "persistent_alerts",
    f"""with {SQL_GROUPS} select g6.plant::varchar as plant_id, g6.dev::varchar as device_no, g6.epoch as event_epoch,
 cast(sc.s as integer) as string_no, round(thr, 6) as persistent_threshold, lvl as persistent_threshold_level,
 cast(coalesce(round(wmed - thr, 9) >= 0, false) as integer) as persistent_event_alert,
 cast(coalesce(round(wmed - thr, 9) >= 0, false) and member and known and c > 0 as integer) as persistent_collective_member_alert
 from sc join g6 using (plant, dev, slot)""",
)
def persistent_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_points(spark, sf_dir)
    groups = stage(persistent.group_deficits(scored, PERSISTENT), "persistent-groups")
    fitted, _ = persistent.fit_persistent(scored, PERSISTENT, groups)
    alerts = persistent.apply_persistent(scored, fitted, groups=groups)
    return alerts.select(
        *keys(), "string_no", *r6("persistent_threshold"), "persistent_threshold_level",
        "persistent_event_alert", "persistent_collective_member_alert",
    )


@query(
    "persistent_events",
    f"""with {SQL_GROUPS},
pa as (
  select sc.plant, sc.dev, sc.s, g6.epoch, sc.c, g6.wmed,
    coalesce(g6.epoch - lag(g6.epoch) over (partition by sc.plant, sc.dev, sc.s order by g6.epoch) <> 300, true) as nw
  from sc join g6 using (plant, dev, slot)
  where coalesce(round(wmed - thr, 9) >= 0, false) and member and known and c > 0),
pr as (select *, sum(nw::int) over (partition by plant, dev, s order by epoch) as run from pa)
select plant::varchar as plant_id, dev::varchar as device_no, cast(s as integer) as string_no, min(epoch) as start_epoch, max(epoch) as end_epoch,
 count(*) as points, round(max(wmed), 6) as maximum_deficit, round(min(c), 6) as minimum_current from pr group by plant, dev, s, run""",
)
def persistent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_points(spark, sf_dir)
    groups = stage(persistent.group_deficits(scored, PERSISTENT), "persistent-groups")
    fitted, _ = persistent.fit_persistent(scored, PERSISTENT, groups)
    events = persistent.persistent_events(persistent.apply_persistent(scored, fitted, groups=groups))
    return events.select(
        "plant_id", "device_no", "string_no", epoch("start_time", "start_epoch"), epoch("end_time", "end_epoch"), "points",
        *r6("maximum_deficit", "minimum_current"),
    )


# --- weather ---------------------------------------------------------------

WEATHER = WeatherSettings(candidate_offsets_minutes=(0, 15), minimum_mapping_samples=50, mapping_bins=5)

SQL_ASOF = (
    SQL_SCALE
    + ","
    + SQL_WEATHER
    + """,
wo as (select 0 as off union all select 15),
wj as (
  select v.plant, v.dev, v.slot, v.epoch, v.g, v.peers, wo.off,
         arg_max(w.forecast_ghi, w.wt) as ghi, max(w.wt - wo.off * 60) as wt
  from vg v cross join wo left join wx w on w.plant = v.plant and w.wt - wo.off * 60 <= v.epoch and v.epoch - (w.wt - wo.off * 60) <= 900
  group by all),
wp as (select * from wj where g is not null and ghi is not null),
wr as (
  select *, rank() over (partition by plant, off order by ghi) + (count(*) over (partition by plant, off, ghi) - 1) / 2.0 as ra,
         rank() over (partition by plant, off order by g) + (count(*) over (partition by plant, off, g) - 1) / 2.0 as rb from wp),
ws as (select plant, off, count(*) as samples, corr(ra, rb) as rho from wr group by plant, off),
wb as (
  select plant, arg_max(off, struct_pack(r := coalesce(rho, -2), o := -off)) as off from ws where samples >= 50 group by plant),
wsel as (select ws.* from ws join wb using (plant, off)),
wc as (select wp.* from wp join wb using (plant, off)),
we as (select plant, unnest([quantile_cont(ghi, 0.2), quantile_cont(ghi, 0.4), quantile_cont(ghi, 0.6), quantile_cont(ghi, 0.8)]) as e from wc group by plant),
wd as (select distinct plant, e from we),
wn as (select c.plant, c.dev, c.slot, c.ghi, c.g, count(d.e) as bin from wc c left join wd d on c.plant = d.plant and d.e < c.ghi group by all),
wa as (select plant, bin, median(ghi) as ax, median(g) as ay0, count(*) as w from wn group by plant, bin),
wq as (select *, sum(w * ay0) over o as sy, sum(w) over o as sw from wa window o as (partition by plant order by ax rows unbounded preceding)),
wmin as (
  select i.plant, i.bin, i.ax, j.ax as jx, min((k.sy - j.sy + j.w * j.ay0) / (k.sw - j.sw + j.w)) as m
  from wq i join wq j on i.plant = j.plant and j.ax <= i.ax join wq k on i.plant = k.plant and k.ax >= i.ax group by all),
wanc as (select plant, bin, ax, max(m) as ay from wmin group by all)
"""
)


@query(
    "weather_asof",
    f"with {SQL_ASOF} select {KEYS_SQL}, round(ghi, 6) as forecast_ghi from wj where off = 0",
)
def weather_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, context = model(spark, sf_dir)
    joined = irradiance.attach_forecast(context, weather_table(spark, sf_dir), WEATHER, 0)
    return joined.select(*keys(), *r6("forecast_ghi"))


@query(
    "weather_offsets",
    f"""with {SQL_ASOF} select cast(plant as varchar) as plant_id, cast(off as integer) as source_offset_minutes, samples, round(rho, 6) as spearman from ws""",
)
def weather_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each offset of the forecast fits, for every plant."""
    _, context = model(spark, sf_dir)
    pairs = irradiance.weather_pairs(context, weather_table(spark, sf_dir), WEATHER)
    return irradiance.offset_correlations(pairs).select("plant_id", "source_offset_minutes", "samples", *r6("spearman"))


@query(
    "weather_map",
    f"""with {SQL_ASOF} select cast(plant as varchar) as plant_id, cast(w.off as integer) as source_offset_minutes, w.samples as samples,
 round(w.rho, 6) as spearman, round(a.ax, 6) as anchor_ghi, round(a.ay, 6) as anchor_g from wsel w join wanc a using (plant)""",
)
def weather_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, context = model(spark, sf_dir)
    fitted = irradiance.fit_weather_map(context, weather_table(spark, sf_dir), WEATHER)
    return fitted.select(
        "plant_id", "source_offset_minutes", "samples", *r6("spearman"), F.inline("anchors")
    ).withColumns({"anchor_ghi": F.round("anchor_ghi", 6), "anchor_g": F.round("anchor_g", 6)})


@query(
    "conditioned_irradiance",
    f"""with {SQL_ASOF},
wf as (
  select v.plant, v.dev, v.slot, v.epoch, v.g, v.peers, j.ghi from vg v left join wb using (plant)
  left join wj j on j.plant = v.plant and j.dev = v.dev and j.slot = v.slot and j.off = wb.off),
wl as (
  select f.plant, f.dev, f.slot, f.epoch, any_value(f.g) as g, any_value(f.peers) as peers, any_value(f.ghi) as ghi,
         max(a.ax) filter (where a.ax <= f.ghi) as x0, arg_max(a.ay, a.ax) filter (where a.ax <= f.ghi) as y0,
         min(a.ax) filter (where a.ax > f.ghi) as x1, arg_min(a.ay, a.ax) filter (where a.ax > f.ghi) as y1
  from wf f left join wanc a on a.plant = f.plant group by f.plant, f.dev, f.slot, f.epoch),
wm as (
  select *, case when ghi is null then null when x0 is null then y1 when x1 is null then y0
       else y0 + (y1 - y0) * (ghi - x0) / (x1 - x0) end as fc from wl),
wz as (select *, least(greatest(0.65 + 0.2 * (peers - 5) / 5.0, 0.65), 0.85) as w from wm)
select {KEYS_SQL}, round(fc, 6) as forecast_irradiance,
 round(case when g is not null and fc is not null then w * g + (1 - w) * least(greatest(fc, g * 0.8), g * 1.2) else coalesce(g, fc) end, 6) as conditioned_virtual_irradiance,
 cast(case when g is null and fc is not null then greatest(peers, 5) else peers end as integer) as conditioned_peer_count
from wz""",
)
def conditioned_irradiance(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, context = model(spark, sf_dir)
    weather = weather_table(spark, sf_dir)
    fitted = stage(irradiance.fit_weather_map(context, weather, WEATHER), "weather-map")
    return irradiance.condition_context(context, weather, fitted, SETTINGS, WEATHER).select(
        *keys(), *r6("forecast_irradiance", "conditioned_virtual_irradiance"), "conditioned_peer_count"
    )


@query(
    "continuation_alerts",
    f"""with recursive {SQL_PERSIST},
cseq as (
  select plant, dev, slot, s, epoch, iso, coalesce(r < rmed, false) as low,
         row_number() over (partition by plant, dev, s order by epoch) as i from p3),
cont as (
  select plant, dev, slot, s, epoch, i, iso or low as alive, case when iso then 1 else 0 end as n from cseq where i = 1
  union all
  select b.plant, b.dev, b.slot, b.s, b.epoch, b.i, b.iso or b.low,
         case when not (b.iso or b.low) then 0
              when a.alive and b.epoch - a.epoch = 300 and a.n > 0 then a.n + 1
              when b.iso then 1 else 0 end
  from cont a join cseq b on a.plant = b.plant and a.dev = b.dev and a.s = b.s and b.i = a.i + 1)
select {KEYS_SQL}, cast(s as integer) as string_no, cast(n >= 2 as integer) as continued_alert from cont""",
)
def continuation_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("residual_ratio") < F.col("residual_median")
    points = thresholds.add_continuation_alerts(
        scored_points(spark, sf_dir), F.col("isolated_raw_alert") == 1, low, 2, 5, "continued_alert"
    )
    return points.select(*keys(), "string_no", "continued_alert")


@query(
    "final_alert_strings",
    f"""with recursive {SQL_MEMORY} select {KEYS_SQL},
 string_agg(lpad(cast(s as varchar), 2, '0'), ',' order by s) as strings
 from mfin where fin group by plant, dev, epoch""",
)
def final_alert_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stringwatch.operators.compare import alerted_strings

    listed = alerted_strings(remembered(spark, sf_dir), F.col("final_alert"), "strings")
    return listed.select(*keys(), number_list(F.col("strings")).alias("strings"))
