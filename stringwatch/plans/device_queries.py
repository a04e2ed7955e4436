"""Queries on device rows: channels, completeness, reading, training features."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringwatch.functions.timegrid import local_date, local_text
from stringwatch.operators import channels, training
from stringwatch.operators.numbering import with_row_numbers
from stringwatch.operators.strings import row_eligible
from stringwatch.plans.driver_views import SQL_VIEWS, SQL_WEATHER, device_table, epoch, table, weather_table
from stringwatch.plans.registry import query
from stringwatch.plans.string_queries import SETTINGS
from stringwatch.sources import sinks, telemetry
from stringwatch.storage import stage, staging_path, staging_root

TZ = "Asia/Shanghai"
KEYS_SQL = "cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, epoch as event_epoch"


def keys():
    return "plant_id", "device_no", epoch("event_time", "event_epoch")


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


@query(
    "unpivoted_strings",
    f"""with {SQL_VIEWS} select {KEYS_SQL}, cast(s as integer) as string_no, round(c, 6) as string_current,
 cast(st as integer) as string_status from pts""",
)
def unpivoted_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = channels.unpivot_strings(device_table(spark, sf_dir), channels.configured)
    return long.select(*keys(), "string_no", *r6("string_current"), F.col("string_status").cast("int").alias("string_status"))


@query(
    "row_eligibility",
    f"""with {SQL_VIEWS} select {KEYS_SQL}, round(active_power / 100.0, 6) as active_power_ratio,
 cast(active_power / 100.0 between 0.1 and 1.1 and status_code in (1, 4) and valid_strings > 0 as integer) as eligible from meta""",
)
def row_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = device_table(spark, sf_dir).withColumn("active_power_ratio", F.col("active_power") / F.col("rated_power"))
    return rows.select(
        *keys(), *r6("active_power_ratio"), row_eligible(rows, SETTINGS).cast("int").alias("eligible")
    )


@query(
    "row_completeness",
    f"""with {SQL_VIEWS} select {KEYS_SQL}, 9 as current_expected_count, cast(valid_strings as integer) as current_finite_count,
 cast(valid_strings >= 9 as integer) as current_complete from meta""",
)
def row_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = device_table(spark, sf_dir).withColumn("main_string_count", F.lit(9))
    checked = channels.with_completeness(rows)
    return checked.select(
        *keys(), "current_expected_count", "current_finite_count",
        F.col("current_complete").cast("int").alias("current_complete"),
    )


@query(
    "unconfigured_blanked",
    f"""with {SQL_VIEWS} select {KEYS_SQL}, count(*) as channels, round(sum(c), 6) as total from pts where s <= 7
 group by plant, dev, epoch""",
)
def unconfigured_blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = channels.blank_unconfigured(device_table(spark, sf_dir).withColumn("main_string_count", F.lit(7)))
    long = channels.unpivot_strings(rows, lambda s: s["current"].isNotNull())
    return long.groupBy("plant_id", "device_no", epoch("event_time", "event_epoch")).agg(
        F.count(F.lit(1)).alias("channels"), F.round(F.sum("string_current"), 6).alias("total")
    )


@query(
    "channel_inventory",
    f"""with {SQL_VIEWS},
ch as (
  select plant, dev, s, count(*) filter (where st <> 0) as m, count(distinct (epoch + 28800) // 86400) filter (where st <> 0) as days from pts group by all)
select cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, cast(s as integer) as string_no,
 'status' as evidence, m as evidence_samples, days as evidence_days from ch where m >= 25 and days >= 3""",
)
def channel_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.channel_inventory(device_table(spark, sf_dir), 25, 3, TZ).select(
        "plant_id", "device_no", "string_no", "evidence", "evidence_samples", "evidence_days"
    )


@query(
    "channel_inventory_audit",
    f"""with {SQL_VIEWS},
ch as (
  select plant, dev, s from pts group by all having count(*) >= 25 and count(distinct (epoch + 28800) // 86400) >= 3)
select cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, cast(count(*) as integer) as configured_channels,
 12 as declared_count, cast(count(*) <> 12 as integer) as count_mismatch, cast(max(s) <> count(*) as integer) as noncontiguous
from ch group by plant, dev""",
)
def channel_inventory_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    devices = device_table(spark, sf_dir)
    return channels.inventory_audit(devices, channels.channel_inventory(devices, 25, 3, TZ))


@query(
    "partitioned_read_in_range",
    f"""with {SQL_VIEWS} select {KEYS_SQL}, round(active_power, 6) as active_power from meta
 where epoch >= {1_780_272_000 + 1_800} and epoch < {1_780_272_000 + 86_400 + 1_500}""",
)
def partitioned_read_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    # 2026-06-01 00:30 and 2026-06-02 00:25 UTC as local times
    path = f"{staging_root(spark)}/devices-{uuid.uuid4().hex}"
    rows = device_table(spark, sf_dir)
    sinks.write_partitioned(rows.unionByName(rows), path)
    read = telemetry.read_devices(spark, path, "2026-06-01 08:30:00", "2026-06-02 08:25:00", TZ)
    return read.select(*keys(), *r6("active_power"))


@query(
    "partitioned_read_report",
    f"""with {SQL_VIEWS} select cast(2 * count(*) as bigint) as rows_in_range, count(*) as duplicate_rows_removed,
 count(distinct dev) as devices from meta where epoch >= {1_780_272_000 + 86_400}""",
)
def partitioned_read_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{staging_root(spark)}/devices-{uuid.uuid4().hex}"
    rows = device_table(spark, sf_dir)
    sinks.write_partitioned(rows.unionByName(rows), path)
    report = telemetry.read_report(spark, path, "2026-06-02 08:00:00", "2026-12-31", TZ)
    return report.select("rows_in_range", "duplicate_rows_removed", "devices")


@query(
    "observed_read_report",
    f"""with {SQL_VIEWS} select cast((select 2 * count(*) from meta) as bigint) as rows_read, cast(2 * count(*) as bigint) as rows_in_range,
 count(*) as duplicate_rows_removed, count(distinct dev) as devices, sum(valid_strings) as kept_strings from meta where epoch >= {1_780_272_000 + 86_400}""",
)
def observed_read_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a read that also gives the rows; they are summed up beside it."""
    path = staging_path(spark, "devices")
    rows = device_table(spark, sf_dir).withColumn("main_string_count", F.col("valid_current_string_count"))
    sinks.write_partitioned(rows.unionByName(rows), path)
    read, report = telemetry.read_with_report(spark, path, "2026-06-02 08:00:00", "2026-12-31", TZ)
    return report.select("rows_read", "rows_in_range", "duplicate_rows_removed", "devices").join(
        read.agg(F.sum("main_string_count").alias("kept_strings"))  # two single rows
    )


@query(
    "damaged_files_report",
    f"""with {SQL_VIEWS} select count(*) as rows_read, count(*) as rows_in_range, cast(0 as bigint) as duplicate_rows_removed,
 count(distinct dev) as devices, cast(2 as bigint) as files_failed, 'part-broken.parquet,part-cut.parquet' as error_examples, cast(1 as bigint) as empty_files from meta""",
)
def damaged_files_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound files, an empty one, one without a footer and one of which half is left."""
    path = staging_path(spark, "damaged")
    rows = device_table(spark, sf_dir)
    rows.write.parquet(f"{path}/date=2026-06-01")
    rows.limit(0).coalesce(1).write.parquet(f"{path}/date=2026-06-02")
    files = spark._jvm.org.apache.hadoop.fs
    folder = files.Path(f"{path}/date=2026-06-03")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    one = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/date=2026-06-01").limit(1)
    content = bytes(one.first()["content"])
    system.mkdirs(folder)
    for name, part in (("part-broken.parquet", content[:64]), ("part-cut.parquet", content[: len(content) // 2])):
        target = system.create(files.Path(folder, name))
        target.write(bytearray(part))
        target.close()
    status = stage(telemetry.file_status(spark, path), "file-status")
    report = telemetry.read_report(spark, path, "2026-01-01", "2027-01-01", TZ)
    return report.join(status.agg(F.count_if(F.col("status") == "empty").alias("empty_files"))).select(
        "rows_read", "rows_in_range", "duplicate_rows_removed", "devices", "files_failed",
        F.array_join("error_examples", ",").alias("error_examples"), "empty_files",
    )


@query(
    "station_points",
    f"""with {SQL_VIEWS} select 'station-' || cast(plant as varchar) as station_name, cast(plant as varchar) as plant_id,
 cast(dev % 10 as varchar) as device_no, epoch as event_epoch, round(active_power, 6) as active_power from meta""",
)
def station_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written and read with the station of their own plant; device numbers repeat between plants."""
    path = staging_path(spark, "points")
    rows = device_table(spark, sf_dir).withColumn("device_no", (F.col("device_no").cast("long") % 10).cast("string"))
    sinks.write_partitioned(rows, path)
    devices = telemetry.device_set(rows).withColumn("station_name", F.concat(F.lit("station-"), "plant_id"))
    points = telemetry.read_points(spark, path, devices, devices.select("station_name", "plant_id").distinct())
    return points.select("station_name", *keys(), *r6("active_power"))

@query(
    "weather_merged_roots",
    f"""with {SQL_VIEWS},{SQL_WEATHER} select cast(plant as varchar) as plant_id, wt as event_epoch,
 round(forecast_ghi + case when plant % 2 = 0 then 1 else 0 end, 6) as forecast_ghi, round(sensor_ghi, 6) as sensor_ghi from wx""",
)
def weather_merged_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two roots, the second corrects the forecasts of every other plant."""
    path, weather = staging_path(spark, "weather"), weather_table(spark, sf_dir)
    weather.write.parquet(f"{path}/a")
    corrected = weather.where(F.col("plant_id").cast("int") % 2 == 0).withColumn("forecast_ghi", F.col("forecast_ghi") + 1)
    corrected.write.parquet(f"{path}/b")
    return telemetry.read_weather(spark, [f"{path}/a", f"{path}/b"]).select(
        "plant_id", epoch("time", "event_epoch"), *r6("forecast_ghi", "sensor_ghi")
    )


@query(
    "plant_day_rows",
    f"""with {SQL_VIEWS} select {KEYS_SQL}, round(active_power, 6) as active_power from meta
 where plant = 0 and (epoch + 28800) // 86400 - {1_780_272_000 // 86_400} in (0, 2)""",
)
def plant_day_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plant's partitions of two local days."""
    path = staging_path(spark, "devices")
    sinks.write_partitioned(device_table(spark, sf_dir), path)
    rows = telemetry.plant_rows(telemetry.read_partitioned(spark, path), "0", ["2026-06-01", "2026-06-03"])
    return rows.select(F.col("plant_id").cast("string").alias("plant_id"), "device_no", epoch("event_time", "event_epoch"), *r6("active_power"))


@query(
    "exported_days",
    f"""with {SQL_VIEWS} select strftime(to_timestamp(epoch + 28800)::timestamp, '%Y-%m-%d') as local_day, count(*) as rows,
 (select count(*) from meta where epoch + 28800 >= {1_780_272_000 + 86_400} and epoch + 28800 < {1_780_272_000 + 3 * 86_400}) as exported_rows
 from meta where epoch + 28800 >= {1_780_272_000 + 86_400} and epoch + 28800 < {1_780_272_000 + 3 * 86_400} group by 1""",
)
def exported_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of local days exported, counted in the written files and by the export itself."""
    result = sinks.export_dataset(
        device_table(spark, sf_dir), staging_path(spark, "export"), dt.date(2026, 6, 2), dt.date(2026, 6, 4), "event_time", TZ
    )
    written = spark.read.parquet(result["output"])
    return written.groupBy(F.col("date").cast("string").alias("local_day")).agg(
        F.count(F.lit(1)).alias("rows"), F.lit(result["exported_rows"]).cast("bigint").alias("exported_rows")
    )


@query(
    "export_manifest",
    f"""with {SQL_VIEWS}, {SQL_WEATHER.strip()},
mf as (
  select 'devices' as dataset, epoch from meta where epoch + 28800 >= {1_780_272_000 + 86_400} and epoch + 28800 < {1_780_272_000 + 5 * 86_400}
  union all select 'weather', wt from wx where wt + 28800 >= {1_780_272_000 + 86_400} and wt + 28800 < {1_780_272_000 + 3 * 86_400})
select dataset, strftime(to_timestamp(epoch + 28800)::timestamp, '%Y-%m-%d') as date, count(*) as rows,
 case when dataset = 'devices' and (epoch + 28800) // 86400 < {(1_780_272_000 + 4 * 86_400) // 86_400} then 2 else 1 end as exports, 1 as writes
from mf group by all""",
)
def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three exports into one manifest: devices, weather, and devices again with a day more; known days are not written again."""
    root, day = staging_path(spark, "exports"), dt.date(2026, 6, 2)
    devices = stage(device_table(spark, sf_dir), "devices")
    for frame, name, time, days in (
        (devices, "devices", "event_time", 3),
        (weather_table(spark, sf_dir), "weather", "time", 2),
        (devices, "devices", "event_time", 4),
    ):
        sinks.export_days(frame, f"{root}/{name}", f"{root}/manifest", name, day, day + dt.timedelta(days), time, TZ)
    return sinks.current_manifest(sinks.manifest_log(spark, f"{root}/manifest")).select("dataset", "date", "rows", "exports", "writes")


@query(
    "station_plants",
    "select distinct 'station-' || cast(s_suppkey // 10 as varchar) as station_name, cast(s_suppkey // 10 as varchar) as plant_id from supplier",
)
def station_plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The station mapping as a JSON object, written and read; one entry per station."""
    path = staging_path(spark, "stations")
    plant = F.floor(F.col("s_suppkey") / 10).cast("string")
    plants = table(spark, sf_dir, "supplier").select(plant.alias("plant_id")).distinct()
    pairs = F.collect_list(F.struct(F.concat(F.lit(" station-"), "plant_id"), "plant_id"))
    plants.agg(F.to_json(F.struct(F.map_from_entries(pairs).alias("station_to_plant_id")))).write.text(path)
    return telemetry.read_station_plants(spark, path)


@query(
    "report_tables",
    f"""with {SQL_VIEWS} select cast(plant as varchar) as plant_id, count(*) as rows, count(distinct dev) as devices from meta group by plant""",
)
def report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's table, read back from its CSV copy."""
    path = staging_path(spark, "report")
    counts = device_table(spark, sf_dir).groupBy("plant_id").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("device_no").alias("devices")
    )
    sinks.write_report(path, {"plants": counts}, {"metrics": counts})
    metrics = spark.read.schema(counts.schema).json(f"{path}/metrics.json").select("plant_id")
    return telemetry.read_any(spark, f"{path}/plants.csv").join(metrics, "plant_id", "left_semi").select(
        "plant_id", F.col("rows").cast("bigint").alias("rows"), F.col("devices").cast("bigint").alias("devices")
    )


@query(
    "csv_export_manifest",
    f"""with {SQL_VIEWS} select cast(plant as varchar) as plant_id, count(distinct (epoch + 28800) // 86400) as dates, count(*) as rows,
 min(epoch) as minimum_epoch, max(epoch) as maximum_epoch from meta group by plant""",
)
def csv_export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{staging_root(spark)}/csv-{uuid.uuid4().hex}"
    manifest = sinks.export_csv(device_table(spark, sf_dir), path, "event_time", TZ)
    return manifest.select("plant_id", "dates", "rows", epoch("minimum", "minimum_epoch"), epoch("maximum", "maximum_epoch"))


@query(
    "device_set",
    "select distinct cast(l_suppkey // 10 as varchar) as plant_id, cast(l_suppkey as varchar) as device_no from lineitem",
)
def device_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.device_set(device_table(spark, sf_dir))


@query(
    "bounded_sample",
    f"with {SQL_VIEWS} select {KEYS_SQL}, round(active_power, 6) as active_power from meta order by epoch, cast(plant as varchar), cast(dev as varchar) limit 100",
)
def bounded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry.sample(device_table(spark, sf_dir), ["event_time", "plant_id", "device_no"], 100)
    return rows.select(*keys(), *r6("active_power"))


@query(
    "plant_mapping",
    f"""with {SQL_VIEWS} select cast(plant as varchar) as source_plant_id, case plant when 3 then '0' when 5 then '1' else cast(plant as varchar) end as plant_id,
 count(*) as rows, cast(plant in (3, 5) as integer) as mapped from meta group by plant""",
)
def plant_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = telemetry.parse_plant_mapping(["3=0", "5:1"])
    return telemetry.plant_mapping_report(telemetry.apply_plant_mapping(device_table(spark, sf_dir), mapping))


@query(
    "plant_restoring",
    f"""with {SQL_VIEWS} select cast(plant as varchar) as plant_id,
 case plant when 3 then '0' when 5 then '1' else cast(plant as varchar) end as model_plant_id, count(*) as rows from meta group by plant""",
)
def plant_restoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = telemetry.apply_plant_mapping(device_table(spark, sf_dir), {"3": "0", "5": "1"})
    restored = telemetry.restore_plants(mapped)
    return restored.groupBy("plant_id", "model_plant_id").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "local_times",
    f"""with {SQL_VIEWS} select {KEYS_SQL}, strftime(to_timestamp(epoch + 28800)::timestamp, '%Y-%m-%d %H:%M:%S') as local_text,
 strftime(to_timestamp(epoch + 28800)::timestamp, '%Y-%m-%d') as local_day from meta""",
)
def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return device_table(spark, sf_dir).select(
        *keys(),
        local_text("event_time", TZ).alias("local_text"),
        local_date("event_time", TZ).cast("string").alias("local_day"),
    )


@query(
    "numbered_rows",
    f"with {SQL_VIEWS} select {KEYS_SQL}, row_number() over (order by epoch, cast(plant as varchar), cast(dev as varchar)) as row from meta",
)
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = with_row_numbers(device_table(spark, sf_dir), ["event_time", "plant_id", "device_no"])
    return numbered.select(*keys(), F.col("row").cast("long").alias("row"))


# --- training --------------------------------------------------------------

TRAINING = training.TrainingSettings(
    train_end="2026-06-02", validation_end="2026-06-03", test_end="2026-06-20", timezone="UTC", maximum_power_ratio=0.9
)


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device rows with DC power and a temperature that leaves its range at times."""
    rows = device_table(spark, sf_dir)
    return rows.select(
        "event_time",
        "plant_id",
        "device_no",
        "active_power",
        (F.col("active_power") * 1.05).alias("dc_power"),
        "rated_power",
        (F.col("active_power") * 1.6 - 10).alias("device_temperature"),
        "status_code",
    )


SQL_TRAINING = (
    SQL_VIEWS
    + """,
tq as (
  select *, active_power / 100.0 as ratio,
         status_code = 1 and active_power > 0 and active_power / 100.0 <= 0.9 and active_power * 1.6 - 10 between 0 and 80 as good,
         case epoch // 86400 - 20605 when 0 then 'train' when 1 then 'validation' else 'test' end as split from meta),
tn as (
  select *, lead(epoch) over w - epoch = 300 as nxt, lead(active_power) over w as np, lead(good) over w as ng, lead(split) over w as ns
  from tq window w as (partition by plant, dev order by epoch)),
tc as (
  select *, case when nxt then np end as target, coalesce(nxt and good and ng and split = ns, false) as cand from tn)
"""
)


@query(
    "training_quality",
    f"""with {SQL_TRAINING} select {KEYS_SQL}, split, round(target, 6) as target_active_power,
 cast(good as integer) as quality_point, cast(coalesce(nxt, false) as integer) as quality_continuity, cast(cand as integer) as candidate_normal from tc""",
)
def training_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training.add_quality_and_targets(training_rows(spark, sf_dir), TRAINING)
    return rows.select(
        *keys(), "split", *r6("target_active_power"),
        *[F.col(c).cast("int").alias(c) for c in ("quality_point", "quality_continuity", "candidate_normal")],
    )


@query(
    "training_quality_chunked",
    f"""with {SQL_TRAINING} select {KEYS_SQL}, round(target, 6) as target_active_power, cast(cand as integer) as candidate_normal from tc""",
)
def training_quality_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training.add_quality_and_targets(training_rows(spark, sf_dir), TRAINING, chunk_minutes=20)
    return rows.select(*keys(), *r6("target_active_power"), F.col("candidate_normal").cast("int").alias("candidate_normal"))


@query(
    "time_features",
    f"""with {SQL_VIEWS},
tf as (select *, 2 * pi() * ((epoch + 28800) % 86400 // 60) / 1440 as a, 2 * pi() * dayofyear(to_timestamp(epoch + 28800)::timestamp) / 365.25 as y from meta)
select {KEYS_SQL}, round(active_power / 100.0, 6) as active_power_ratio, round(active_power * 1.05 / 100.0, 6) as dc_power_ratio,
 round(sin(a), 6) as day_sin, round(cos(a), 6) as day_cos, round(sin(y), 6) as year_sin, round(cos(y), 6) as year_cos from tf""",
)
def time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training.add_time_features(training_rows(spark, sf_dir), TZ)
    return rows.select(
        *keys(), *r6("active_power_ratio", "dc_power_ratio", "day_sin", "day_cos", "year_sin", "year_cos")
    )


SQL_PEERS = (
    SQL_TRAINING
    + """,
pe as (
  select a.plant, a.dev, a.slot, count(b.dev) as peers, case when count(b.dev) >= 3 then median(b.ratio) end as pm
  from tc a left join tc b on a.plant = b.plant and a.slot = b.slot and a.dev <> b.dev group by a.plant, a.dev, a.slot),
pr as (
  select tc.*, peers, pm, case when tc.epoch - lag(tc.epoch) over w = 300 then pm - lag(pm) over w end as ramp
  from tc join pe using (plant, dev, slot) window w as (partition by tc.plant, tc.dev order by tc.epoch)),
bp as (
  select *, active_power as base, active_power + coalesce(ramp, 0) * 100.0 as phys from pr)
"""
)


def peer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training.add_quality_and_targets(training_rows(spark, sf_dir), TRAINING)
    return training.baseline_predictions(training.add_peer_power(rows))


@query(
    "peer_power_features",
    f"""with {SQL_PEERS} select {KEYS_SQL}, cast(peers as integer) as peer_count, round(pm, 6) as peer_median_power_ratio,
 cast(peers >= 3 as integer) as peer_power_available, round(ramp, 6) as peer_median_ramp_ratio from pr""",
)
def peer_power_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peer_rows(spark, sf_dir).select(
        *keys(), "peer_count", *r6("peer_median_power_ratio"),
        F.col("peer_power_available").cast("int").alias("peer_power_available"), *r6("peer_median_ramp_ratio"),
    )


@query(
    "baseline_predictions",
    f"""with {SQL_PEERS} select {KEYS_SQL}, round(base, 6) as baseline_prediction, round(target - base, 6) as baseline_residual,
 round(phys, 6) as peer_physical_prediction, round(target - phys, 6) as peer_physical_residual from bp""",
)
def baseline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peer_rows(spark, sf_dir).select(
        *keys(),
        *r6("baseline_prediction", "baseline_residual", "peer_physical_prediction", "peer_physical_residual"),
    )


@query(
    "baseline_metrics",
    f"""with {SQL_PEERS} select cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, count(*) as samples,
 round(avg(abs(base - target)), 6) as mae, round(sqrt(avg((base - target) * (base - target))), 6) as rmse, round(avg(base - target), 6) as bias,
 round(case when var_pop(target) > 0 then 1 - avg((base - target) * (base - target)) / var_pop(target) end, 6) as r2
 from bp where target is not null group by grouping sets ((plant, dev), (plant), ())""",
)
def baseline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = peer_rows(spark, sf_dir)
    metrics = training.regression_metrics(
        rows, "target_active_power", "baseline_prediction", (("plant_id", "device_no"), ("plant_id",), ())
    )
    return metrics.select("plant_id", "device_no", "samples", *r6("mae", "rmse", "bias", "r2"))


@query(
    "residual_audit",
    f"""with {SQL_PEERS},
ra as (
  select *, abs(target - phys) as e, abs(target - base) as b, round(ratio * 100, 9) as pc from bp where target is not null),
rb as (
  select *, case when pc >= 100 then '>100%' when pc >= 80 then '80-100%' when pc >= 60 then '60-80%' when pc >= 40 then '40-60%'
                 when pc >= 20 then '20-40%' when pc >= 10 then '10-20%' when pc >= 0 then '0-10%' end as bin from ra)
select cast(dev as varchar) as device_no, bin as power_bin, count(*) as samples, round(avg(e), 4) as model_mae, round(avg(b), 4) as baseline_mae,
 round(avg(e - b), 4) as mae_delta, round(avg((round(e, 9) < round(b, 9))::int), 4) as win_rate
from rb group by grouping sets ((dev, bin), (dev), (bin), ())""",
)
def residual_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = peer_rows(spark, sf_dir).where(F.col("target_active_power").isNotNull())
    # rounded, so that equal errors are equal on both engines
    rows = rows.select(
        "device_no",
        training.power_bin(F.col("active_power_ratio")).alias("power_bin"),
        F.round(F.abs("peer_physical_residual"), 9).alias("absolute_error"),
        F.round(F.abs("baseline_residual"), 9).alias("baseline_absolute_error"),
    )
    groups = (("device_no", "power_bin"), ("device_no",), ("power_bin",), ())
    audit = training.residual_audit(rows, groups)
    return audit.select(
        "device_no", "power_bin", "samples",
        *[F.round(c, 4).alias(c) for c in ("model_mae", "baseline_mae", "mae_delta", "win_rate")],
    )


@query(
    "residual_audit_by_day",
    f"""with {SQL_PEERS},
ra as (
  select plant, dev, strftime(to_timestamp(epoch + 28800)::timestamp, '%Y-%m-%d') as day, abs(target - phys) as e, abs(target - base) as b from bp where target is not null)
select cast(plant as varchar) as plant_id, cast(dev as varchar) as device_no, day as local_date, count(*) as samples, round(avg(e), 4) as model_mae,
 round(avg(b), 4) as baseline_mae, round(avg(e - b), 4) as mae_delta, round(avg((round(e, 9) < round(b, 9))::int), 4) as win_rate
from ra group by grouping sets ((plant, dev), (day), ())""",
)
def residual_audit_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By device of its plant, and by local date."""
    rows = peer_rows(spark, sf_dir).where(F.col("target_active_power").isNotNull())
    rows = rows.select(
        "plant_id", "device_no",
        local_date("event_time", TZ).cast("string").alias("local_date"),
        F.round(F.abs("peer_physical_residual"), 9).alias("absolute_error"),
        F.round(F.abs("baseline_residual"), 9).alias("baseline_absolute_error"),
    )
    audit = training.residual_audit(rows, (("plant_id", "device_no"), ("local_date",), ()))
    return audit.select(
        "plant_id", "device_no", "local_date", "samples",
        *[F.round(c, 4).alias(c) for c in ("model_mae", "baseline_mae", "mae_delta", "win_rate")],
    )


@query(
    "training_audit",
    f"""with {SQL_TRAINING},{SQL_WEATHER},
tw as (select tc.*, wx.sensor_ghi, wx.forecast_ghi, wx.wt from tc left join wx on wx.plant = tc.plant and wx.wt = tc.epoch // 900 * 900)
select split, count(*) as rows, count(distinct dev) as devices, count(*) filter (where not cand) as candidate_false_rows,
 count(*) filter (where status_code <> 1) as non_running_rows, count(*) filter (where active_power <= 0) as non_positive_power_rows,
 round_even(count(wt) * 100.0 / count(*), 4) as weather_matched_percent,
 round_even(count(*) filter (where sensor_ghi is null) * 100.0 / count(*), 4) as sensor_ghi_null_percent,
 cast(0 as bigint) as duplicate_input_keys from tw group by split""",
)
def training_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training.add_quality_and_targets(training_rows(spark, sf_dir), TRAINING)
    joined = training.attach_weather(rows, weather_table(spark, sf_dir), TRAINING)
    return training.training_audit(stage(joined, "training")).select(
        "split", "rows", "devices", "candidate_false_rows", "non_running_rows", "non_positive_power_rows",
        "weather_matched_percent", "sensor_ghi_null_percent",
        "duplicate_input_keys",
    )


@query(
    "feature_windows",
    f"""with {SQL_TRAINING},
fb as (
  select *, row_number() over g as rn, coalesce(epoch - lag(epoch) over g <> 300, true) as brk from tc
  window g as (partition by plant, dev order by epoch)),
fs as (
  select *, case when cand then rn - coalesce(max(case when not cand then rn when brk then rn - 1 end) over g, 0) else 0 end as streak,
         ratio + lag(ratio) over (partition by plant, dev order by epoch) + lag(ratio, 2) over (partition by plant, dev order by epoch) as total
  from fb window g as (partition by plant, dev order by epoch rows unbounded preceding))
select {KEYS_SQL}, 3 as length, round(total, 6) as total from fs where streak >= 3""",
)
def feature_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training.add_quality_and_targets(training_rows(spark, sf_dir), TRAINING)
    windows = training.feature_windows(rows, ["active_power_ratio"], 3)
    total = F.aggregate("sequence", F.lit(0.0), lambda s, x: s + x["active_power_ratio"])
    return windows.select(*keys(), F.size("sequence").alias("length"), F.round(total, 6).alias("total"))


@query(
    "feature_scaler",
    f"""with {SQL_TRAINING}, fr as (select * from tc where split = 'train')
 select 'active_power' as feature, round(avg(active_power), 6) as mean, round(stddev_pop(active_power), 6) as scale from fr
 union all select 'active_power_ratio', round(avg(ratio), 6), round(stddev_pop(ratio), 6) from fr""",
)
def feature_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training.add_quality_and_targets(training_rows(spark, sf_dir), TRAINING).where("split = 'train'")
    return training.fit_scaler(rows, ["active_power", "active_power_ratio"]).select("feature", *r6("mean", "scale"))


@query(
    "device_vocabulary",
    """with k as (select distinct cast(l_suppkey // 10 as varchar) || '::' || cast(l_suppkey as varchar) as device_key from lineitem)
 select device_key, row_number() over (order by device_key) - 1 as device_index from k""",
)
def device_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = device_table(spark, sf_dir).withColumn("device_key", F.concat_ws("::", "plant_id", "device_no"))
    return training.device_vocabulary(rows)


@query("power_model_predictions")
def power_model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-step forecast of a linear Spark ML model, fitted on the training split."""
    rows = stage(
        training.add_time_features(peer_rows(spark, sf_dir), TZ)
        .where(F.col("target_active_power").isNotNull())
        .fillna(0.0, ["peer_median_power_ratio"]),
        "model-rows",
    )
    features = ["active_power", "peer_median_power_ratio", "day_sin", "day_cos"]
    fitted = training.fit_power_model(rows.where("split = 'train'"), features)
    return fitted.transform(rows).select(*keys(), "target_active_power", "predicted_power")
