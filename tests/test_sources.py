"""Readers, writers, mapping, numbering and settings."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from stringwatch.config import (
    HierarchySettings,
    LofSettings,
    ResidualSettings,
    derive_persistence,
)
from stringwatch.operators import audit, channels, extract
from stringwatch.operators.numbering import with_event_ids
from stringwatch.sources import sinks, telemetry
from stringwatch.storage import stage


def folder():
    return tempfile.mkdtemp(prefix="stringwatch-test-") + "/out"


def devices(spark, hours=40, extra=()):
    start = dt.datetime(2026, 7, 14, 16)
    rows = [(start + dt.timedelta(hours=i), 1, "a", 1.0 * i, 5.0) for i in range(hours)] + list(extra)
    return spark.createDataFrame(rows, "event_time timestamp, plant_id int, device_no string, string_current_01 double, active_power double")


def test_partitioned_round_trip_and_range(spark):
    path = folder()
    sinks.write_partitioned(devices(spark), path)
    with pytest.raises(Exception, match="already exists"):
        sinks.write_partitioned(devices(spark), path)
    day = telemetry.read_devices(spark, path, "2026-07-15", "2026-07-16")
    assert day.count() == 24 and dict(day.dtypes)["plant_id"] == "string"
    # an end with a time of day keeps the partition of that day
    assert telemetry.read_devices(spark, path, "2026-07-15", "2026-07-16 03:00:00").count() == 27
    with pytest.raises(ValueError, match="later"):
        telemetry.read_devices(spark, path, "2026-07-16", "2026-07-15")
    assert telemetry.plant_rows(spark.read.parquet(path), "1", ["2026-07-16"]).count() == 16


def test_duplicates_keep_the_last_row(spark):
    path = folder()
    rows = devices(spark, 3)
    rows.unionByName(rows.withColumn("active_power", F.lit(7.0))).coalesce(1).write.parquet(path)
    read = telemetry.read_devices(spark, path, "2026-07-15", "2026-07-17")
    assert [r.active_power for r in read.collect()] == [7.0] * 3
    report = telemetry.read_report(spark, path, "2026-07-15", "2026-07-17").first()
    assert (report.rows_in_range, report.duplicate_rows_removed, report.devices, report.files_read) == (6, 3, 1, 1)


def test_corrupt_files_are_reported(spark):
    path = folder()
    devices(spark, 2).coalesce(1).write.parquet(path)
    with open(f"{path}/broken.parquet", "wb") as f:
        f.write(b"not parquet at all")
    failed = [r.path.rsplit("/", 1)[-1] for r in telemetry.failed_files(spark, path).collect()]
    assert failed == ["broken.parquet"]


def test_damaged_pages_are_not_lost_without_a_trace(spark):
    import glob

    path = folder()
    frame = spark.range(200_000).select(
        F.timestamp_seconds(F.lit(1_784_073_600) + F.col("id")).alias("event_time"), F.lit("1").alias("plant_id"),
        F.lit("a").alias("device_no"), F.rand(1).alias("active_power"),
    )
    frame.coalesce(1).write.parquet(path)
    frame.limit(0).coalesce(1).write.mode("append").parquet(path)
    content = max((open(f, "rb").read() for f in glob.glob(f"{path}/*.parquet")), key=len)
    with open(f"{path}/part-zeros.parquet", "wb") as f:
        f.write(content[:600_000] + bytes(200_000) + content[800_000:])
    status = {r.status: r for r in telemetry.file_status(spark, path).collect()}
    assert set(status) == {"intact", "damaged", "empty"}
    assert status["damaged"].footer_rows == 200_000 > status["damaged"].read_rows
    report = telemetry.read_report(spark, path, "2026-01-01", "2027-01-01").first()
    assert (report.files_selected, report.files_failed, report.error_examples) == (3, 1, ["part-zeros.parquet"])
    with pytest.raises(Exception):
        telemetry.read_devices(spark, path, "2026-01-01", "2027-01-01").count()


def test_export_counts_and_limits(spark):
    frame = devices(spark)
    result = sinks.export_dataset(frame, folder(), dt.date(2026, 7, 15), dt.date(2026, 7, 17), "event_time")
    assert result["exported_rows"] == 40
    assert spark.read.parquet(result["output"]).select("date").distinct().count() == 2
    one = sinks.export_dataset(frame, folder(), dt.date(2026, 7, 15), dt.date(2026, 7, 17), "event_time", plant_id="1")
    assert one["output"].endswith("plant_id=1")
    with pytest.raises(ValueError, match="31 days"):
        sinks.local_date_range(dt.date(2026, 1, 1), dt.date(2026, 3, 1))
    assert sinks.local_date_range(dt.date(2026, 1, 1), dt.date(2026, 3, 1), None)[1] == "2026-03-01T00:00:00"
    with pytest.raises(ValueError, match="plant_id"):
        sinks.export_dataset(frame.drop("plant_id"), folder(), dt.date(2026, 7, 15), dt.date(2026, 7, 16), "event_time", plant_id="1")


def test_csv_export_checks_times(spark):
    manifest = sinks.export_csv(devices(spark), folder(), "event_time").first()
    assert (manifest.dates, manifest.rows) == (2, 40)
    bad = devices(spark, 2, [(None, 1, "a", 1.0, 1.0)])
    with pytest.raises(Exception, match="no valid event_time"):
        sinks.export_csv(bad, folder(), "event_time")
    first, second = folder(), folder()
    devices(spark, 1).write.parquet(first)
    devices(spark, 1).drop("active_power").write.parquet(second)
    with pytest.raises(ValueError, match="not those of the first"):
        sinks.check_same_schema(spark, [first, second])


def test_models_and_reports(spark):
    path = folder()
    table = spark.createDataFrame([("a", [1, 2])], "k string, v array<int>")
    settings = LofSettings(threshold=1.5)
    sinks.save_model(spark, path, settings, {"scales": table})
    assert sinks.load_settings(spark, path, LofSettings) == settings
    assert sinks.load_table(spark, path, "scales").collect() == table.collect()
    with pytest.raises(ValueError, match="holds LofSettings"):
        sinks.load_settings(spark, path, ResidualSettings)
    sinks.write_report(folder(), {"events": table}, {"metrics": table})
    assert '"k": "a"' in sinks.as_json(table)


def test_plant_mapping(spark):
    assert telemetry.parse_plant_mapping(["33=234", "70:892"]) == {"33": "234", "70": "892"}
    with pytest.raises(ValueError, match="Conflicting mappings"):
        telemetry.parse_plant_mapping(["33=234", "33=791"])
    frame = spark.createDataFrame([(33, "a"), (33, "b"), (791, "c")], ["plant_id", "device_no"])
    mapped = telemetry.apply_plant_mapping(frame, {"33": "234"})
    assert sorted((r.source_plant_id, r.plant_id) for r in mapped.collect()) == [("33", "234"), ("33", "234"), ("791", "791")]
    rows = telemetry.restore_plants(mapped).collect()
    assert sorted((r.plant_id, r.model_plant_id, r.device_no) for r in rows) == [("33", "234", "a"), ("33", "234", "b"), ("791", "791", "c")]
    with pytest.raises(ValueError):
        telemetry.restore_plants(mapped.drop("source_plant_id"))


def test_stations_of_devices_with_the_same_number(spark):
    path = folder()
    rows = [("1", "a", 1), ("2", "a", 2), ("2", "b", 3)]
    points = spark.createDataFrame(rows, "plant_id string, device_no string, v int")
    points.withColumn("event_time", F.timestamp_seconds("v")).write.parquet(path)
    manifest = spark.createDataFrame([("one", "a"), ("two", " a "), ("two", "b")], "station_name string, device_no string")
    stations = spark.createDataFrame([("one ", "1"), ("two", "2")], "station_name string, plant_id string")
    got = telemetry.read_points(spark, path, manifest, stations).collect()
    assert sorted((r.v, r.station_name) for r in got) == [(1, "one"), (2, "two"), (3, "two")]
    with pytest.raises(Exception, match="several stations list device a"):
        telemetry.read_points(spark, path, manifest).collect()
    assert telemetry.read_points(spark, path, manifest.where("station_name = 'two'")).count() == 3


def test_json_inputs(spark):
    base = tempfile.mkdtemp(prefix="stringwatch-json-")
    for name, text in {
        "a.json": '{"one": ["x", "y"], "two": ["z"]}',
        "b.json": '{"station_to_plant_id": {" one ": 1, "two": 2}}',
        "c.jsonl": '{"k": 1}\n{"k": 2}\n',
        "d.csv": "k\n1\n",
    }.items():
        with open(f"{base}/{name}", "w") as f:
            f.write(text)
    manifest = telemetry.read_manifest(spark, f"{base}/a.json")
    assert manifest.count() == 3 and manifest.select("station_name").distinct().count() == 2
    stations = {r.station_name: r.plant_id for r in telemetry.read_station_plants(spark, f"{base}/b.json").collect()}
    assert stations == {"one": "1", "two": "2"}
    assert telemetry.read_any(spark, f"{base}/c.jsonl").count() == 2
    assert telemetry.read_any(spark, f"{base}/d.csv").count() == 1
    with pytest.raises(ValueError):
        telemetry.read_any(spark, "x.xls")


def test_weather_roots_are_merged(spark):
    roots = []
    for v in (1.0, 2.0):
        path = folder()
        spark.createDataFrame([(dt.datetime(2026, 6, 1), 5, v)], "time timestamp, plant_id int, forecast_ghi double").write.parquet(path)
        roots.append(path)
    assert telemetry.read_weather(spark, roots).count() == 1


def test_event_ids_are_sequential(spark):
    frame = spark.range(0, 500).select((F.col("id") * 7 % 500).alias("k"))
    rows = with_event_ids(frame, ["k"], "event").orderBy("k").collect()
    assert [r.event_id for r in rows] == [f"event-{i + 1:06d}" for i in range(500)]


def test_inventory_prefers_status_and_keeps_holes(spark):
    rows = [
        (dt.datetime(2026, 6, 1, 4) + dt.timedelta(minutes=5 * i), "p", "d", 2, 5.0, 0.0, 5.0, 1, 0, None) for i in range(4)
    ]
    names = "event_time timestamp, plant_id string, device_no string, main_string_count int, string_current_01 double, string_current_02 double, string_current_05 double, string_status_01 int, string_status_02 int, string_status_05 int"
    frame = spark.createDataFrame(rows, names)
    found = channels.channel_inventory(frame)
    assert sorted((r.string_no, r.evidence) for r in found.collect()) == [(1, "status"), (5, "current")]
    row = channels.inventory_audit(frame, found).first()
    assert (row.configured_channels, row.count_mismatch, row.noncontiguous) == (2, 0, 1)


def test_variants_keep_thresholds(spark):
    base = ResidualSettings(lof_threshold=2.0)
    hierarchy = HierarchySettings()
    new_base, new_hierarchy = derive_persistence(base, hierarchy, 3, "b", "h")
    assert (new_base.minimum_consecutive, new_base.lof_threshold, new_hierarchy.version) == (3, 2.0, "h")
    with pytest.raises(ValueError):
        derive_persistence(base, hierarchy, 1, "b", "h")
    with pytest.raises(ValueError):
        derive_persistence(base, hierarchy.derive(interval_minutes=15), 3, "b", "h")


@pytest.mark.parametrize("chunk", [7, 1440])
def test_continuity_counts(spark, chunk):
    minutes = [0, 5, 5, 10, 25, 28, 40]
    frame = spark.createDataFrame([("d", m) for m in minutes], "device_no string, m int").select(
        "device_no", F.timestamp_seconds(F.col("m") * 60).alias("event_time")
    )
    row = audit.continuity(frame, ["device_no"], chunk_minutes=chunk).first()
    assert (row.rows, row.duplicate_rows, row.gap_segments, row.short_or_irregular_intervals) == (7, 1, 2, 1)
    # 15 minutes lose two points; 12 minutes round to 2 steps and lose one
    assert row.estimated_missing_points == 3
    with pytest.raises(ValueError):
        audit.continuity(frame, interval_minutes=0)


def test_stage_reads_back(spark):
    assert stage(spark.range(5)).count() == 5


def test_exports_keep_a_manifest(spark, tmp_path):
    """A repeated export writes nothing; a changed day is replaced, one without rows goes."""
    start, folder, log = dt.date(2026, 6, 1), f"{tmp_path}/out", f"{tmp_path}/manifest"
    times = [dt.datetime(2026, 6, d, h) for d in (1, 2, 3) for h in (1, 2)]
    frame = spark.createDataFrame([(t, "p", float(t.day)) for t in times], "event_time timestamp, plant_id string, v double")

    def export(rows):
        return {r.date: r.written for r in sinks.export_days(rows, folder, log, "devices", start, dt.date(2026, 6, 4), "event_time", "UTC").collect()}

    assert export(frame) == {"2026-06-01": True, "2026-06-02": True, "2026-06-03": True}
    files = sorted(p.name for p in tmp_path.glob("out/*/*.parquet"))
    assert export(frame.repartition(3)) == {"2026-06-01": False, "2026-06-02": False, "2026-06-03": False}
    assert sorted(p.name for p in tmp_path.glob("out/*/*.parquet")) == files
    other = frame.where("day(event_time) < 3").withColumn("v", F.when(F.dayofmonth("event_time") == 2, -1.0).otherwise(F.col("v")))
    assert export(other) == {"2026-06-01": False, "2026-06-02": True, "2026-06-03": True}
    assert sorted(r.v for r in spark.read.parquet(folder).collect()) == [-1.0, -1.0, 1.0, 1.0]
    current = {r.date: (r.rows, r.exports, r.writes) for r in sinks.current_manifest(sinks.manifest_log(spark, log)).collect()}
    assert current == {"2026-06-01": (2, 3, 1), "2026-06-02": (2, 3, 2), "2026-06-03": (0, 3, 2)}


def test_only_labelled_days_are_read(spark, tmp_path):
    times = [dt.datetime(2026, 6, d, 4) for d in range(1, 21)]
    rows = spark.createDataFrame([(t, p, "d", 1.0) for t in times for p in ("1", "2")], "event_time timestamp, plant_id string, device_no string, v double")
    sinks.write_partitioned(rows, f"{tmp_path}/rows", timezone="UTC")
    scan = spark.read.schema("event_time timestamp, device_no string, v double, plant_id string, date date").parquet(f"{tmp_path}/rows")
    labels = spark.createDataFrame([(times[4], "1", "d", 7), (times[6], "2", "x", 8)], "event_time timestamp, plant_id string, device_no string, alarm_event_id int")
    found = extract.rows_of_label_days(scan, labels, "2026-06-01", "2026-06-30", "UTC")
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.plant_id, r.event_time.day) for r in found.collect()) == [("1", 5), ("2", 7)]
    assert [r.alarm_event_id for r in extract.label_currents(found, labels).collect()] == [7]


def test_rows_and_report_of_one_read(spark, tmp_path):
    times = [dt.datetime(2026, 6, d, 4) for d in range(1, 5)]
    rows = spark.createDataFrame([(t, "1", "d", float(t.day)) for t in times], "event_time timestamp, plant_id string, device_no string, active_power double")
    sinks.write_partitioned(rows.unionByName(rows), f"{tmp_path}/rows", timezone="UTC")
    read, report = telemetry.read_with_report(spark, f"{tmp_path}/rows", "2026-06-02", "2026-06-04", "UTC")
    old = telemetry.read_report(spark, f"{tmp_path}/rows", "2026-06-02", "2026-06-04", "UTC").first()
    new = report.first()
    assert sorted(r.active_power for r in read.collect()) == [2.0, 3.0]
    assert (new.rows_in_range, new.duplicate_rows_removed, new.devices) == (old.rows_in_range, old.duplicate_rows_removed, old.devices) == (4, 2, 1)
    assert new.files_selected == new.files_with_rows == old.files_read and new.rows_read == old.rows_read == 8


def test_device_sketches_of_days_unite(spark):
    rows = spark.range(60_000).selectExpr(
        "if(id < 59000, 'a', 'b') as plant_id", "cast(id % 20000 as string) as device_no", "timestamp_seconds(1780272000 + id % 5 * 86400) as event_time"
    )
    days = stage(audit.plant_days(rows), "days")
    found = {r.plant_id: r for r in audit.overview_of_days(days).collect()}
    assert (found["a"].document_count, found["b"].document_count) == (59_000, 1_000)
    assert abs(found["a"].unique_devices_estimate - 20_000) < 0.04 * 20_000 and abs(found["b"].unique_devices_estimate - 1_000) < 40
    one, rest = days.where("local_date <= '2026-06-02'"), days.where("local_date > '2026-06-02'")
    again = {r.plant_id: r.unique_devices_estimate for r in audit.overview_of_days(one.unionByName(rest)).collect()}
    assert again == {p: r.unique_devices_estimate for p, r in found.items()}


def test_csv_export_writes_one_file_a_plant_day(spark, tmp_path):
    rows = spark.range(400).repartition(8).selectExpr(
        "cast(id % 5 as string) as plant_id", "timestamp_seconds(1780272000 + id % 4 * 86400 + id) as event_time", "id as value"
    )
    manifest = sinks.export_csv(rows, str(tmp_path / "csv"), "event_time", "UTC")
    assert {(r.plant_id, r.dates, r.rows) for r in manifest.collect()} == {(str(p), 4, 80) for p in range(5)}
    assert len(list(tmp_path.rglob("*.csv"))) == 20
