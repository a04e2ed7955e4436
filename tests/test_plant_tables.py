"""Packages per plant: reading, drift, numbers over all plants, the report."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stringwatch.operators import compare
from stringwatch.plans import gate_queries
from stringwatch.sources import plant_tables

DDL = "row bigint, event_id string, comparison_case string"


def write(folder, plant, lines, name="events.csv"):
    target = folder / f"plant_id={plant}"
    target.mkdir(parents=True, exist_ok=True)
    (target / name).write_text("\n".join(lines) + "\n")


def test_plants_are_combined_in_order(spark, tmp_path):
    write(tmp_path, "10", ["row,event_id,comparison_case", "2,e2,both_same", "1,e1,left_only"])
    write(tmp_path, "007", ["row,event_id,comparison_case", "1,e1,right_only"])
    write(tmp_path, "007", ["other,columns", "1,2"], "points.csv")
    write(tmp_path, "9", ["row,event_id,comparison_case"])  # a plant without rows
    tables = plant_tables.read_plant_tables(spark, str(tmp_path), DDL, "events.csv")
    rows = plant_tables.combine_plant_tables(tables).orderBy("row").collect()
    assert [(r.row, r.plant_id, r.event_id) for r in rows] == [(1, "007", "plant-007-e1"), (2, "10", "plant-10-e1"), (3, "10", "plant-10-e2")]


def test_drift_and_missing_plants_fail(spark, tmp_path):
    write(tmp_path / "a", "1", ["row,event_id,comparison_case", "1,e,both_same"])
    write(tmp_path / "a", "2", ["row,comparison_case,event_id", "1,both_same,e"])
    with pytest.raises((PySparkException, Py4JJavaError)):
        plant_tables.read_plant_tables(spark, str(tmp_path / "a"), DDL).collect()
    (tmp_path / "b").mkdir()
    with pytest.raises(FileNotFoundError):
        plant_tables.read_plant_tables(spark, str(tmp_path / "b"), DDL)
    with pytest.raises(FileNotFoundError):
        plant_tables.read_plant_tables(spark, str(tmp_path / "a"), DDL, "points.csv")


def test_numbers_of_each_plant(spark, tmp_path):
    rows = [(p, t) for p in ("b", "a", "c") for t in range({"a": 5, "b": 1, "c": 40}[p])]
    frame = plant_tables.numbered_by_plant(spark.createDataFrame(rows, "plant_id string, t int").repartition(7), ["t"])
    assert sorted((r.plant_id, r.t, r.row) for r in frame.collect()) == sorted((p, t, t + 1) for p, t in rows)
    plant_tables.write_plant_tables(frame, f"{tmp_path}/out")
    again = plant_tables.read_plant_tables(spark, f"{tmp_path}/out", "t int, row bigint")
    assert plant_tables.combine_plant_tables(again).agg(F.max("row")).first()[0] == 46


def test_filtered_strings_derive_the_drop(spark):
    schema = "plant_id string, device_no string, event_time timestamp, string_no int, alert int, expected_current double, string_current double"
    frame = spark.sql("select '1' as plant_id, 'd' as device_no, timestamp '2026-01-01' as event_time, id + 1 as n from range(3)").selectExpr(
        "plant_id", "device_no", "event_time", "cast(n as int) as string_no", "int(n < 3) as alert", "10.0D as expected_current", "double(n) as string_current"
    )
    assert [f.name for f in frame.schema] == [c.split()[0] for c in schema.split(", ")]
    second = frame.withColumn("alert", F.when(F.col("string_no") == 2, 1))
    found = compare.filtered_strings(frame, second, "alert", ["isolated_absolute_drop", "missing"]).collect()
    assert [(r.string_no, r.isolated_absolute_drop) for r in found] == [(1, 9.0)]


def test_report_has_every_plant_and_the_sum(spark):
    cases = spark.createDataFrame([("1", "both_same"), ("1", "left_only"), ("2", "right_only")], "plant_id string, comparison_case string")
    filtered = spark.createDataFrame([("1",), ("3",)], "plant_id string")
    report = {r.plant_id: r for r in compare.plant_report(cases.where("plant_id = '1'"), cases, filtered).collect()}
    assert set(report) == {"1", "2", None}
    assert (report["1"].events, report["1"].events_only, report["1"].filtered_strings) == (2, 1, 1)
    assert (report["2"].events, report["2"].points, report["2"].points_only) == (0, 1, 1)
    assert (report[None].points, report[None].filtered_strings) == (3, 2)


def test_only_packages_that_are_read_are_written(spark, monkeypatch):
    written, write = [], plant_tables.write_plant_tables

    def recorded(frame, path):
        written.append(path.rsplit("/", 1)[1])
        write(frame, path)

    monkeypatch.setattr(plant_tables, "write_plant_tables", recorded)
    gate_queries.combined_plant_tables(spark, "/root/testdata/sf0.001")
    assert written == ["events"]
    assert set(gate_queries.plant_packages(spark, "/root/testdata/sf0.001")) == {"events", "points", "filtered"}
