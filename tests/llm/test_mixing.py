"""Poisson replication against SQL and the Poisson distribution."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stringwatch.llm import mixing
from stringwatch.llm.queries import LLM_CHECKS, LLM_QUERIES

SMALL = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    got = LLM_QUERIES["op8_source_mixing"](spark, SMALL)
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    want = connection.sql(LLM_CHECKS["op8_source_mixing"]).df()
    rows = got.toPandas()
    assert rows["shuffle_key"].is_monotonic_increasing
    order = sorted(rows.columns)
    both = [f[order].sort_values(order).reset_index(drop=True).astype(str) for f in (rows, want)]
    pd.testing.assert_frame_equal(*both)


@pytest.fixture(scope="module")
def alarms(spark):
    station = F.when(F.col("id") % 3 > 0, "big").when(F.col("id") % 9 == 0, None).otherwise("small")
    return spark.range(9000).select(
        F.col("id").alias("alarm_event_id"), station.alias("station_name"), F.concat(F.lit("alarm "), "id").alias("alarm_name"),
        F.lit("mine").alias("copy_no"),
    )


def test_sources_reach_their_shares(spark, alarms):
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0), (None, 2.0), ("unseen", 7.0)], "station_name string, weight double")
    mixed = mixing.mix_alarm_sources(alarms, weights, epochs=2.0)
    assert mixed.columns == ["alarm_event_id", "station_name", "alarm_name", "copy_no", "shuffle_key"]
    shares = {r.station_name: r.n / 18000 for r in mixed.groupBy("station_name").agg(F.count("*").alias("n")).collect()}
    assert shares["big"] == pytest.approx(0.25, abs=0.02)
    assert shares["small"] == pytest.approx(0.25, abs=0.02)
    assert shares[None] == pytest.approx(0.5, abs=0.03)


def test_copies_are_poisson(spark, alarms):
    weights = spark.createDataFrame([("big", 2.0), ("small", 1.0), (None, 0.0)], "station_name string, weight double")
    mixed = mixing.mix_alarm_sources(alarms, weights, ordered=False)
    numbers = mixed.where("station_name = 'big'").groupBy("alarm_event_id").count().toPandas()["count"]
    seen = np.bincount(numbers, minlength=8)
    seen[0] = 6000 - len(numbers)
    expected = 6000 * np.exp(-1.0) / np.array([1, 1, 2, 6, 24])
    assert np.abs(seen[:5] - expected).max() < 4 * np.sqrt(6000 * 0.25)
    assert mixed.where("station_name is null").count() == 0


def test_large_means_are_sums_of_draws(spark):
    few = spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], "alarm_event_id long, station_name string, alarm_name string")
    weights = spark.createDataFrame([("a", 1.0)], "station_name string, weight double")
    number = mixing.mix_alarm_sources(few, weights, epochs=1200.0, ordered=False).count()
    assert abs(number - 2400) < 5 * np.sqrt(2400)


def test_empty_nulls_and_repeats(spark, alarms):
    weights = spark.createDataFrame([("big", 1.0)], "station_name string, weight double")
    assert mixing.mix_alarm_sources(alarms.limit(0), weights).count() == 0
    rows = [(None, "big", None), (None, "big", "a"), (7, "big", "a"), (7, "big", "a")]
    odd = spark.createDataFrame(rows, "alarm_event_id long, station_name string, alarm_name string")
    mixed = mixing.mix_alarm_sources(odd, weights, epochs=30.0)
    of_repeated = mixed.where("alarm_event_id = 7").groupBy("copy_no").count().collect()
    assert of_repeated and all(r["count"] == 2 for r in of_repeated)
    assert mixing.mix_alarm_sources(alarms, weights.limit(0)).count() == 0
