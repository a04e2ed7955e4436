"""Streaming detectors against their batch versions, with shuffled input files."""

import datetime as dt
import glob
import os
import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stringwatch.config import EwmaSettings, LofSettings
from stringwatch.operators import ewma, memory, runs, strings
from stringwatch.streaming import detectors
from stringwatch.streaming.processors import Bucketed, EwmaProcessor, GapProcessor, MemoryProcessor
from stringwatch.streaming.watch import StreamWatch

START = dt.datetime(2026, 6, 1)


def as_stream(spark, frame, files=4, time=None):
    """Write time slices one after the other, rows shuffled, and stream them; ``time`` adds the end marker."""
    path = tempfile.mkdtemp(prefix="stringwatch-stream-")
    rows = sorted(frame.collect(), key=lambda r: r[0])
    size = -(-len(rows) // files)
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        random.Random(i).shuffle(part)
        spark.createDataFrame(part, frame.schema).coalesce(1).write.mode("append").parquet(path)
    if time is not None:
        detectors.end_marker(frame, time).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(stream, name, spark):
    path = tempfile.mkdtemp(prefix="stringwatch-check-")
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", path).trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.table(name)


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(4)
    rows = []
    for s in (1, 2):
        minute = 0
        for _ in range(60):
            minute += rng.choice([5] * 10 + [10])
            rows.append((START + dt.timedelta(minutes=minute), "p", "d", s, rng.random() < 0.6, rng.random() < 0.97))
    return spark.createDataFrame(
        rows, "event_time timestamp, plant_id string, device_no string, string_no int, raw boolean, ok boolean"
    )


def test_stateless_scores(spark):
    names = ["event_time", "plant_id", "device_no", "active_power", "rated_power"] + [f"string_current_{i:02d}" for i in range(1, 6)]
    rows = [(START, "p", "d", 50.0, 100.0, 10.0, 10.1, 9.9, 10.0, 4.0)]
    frame = spark.createDataFrame(rows, names)
    settings = LofSettings(n_neighbors=2, minimum_strings=4)
    got = drain(detectors.stream_scores(as_stream(spark, frame, 1), settings), "scores", spark)
    assert got.where("string_no = 5").first().lof_score == strings.score_strings(frame, settings).where("string_no = 5").first().lof_score


def test_memory_equals_batch(spark, points):
    detectors.use_state_store(spark)
    stream = detectors.stream_memory(as_stream(spark, points, time="event_time"), F.col("raw"), F.col("ok"), delay="10 minutes")
    got = {(r.string_no, r.event_time): (r.memory_active, r.memory_alert) for r in drain(stream, "memory", spark).collect()}
    batch = memory.add_memory(points, F.col("raw"), F.col("ok")).collect()
    expected = {(r.string_no, r.event_time): (r.memory_active, r.memory_alert) for r in batch}
    assert got == expected and len(got) == 120


def test_ewma_equals_batch(spark):
    detectors.use_state_store(spark)
    rng = random.Random(6)
    rows = [
        (START + dt.timedelta(minutes=5 * i), "d", 100.0, 50.0, 50.0 + rng.gauss(0, 5), 0.5 if rng.random() < 0.95 else 0.01)
        for i in range(60)
    ]
    frame = spark.createDataFrame(rows, list(ewma.RESIDUAL_COLUMNS))
    settings = EwmaSettings(center=0.0, scale=0.05)
    got = drain(detectors.stream_ewma(as_stream(spark, frame, time="target_time"), settings), "ewma", spark).collect()
    expected = {r.target_time: r.ewma_score for r in ewma.ewma_scores(ewma.prepare_residuals(frame, settings), settings).collect()}
    assert {r.target_time for r in got} == set(expected) and len(got) == 60
    for r in got:
        assert r.ewma_score == (None if expected[r.target_time] is None else pytest.approx(expected[r.target_time]))


def test_events_equal_batch(spark, points):
    alerts = points.where("raw")
    closed = drain(detectors.stream_events(as_stream(spark, alerts, time="event_time")), "events", spark).collect()
    batch = runs.collapse(points, runs.Timeline(("plant_id", "device_no", "string_no")), F.col("raw")).collect()
    every = {(r.string_no, r.start_time, r.end_time, r.points) for r in batch}
    assert {(r.string_no, r.start_time, r.end_time, r.points) for r in closed} == every


def test_silent_windows_are_reported(spark):
    detectors.use_state_store(spark)
    hours = {"a": [0, 1, 2, 3, 4, 5, 6], "b": [1, 4], "c": [3]}
    rows = [(START + dt.timedelta(hours=h, minutes=5 * i), "p", d) for d, hs in hours.items() for h in hs for i in range(12 - h)]
    frame = spark.createDataFrame(rows, "event_time timestamp, plant_id string, device_no string")
    got = drain(detectors.stream_gaps(as_stream(spark, frame, time="event_time")), "gaps", spark).collect()
    seen = {(r.device_no, int((r.window_start - START).total_seconds() // 3600)): (r.points, r.missing_points) for r in got}
    assert len(seen) == len(got)
    for device, hs in hours.items():
        for hour in range(min(hs), 7):
            points = 12 - hour if hour in hs else 0
            assert seen[device, hour] == (points, 12 - points)
        assert (device, min(hs) - 1) not in seen


@pytest.mark.parametrize("files", [1, 6])
def test_silence_longer_than_the_limit_is_reported(spark, files):
    detectors.use_state_store(spark)
    hours = {"a": [0, 1, 10, 11, 20], "b": range(21)}
    rows = [(START + dt.timedelta(hours=h), "p", d) for d, hs in hours.items() for h in hs]
    frame = spark.createDataFrame(rows, "event_time timestamp, plant_id string, device_no string")
    stream = detectors.stream_gaps(as_stream(spark, frame, files, "event_time"), silent_windows=3)
    got = drain(stream, f"long_gaps_{files}", spark).collect()
    seen = sorted((r.device_no, int((r.window_start - START).total_seconds() // 3600), r.points) for r in got)
    # three silent windows after the last point, then the device is no longer watched
    assert seen == [(d, h, int(h in hs)) for d, hs in hours.items() for h in range(24)]


def test_events_off_the_grid_and_repeated_equal_batch(spark):
    detectors.use_state_store(spark)
    rng, rows = random.Random(9), []
    for s in (1, 2, 3):
        at = START
        for _ in range(80):
            at += dt.timedelta(minutes=rng.choice([5, 5, 5, 4, 10]), microseconds=rng.choice([0, 0, 0, 0, 1, 999]))
            rows += [(at, "p", "d", s)] * rng.choice([1, 1, 1, 1, 2])
    alerts = spark.createDataFrame(rows, "event_time timestamp, plant_id string, device_no string, string_no int")
    closed = drain(detectors.stream_events(as_stream(spark, alerts, 5, "event_time")), "off_grid", spark).collect()
    batch = runs.collapse(alerts, runs.Timeline(("plant_id", "device_no", "string_no")), F.lit(True)).collect()
    # a run of one repeated point has the same start as the run before it, and a batch names both by it
    merged = {}
    for r in closed:
        end, points = merged.get((r.string_no, r.start_time), (r.end_time, 0))
        merged[r.string_no, r.start_time] = (max(end, r.end_time), points + r.points)
    assert merged == {(r.string_no, r.start_time): (r.end_time, r.points) for r in batch}
    assert len(closed) > 60


def test_repeated_and_missing_times_follow_the_rule(spark):
    """The second row of a time lies no interval after the first: it ends streaks and memory, and is one of its own."""
    detectors.use_state_store(spark)
    times = [0, 5, 5, 10, 15, 20, 20, 20, 25, None, None]
    rows = [(None if m is None else START + dt.timedelta(minutes=m), "p", "d", 1, True, True) for m in times]
    points = spark.createDataFrame(rows, "event_time timestamp, plant_id string, device_no string, string_no int, raw boolean, ok boolean")
    path = tempfile.mkdtemp(prefix="stringwatch-stream-")
    points.coalesce(1).write.mode("append").parquet(path)
    detectors.end_marker(points, "event_time").coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(path)
    stream = detectors.stream_memory(source, F.col("raw"), F.col("ok"))
    with StreamWatch(spark) as watch:
        query = stream.writeStream.format("memory").queryName("repeated").option(
            "checkpointLocation", tempfile.mkdtemp(prefix="stringwatch-check-")
        ).trigger(availableNow=True).start()
        query.awaitTermination(240)
        numbers = watch.of(query)
    got = sorted((r.event_time, r.memory_active, r.memory_alert) for r in spark.table("repeated").collect())
    want, last, streak, active = [], None, 0, False
    for minute in sorted(m for m in times if m is not None):
        if last is None or minute - last != 5:
            streak, active = 0, False
        streak, last = streak + 1, minute
        active = active or streak >= 3
        want.append((START + dt.timedelta(minutes=minute), int(active), int(active)))
    assert got == sorted(want)
    assert (numbers.input_rows, numbers.without_time, numbers.late) == (12, 2, 0)


def test_late_rows_are_counted(spark):
    """Rows inside the delay are used, rows behind the watermark of the batch before are dropped; each is accounted for."""
    detectors.use_state_store(spark)
    path, schema = tempfile.mkdtemp(prefix="stringwatch-stream-"), "event_time timestamp, plant_id string, device_no string, string_no int"
    batches = [[0, 5, 60], [50, 10, 15], [65, 5, 120], [70, 5, 10, 200]]  # delay 15: in the last two 5 and 10 come too late
    for number, minutes in enumerate(batches):
        rows = [(START + dt.timedelta(minutes=m), "p", "d", 1) for m in minutes]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{number}")
        os.utime(next(iter(glob.glob(f"{path}/{number}/*.parquet"))), (1_000 + number, 1_000 + number))
    whole = spark.read.schema(schema).parquet(f"{path}/*")
    detectors.end_marker(whole, "event_time").coalesce(1).write.mode("append").parquet(f"{path}/9")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    with StreamWatch(spark) as watch:
        query = detectors.stream_events(source, delay="15 minutes").writeStream.format("memory").queryName("late").option(
            "checkpointLocation", tempfile.mkdtemp(prefix="stringwatch-check-")
        ).trigger(availableNow=True).start()
        query.awaitTermination(240)
        numbers = watch.of(query)
    used = sum(r.points for r in spark.table("late").collect())
    assert numbers.late == 3 and used == 10
    assert numbers.input_rows == used + numbers.late + 1  # and the marker


def test_plants_that_share_a_model_plant_keep_apart(spark):
    detectors.use_state_store(spark)
    rows = [(START + dt.timedelta(minutes=5 * i), "m", p, "d", 1) for i in range(4) for p in ("a", "b")]
    alerts = spark.createDataFrame(rows, "event_time timestamp, plant_id string, source_plant_id string, device_no string, string_no int")
    closed = drain(detectors.stream_events(as_stream(spark, alerts, 2, "event_time")), "sources", spark).collect()
    assert sorted((r.source_plant_id, r.points) for r in closed) == [("a", 4), ("b", 4)]


def test_stateful_streams_set_their_state_store(spark, points):
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    closed = drain(detectors.stream_events(as_stream(spark, points.where("raw"), time="event_time")), "own_store", spark)
    assert closed.count() > 0


class CountedState:
    """A state variable of one key that counts its calls."""

    def __init__(self, calls, initial):
        self.calls, self.value = calls, initial

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "exists":
                return self.value is not None
            if name == "get":
                return self.value
            if name == "appendList":
                self.value = self.value + args[0]
            elif name == "update":
                self.value = args[0]
            else:
                assert name == "clear"
                self.value = [] if isinstance(self.value, list) else None

        return call


class CountedHandle:
    def __init__(self):
        self.calls, self.timers = [], set()

    def getListState(self, name, schema):
        return CountedState(self.calls, [])

    def getValueState(self, name, schema):
        return CountedState(self.calls, None)

    def registerTimer(self, at):
        self.calls.append("registerTimer")
        self.timers.add(at)


class Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


@pytest.mark.parametrize(
    "processor, values",
    [
        (MemoryProcessor(), {"raw": True, "evaluable": True}),
        (EwmaProcessor(0.3, 0.0, 1.0), {"underproduction_residual": 0.5, "ewma_eligible": True}),
        (GapProcessor(60), {}),
    ],
)
def test_state_is_asked_once_a_batch_not_once_a_row(processor, values):
    handle = CountedHandle()
    processor.init(handle)
    processor.output_schema("device_no string")
    rows = [{"time_us": i * 300_000_000, **values} for i in range(240)]
    list(processor.handleInputRows(("d",), iter(rows), Watermark(0)))
    out = []
    for at in sorted(handle.timers):
        out += processor.handleExpiredTimer(("d",), Watermark(72_000_000), None)
    assert len(out) == (240 if values else 20)
    assert len(handle.calls) <= 12


@pytest.mark.parametrize(
    "processor, values",
    [
        (MemoryProcessor(), {"raw": True, "evaluable": True}),
        (EwmaProcessor(0.3, 0.0, 1.0), {"underproduction_residual": 0.5, "ewma_eligible": True}),
        (GapProcessor(60), {}),
    ],
)
def test_state_is_asked_once_a_bucket_whatever_its_keys(processor, values):
    keys = [(f"d{d}", s) for d in range(50) for s in (1, None)]
    rows = [{"device_no": d, "string_no": s, "time_us": i * 300_000_000, **values} for i in range(24) for d, s in keys]
    handle, calls = CountedHandle(), {}
    bucketed = Bucketed(processor, "device_no string, string_no int")
    bucketed.init(handle)
    handle.getListState = handle.getValueState = None
    bucketed.waiting.__dict__["appendValue"] = lambda row: bucketed.waiting.appendList([row])
    random.Random(1).shuffle(rows)
    frame = pd.DataFrame(rows)
    list(bucketed.handleInputRows((0,), iter([frame[:700], frame[700:]]), Watermark(0)))
    for watermark in (3_600_000, 36_000_000):
        for at in sorted(t for t in handle.timers if t <= watermark)[:1]:
            for part in bucketed.handleExpiredTimer((0,), Watermark(watermark), None):
                for r in part.itertuples(index=False):
                    name = (r.device_no, None if r.string_no != r.string_no else int(r.string_no))
                    calls.setdefault(name, []).append(tuple(r)[2:])
    single = CountedHandle()
    processor.init(single)
    processor.output_schema("device_no string, string_no int")
    list(processor.handleInputRows(("d", 1), iter([r for r in rows if (r["device_no"], r["string_no"]) == ("d0", 1)]), Watermark(0)))
    want = [tuple(r)[2:] for w in (3_600_000, 36_000_000) for r in processor.handleExpiredTimer(("d", 1), Watermark(w), None)]
    assert set(calls) == set(keys) and all(found == want for found in calls.values()) and want
    assert len(handle.calls) <= 16
