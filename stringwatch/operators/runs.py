"""Exact-interval runs: previous row, streaks and events.

A run continues only where the previous row of the same key lies exactly one
interval earlier. Because of that everything about a run follows from *times*:
the length at a row is (time - start of run) / interval + 1, and a run is named
by its start. So two primitives carry all of it: the previous row, and the
latest time at which a condition held.

Rows must be unique per key and time (the readers see to it). A key then holds
at most span / interval rows. Where that bound is not good enough, for raw
event streams or very long histories, ``chunk_minutes`` splits every key into
time chunks that are processed independently and then joined with one carried
row per chunk, so that a key with a large share of all rows is spread out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stringwatch.functions.timegrid import MICROS_PER_MINUTE

_CHUNK = "_chunk"


@dataclass(frozen=True)
class Timeline:
    """Keys and time of a sequence, its interval and how to split it."""

    keys: tuple[str, ...]
    time: str = "event_time"
    interval_minutes: int = 5
    chunk_minutes: int | None = None

    @property
    def interval_micros(self) -> int:
        return self.interval_minutes * MICROS_PER_MINUTE

    def chunk(self) -> Column:
        size = self.chunk_minutes * MICROS_PER_MINUTE
        value = F.unix_micros(self.time)
        return ((value - F.pmod(value, F.lit(size))) / size).cast("long")

    def local_window(self):
        parts = list(self.keys) + ([_CHUNK] if self.chunk_minutes else [])
        return Window.partitionBy(*parts).orderBy(self.time)


def _with_carry(frame: DataFrame, line: Timeline, summary: Sequence[Column], carry: Mapping[str, Column]) -> DataFrame:
    """Join values of the earlier chunks of the same key to every row.

    One row per key and chunk is summarised, so the window over whole keys sees
    span / chunk rows.
    """
    keys = list(line.keys)
    chunks = frame.groupBy(*keys, _CHUNK).agg(*summary)
    carried = chunks.select(*keys, _CHUNK, *[value.alias(name) for name, value in carry.items()])
    left, right = frame.alias("l"), carried.alias("r")
    same = reduce(
        lambda a, b: a & b,
        [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, _CHUNK)],
    )
    return left.join(right, same, "left").select("l.*", *[F.col(f"r.{name}") for name in carry])


def with_previous(frame: DataFrame, line: Timeline, columns: Mapping[str, Column]) -> DataFrame:
    """Add values of the previous row of the same key, null on the first."""
    packed = F.struct(*[value.alias(name) for name, value in columns.items()])
    if line.chunk_minutes is None:
        result = frame.withColumn("_previous_row", F.lag(packed).over(line.local_window()))
    else:
        by_chunk = Window.partitionBy(*line.keys).orderBy(_CHUNK)
        result = _with_carry(
            frame.withColumn(_CHUNK, line.chunk()).withColumn("_row", packed),
            line,
            [F.max_by("_row", line.time).alias("_last")],
            {"_carry": F.lag("_last").over(by_chunk)},
        )
        result = result.withColumn(
            "_previous_row", F.coalesce(F.lag("_row").over(line.local_window()), "_carry")
        ).drop("_carry", "_row", _CHUNK)
    return result.withColumns({name: F.col(f"_previous_row.{name}") for name in columns}).drop("_previous_row")


def with_latest_time(frame: DataFrame, line: Timeline, conditions: Mapping[str, Column]) -> DataFrame:
    """Add the latest time, at or before the row, at which a condition held."""
    marks = {f"_at_{name}": F.when(condition, F.col(line.time)) for name, condition in conditions.items()}
    marked = frame.withColumns(marks)
    running = line.local_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if line.chunk_minutes is None:
        result = marked.withColumns({name: F.max(f"_at_{name}").over(running) for name in conditions})
    else:
        before = (
            Window.partitionBy(*line.keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        )
        result = _with_carry(
            marked.withColumn(_CHUNK, line.chunk()),
            line,
            [F.max(f"_at_{name}").alias(f"_top_{name}") for name in conditions],
            {f"_carry_{name}": F.max(f"_top_{name}").over(before) for name in conditions},
        )
        result = result.withColumns(
            {
                name: F.coalesce(F.max(f"_at_{name}").over(running), F.col(f"_carry_{name}"))
                for name in conditions
            }
        ).drop(_CHUNK, *[f"_carry_{name}" for name in conditions])
    return result.drop(*marks)


def follows(line: Timeline, previous_time: str = "_previous_time") -> Column:
    """True where the previous row lies exactly one interval back."""
    gap = F.unix_micros(line.time) - F.unix_micros(previous_time)
    return F.coalesce(gap == line.interval_micros, F.lit(False))


def run_length(line: Timeline, start: str) -> Column:
    """Number of points from ``start`` up to and including the row."""
    span = F.unix_micros(line.time) - F.unix_micros(start)
    return (span / line.interval_micros).cast("int") + 1


def with_streak(frame: DataFrame, line: Timeline, flag: Column, name: str) -> DataFrame:
    """Add the number of consecutive flagged rows ending at each row."""
    flagged = F.coalesce(flag.cast("boolean"), F.lit(False))
    result = frame.withColumn("_flag", flagged)
    result = with_previous(result, line, {"_previous_time": F.col(line.time), "_previous_flag": F.col("_flag")})
    starts = F.col("_flag") & ~(follows(line) & F.coalesce(F.col("_previous_flag"), F.lit(False)))
    result = with_latest_time(result, line, {"_start": starts})
    return result.withColumn(
        name, F.when(F.col("_flag"), run_length(line, "_start")).otherwise(0)
    ).drop("_flag", "_previous_flag", "_previous_time", "_start")


def with_run_start(frame: DataFrame, line: Timeline, name: str = "run_start") -> DataFrame:
    """Name each row's exact-interval run by the time of its first row."""
    result = with_previous(frame, line, {"_previous_time": F.col(line.time)})
    return with_latest_time(result, line, {name: ~follows(line)}).drop("_previous_time")


def collapse(frame: DataFrame, line: Timeline, flag: Column, aggregates: Sequence[Column] = ()) -> DataFrame:
    """One row per run of flagged rows: start, end, points and duration.

    Only flagged rows are shuffled. The duration counts the last interval too.
    """
    flagged = frame.where(F.coalesce(flag.cast("boolean"), F.lit(False)))
    return (
        with_run_start(flagged, line, "start_time")
        .groupBy(*line.keys, "start_time")
        .agg(
            F.max(line.time).alias("end_time"),
            F.count(F.lit(1)).alias("points"),
            *aggregates,
        )
        .withColumn(
            "duration_minutes",
            (F.unix_micros("end_time") - F.unix_micros("start_time")) / MICROS_PER_MINUTE
            + F.lit(line.interval_minutes),
        )
    )
