"""Per-key state machines that see their rows in time order.

Rows wait in state until the watermark has passed them, so the exact-interval
rule is applied in time order although input is not. Rows of one time are all
kept, in the order of their values; as in a batch, the second one lies no
interval after the first. Rows behind the watermark are dropped by the engine
and counted by :class:`stringwatch.streaming.watch.StreamWatch`.

A processor serves one key a group. :class:`Bucketed` runs it for all keys of a
bucket with one state for all of them: a call to the state store costs more than
the rows that a key has in a batch, and Arrow tables more than halve the rest.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import batched, chain
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState

MINUTE_US = 60_000_000
#: rows of one message to the state store
MESSAGE_ROWS = 10_000
ARROW_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def append(state: ListState, rows: Iterable[tuple]) -> None:
    for part in batched(rows, MESSAGE_ROWS):
        state.appendList(list(part))


class OrderedProcessor(StatefulProcessor):
    """Buffers rows by time and releases them behind the watermark.

    Input has ``time_us``, microseconds since 1970 and never null, and the fields
    of ``payload_schema``. Subclasses name the state carried from row to row, the
    fields of a result and the step that consumes one row.
    """

    payload_schema: str
    carried_schema: str
    result_schema: str

    def __init__(self, interval_minutes: int = 5, forget_minutes: int = 1_440):
        self.interval_us = interval_minutes * MINUTE_US
        self.forget_us = forget_minutes * MINUTE_US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one list a key: a call to the state store costs more than the rows of a few days
        self.waiting = handle.getListState("waiting", f"time_us long, {self.payload_schema}")
        self.carried = handle.getValueState("carried", self.carried_schema)
        self.fields = [field.split()[0] for field in self.payload_schema.split(", ")]

    def output_schema(self, key_schema: str) -> str:
        """Schema of the output; the processor keeps the names for its rows."""
        schema = f"{key_schema}, {self.result_schema}"
        self.columns = [field.split()[0] for field in schema.split(", ")]
        return schema

    def step(self, carried: tuple | None, time_us: int, payload: tuple) -> tuple[tuple, list[tuple]]:
        """Return the new carried state and the results that a row gives."""
        raise NotImplementedError

    def passed(self, carried: tuple, time_us: int) -> tuple[tuple | None, list[tuple]]:
        """What a time without a row gives: by default the state is forgotten, since a gap would clear it anyway."""
        return (None if time_us >= carried[0] + self.forget_us else carried), []

    def next_look(self, carried: tuple) -> int:
        """Time at which :meth:`passed` is asked if no row comes."""
        return carried[0] + self.forget_us

    def waiting_schema(self) -> str:
        return f"time_us long, {self.payload_schema}"

    def received(self, table: pa.Table, keys: list[str]) -> tuple[pa.Table, int]:
        """What is kept of new rows, and the time in milliseconds at which it is looked at."""
        return table, pa.compute.min(table["time_us"]).as_py() // 1000 + 1

    def advance(self, rows: list[tuple], carried: tuple | None, passed: int) -> tuple[list[tuple], list[tuple], tuple | None, int | None]:
        """Results of the rows of a key, in order, behind ``passed``; the rows left, the state, and when to look again."""
        end = bisect_left(rows, passed, key=lambda r: r[0] // 1000)
        found, later = [], rows[end:]
        for time_us, *payload in rows[:end]:
            carried, results = self.step(carried, time_us, tuple(payload))
            found += results
        looks = [later[0][0] // 1000 + 1] if later else []
        if carried is not None:
            look = self.next_look(carried) // 1000 + 2
            if look <= passed:
                carried, results = self.passed(carried, self.next_look(carried))
                found += results
            else:
                looks.append(look)
        return found, later, carried, min(looks, default=None)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        came = [(row["time_us"], *[row[f] for f in self.fields]) for row in rows]
        append(self.waiting, came)
        self.handle.registerTimer(min(row[0] for row in came) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        # everything behind the watermark is due, so timers that expire with it find nothing more
        waiting = sorted(map(tuple, self.waiting.get()), key=lambda r: (r[0], [(v is not None, v) for v in r[1:]]))
        known = self.carried.get()
        before = None if known is None else tuple(known)
        found, later, carried, look = self.advance(waiting, before, timerValues.getCurrentWatermarkInMs())
        due = len(later) < len(waiting)
        if due:
            self.waiting.clear()
            append(self.waiting, later)
        if carried is None and before is not None:
            self.carried.clear()
        elif carried != before:
            self.carried.update(carried)
        if look is not None and (due or carried != before):
            self.handle.registerTimer(look)
        named = Row(*self.columns)
        return (named(*key, *values) for values in found)

    def close(self) -> None:
        pass


class MemoryProcessor(OrderedProcessor):
    """Streaks and confirmed-anomaly memory of one string."""

    payload_schema = "raw boolean, evaluable boolean"
    carried_schema = "last_us long, streak int, normals int, active boolean"
    result_schema = "time_us long, streak int, normals int, memory_active int, memory_alert int"

    def __init__(self, interval_minutes: int = 5, enter: int = 3, clear: int = 3, forget_minutes: int = 1_440):
        super().__init__(interval_minutes, forget_minutes)
        self.enter, self.clear = enter, clear

    def step(self, carried, time_us, payload):
        raw, evaluable = payload
        last_us, streak, normals, active = carried or (None, 0, 0, False)
        if not evaluable or last_us is None or time_us - last_us != self.interval_us:
            streak, normals, active = 0, 0, False
        alert = False
        if evaluable and raw:
            streak, normals = streak + 1, 0
            active = active or streak >= self.enter
            alert = active
        elif evaluable:
            streak, normals = 0, normals + 1
            active = active and normals < self.clear
        return (time_us, streak, normals, active), [(time_us, streak, normals, int(active), int(alert))]


class EwmaProcessor(OrderedProcessor):
    """Smoothed standardised residual of one device."""

    payload_schema = "underproduction_residual double, ewma_eligible boolean"
    carried_schema = "last_us long, state double"
    result_schema = "time_us long, ewma_score double"

    def __init__(self, weight: float, center: float, scale: float, interval_minutes: int = 5, forget_minutes: int = 1_440):
        super().__init__(interval_minutes, forget_minutes)
        self.weight, self.center, self.scale = weight, center, scale

    def step(self, carried, time_us, payload):
        residual, eligible = payload
        last_us, state = carried or (None, 0.0)
        if not eligible or last_us is None or time_us - last_us != self.interval_us:
            state = 0.0
        score = None
        if eligible:
            state = self.weight * (residual - self.center) / self.scale + (1.0 - self.weight) * state
            score = state
        return (time_us, state), [(time_us, score)]


class EventProcessor(OrderedProcessor):
    """Runs of exact intervals of one string, each given out once it cannot go on.

    The open run is state. It ends at a row that is not one interval later, or
    when the watermark passes the place where the next one would have been.
    """

    payload_schema = "alert boolean"
    carried_schema = "last_us long, start_us long, points long"
    result_schema = "start_us long, end_us long, points long"

    def step(self, carried, time_us, payload):
        if carried is not None and time_us - carried[0] == self.interval_us:
            return (time_us, carried[1], carried[2] + 1), []
        ended = [] if carried is None else [(carried[1], carried[0], carried[2])]
        return (time_us, time_us, 1), ended

    def next_look(self, carried):
        return carried[0] + self.interval_us

    def passed(self, carried, time_us):
        if time_us < carried[0] + self.interval_us:
            return carried, []
        return None, [(carried[1], carried[0], carried[2])]


class GapProcessor(StatefulProcessor):
    """Points of one device in every window, also in those without any.

    Windows are reported once the watermark has passed their end, from the
    device's first one on. After ``silent_windows`` without a point reports stop
    until the device has points again; then the silent span up to them is
    reported first. Of such a device only its next window is kept.
    """

    result_schema = "window_ms long, points long"

    def __init__(self, window_minutes: int, silent_windows: int = 1_000):
        self.window_ms = window_minutes * MINUTE_US // 1000
        self.silent_windows = silent_windows

    def output_schema(self, key_schema: str) -> str:
        """Schema of the output; the processor keeps the names for its rows."""
        schema = f"{key_schema}, {self.result_schema}"
        self.columns = [field.split()[0] for field in schema.split(", ")]
        return schema

    def waiting_schema(self) -> str:
        return "window_ms long, points long"

    def received(self, table: pa.Table, keys: list[str]) -> tuple[pa.Table, int]:
        """Points of every key and window, and the time in milliseconds at which the first window ends."""
        ms = table["time_us"].to_numpy() // 1000 // self.window_ms * self.window_ms
        counted = table.select(keys).append_column("window_ms", pa.array(ms)).group_by([*keys, "window_ms"]).aggregate([([], "count_all")])
        return counted.rename_columns([*keys, "window_ms", "points"]), int(ms.min()) + self.window_ms

    def advance(self, rows: Iterable[tuple], carried: tuple | None, passed: int) -> tuple[list[tuple], list[tuple], tuple | None, int | None]:
        """Windows of a key that end by ``passed``; the counts left, the progress, and when to look again."""
        counts: Counter[int] = Counter()
        for found, points in rows:
            counts[found] += points
        first = min(counts, default=None)
        if first is not None and (carried is None or first < carried[0]):
            carried = (first, 0)
        if carried is None:
            return [], [], None, None
        window, silent = carried
        out, later = [], window  # up to here windows are reported however long the silence is
        while window + self.window_ms <= passed:
            if silent >= self.silent_windows and later <= window:
                later = min(counts, default=None)
                if later is None:
                    return out, [], (window, silent), None
            points = counts.pop(window, 0)
            silent = 0 if points else silent + 1
            out.append((window, points))
            window += self.window_ms
        return out, list(counts.items()), (window, silent), window + self.window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # numbers of one window may stand in several entries, one a batch
        self.counts = handle.getListState("counts", "window_ms long, points long")
        self.progress = handle.getValueState("progress", "next_ms long, silent int")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        came = Counter(row["time_us"] // 1000 // self.window_ms * self.window_ms for row in rows)
        append(self.counts, came.items())
        first = min(came)
        self.handle.registerTimer(first + self.window_ms)
        if not self.progress.exists() or first < self.progress.get()[0]:
            self.progress.update((first, 0))
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if not self.progress.exists():
            return iter([])
        progress, passed = tuple(self.progress.get()), timerValues.getCurrentWatermarkInMs()
        if progress[0] + self.window_ms > passed:
            return iter([])
        found, counts, progress, look = self.advance(self.counts.get(), progress, passed)
        if found:
            self.progress.update(progress)
            self.counts.clear()
            append(self.counts, counts)
            if look is not None:
                self.handle.registerTimer(look)
        named = Row(*self.columns)
        return (named(*key, *values) for values in found)

    def close(self) -> None:
        pass


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(name, ARROW_TYPES[kind]) for name, kind in (field.split() for field in schema.split(", "))])


def key_codes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """A number for every row, the same for rows of the same keys; nulls are a value."""
    codes = np.zeros(table.num_rows, np.int64)
    for name in keys:
        own = table[name].combine_chunks().dictionary_encode("encode")
        codes = np.unique(codes * max(len(own.dictionary), 1) + own.indices.to_numpy(), return_inverse=True)[1]
    return codes


def in_order(table: pa.Table, codes: np.ndarray, names: list[str]) -> np.ndarray:
    """Rows by key, then by the columns, nulls first."""
    orders = [codes]
    for name in names:
        column = table[name].combine_chunks()
        if column.null_count:
            orders += [column.is_valid().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy(zero_copy_only=False)]
        else:
            orders.append(column.to_numpy(zero_copy_only=False))
    return np.lexsort(orders[::-1])


def plain(column: pa.ChunkedArray) -> list:
    return column.to_pylist() if column.null_count else column.to_numpy().tolist()


class Bucketed(StatefulProcessor):
    """A processor for every key of a bucket, with the rows that wait and the carried states of all keys in one place each.

    The state store is asked a few times a bucket and batch, whatever the number
    of keys. Rows wait as Arrow tables, one entry a batch.
    """

    def __init__(self, processor: OrderedProcessor | GapProcessor, key_schema: str):
        self.processor, self.key_schema = processor, key_schema

    def output_schema(self) -> str:
        return f"{self.key_schema}, {self.processor.result_schema}"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "packed binary")
        self.carried = handle.getValueState("carried", "packed binary")
        self.keys = [field.split()[0] for field in self.key_schema.split(", ")]
        self.kept = arrow_schema(f"{self.key_schema}, {self.processor.waiting_schema()}")
        payload = getattr(self.processor, "payload_schema", "")
        self.came = arrow_schema(f"{self.key_schema}, time_us long" + (f", {payload}" if payload else ""))
        self.result = arrow_schema(self.output_schema())

    def keep(self, table: pa.Table) -> None:
        """Messages of bounded size to the state store."""
        for begin in range(0, table.num_rows, 10 * MESSAGE_ROWS):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.kept) as writer:
                writer.write_table(table.slice(begin, 10 * MESSAGE_ROWS))
            self.waiting.appendValue((sink.getvalue().to_pybytes(),))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came = [pa.Table.from_pandas(part[self.came.names], self.came, preserve_index=False) for part in rows]
        table, look = self.processor.received(pa.concat_tables(came), self.keys)
        self.keep(table.cast(self.kept))
        self.handle.registerTimer(look)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        parts = [pa.ipc.open_stream(packed).read_all() for packed, in self.waiting.get()]
        known = self.carried.get()
        before = {} if known is None else pickle.loads(known[0])
        carried, looks, rest, found, owners, counts = {}, [], [], [], [], []

        def advance(name: tuple, rows: list[tuple]) -> None:
            results, later, state, look = self.processor.advance(rows, before.get(name), passed)
            if state is not None:
                carried[name] = state
            if look is not None:
                looks.append(look)
            rest.extend((*name, *row) for row in later)
            if results:
                found.append(results)
                owners.append(name)
                counts.append(len(results))

        names = set()
        if parts:
            table, others = pa.concat_tables(parts).combine_chunks(), self.kept.names[len(self.keys) :]
            codes = key_codes(table, self.keys)
            order = in_order(table, codes, others)
            table, codes = table.take(pa.array(order)), codes[order]
            begins = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])).tolist()
            firsts = table.select(self.keys).take(pa.array(begins))
            rows = list(zip(*[plain(table[name]) for name in others]))
            for name, begin, end in zip(zip(*[c.to_pylist() for c in firsts.columns]), begins, [*begins[1:], len(rows)]):
                names.add(name)
                advance(name, rows[begin:end])
        for name in before.keys() - names:
            advance(name, [])
        if sum(counts) or len(rest) < sum(p.num_rows for p in parts):
            self.waiting.clear()
            self.keep(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rest), self.kept.types)], schema=self.kept) if rest else self.kept.empty_table())
        if carried != before:
            self.carried.update((pickle.dumps(carried),))
        if looks:
            self.handle.registerTimer(min(looks))
        if not found:
            return iter([])
        values = [np.repeat(np.array(column, object), counts) for column in zip(*owners)] + list(zip(*chain.from_iterable(found)))
        arrays = [pa.array(column, kind) for column, kind in zip(values, self.result.types)]
        return iter([pa.Table.from_arrays(arrays, schema=self.result).to_pandas()])

    def close(self) -> None:
        pass
