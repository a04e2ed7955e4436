"""Periodic runs of words in alarm messages, by a suffix automaton with link-cut access.

Words are looked at from left to right. The states of the automaton that stand
for the suffixes of what has been read lie on one path of suffix links; every
segment of that path was coloured by one earlier word, where its suffixes were
seen last. Reading the next word accesses its path and recolours it. If a
segment's earlier end is no further away than its longest suffix is long, two
copies of the same words lie side by side: a square. Squares of one period at
consecutive words are one run, and the longest suffix tells where it begins.

Before that, words are set aside that no run can hold: after its first period a
run repeats each word within a distance that its own length bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from stringwatch.llm import vocabulary

Run = tuple[int, int, int]


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Longest suffix and suffix link of every state, and the state of every prefix."""
    steps, link, size, prefixes, last = [{}], [-1], [0], [], 0
    for word in words:
        new, at = len(size), last
        size.append(size[last] + 1)
        steps.append({})
        link.append(0)
        while at >= 0 and word not in steps[at]:
            steps[at][word] = new
            at = link[at]
        if at >= 0:
            old = steps[at][word]
            if size[old] == size[at] + 1:
                link[new] = old
            else:
                split = len(size)
                size.append(size[at] + 1)
                steps.append(steps[old].copy())
                link.append(link[old])
                while at >= 0 and steps[at].get(word) == old:
                    steps[at][word] = split
                    at = link[at]
                link[old] = link[new] = split
        prefixes.append(new)
        last = new
    return size, link, prefixes


def preferred_paths(size: list[int], link: list[int]) -> list[int]:
    """Cuts the tree of suffix links into paths; the topmost state of each state's path.

    A path goes on to the child with most states below it, so that every way to
    the root crosses few paths.
    """
    order = np.argsort(np.array(size), kind="stable").tolist()
    below, heavy, top = [1] * len(size), [0] * len(size), list(range(len(size)))
    for state in reversed(order[1:]):
        up = link[state]
        below[up] += below[state]
        if not heavy[up] or below[state] > below[heavy[up]]:
            heavy[up] = state
    for state in order[1:]:
        up = link[state]
        if up and heavy[up] == state:
            top[state] = top[up]
    return top


def squares_to_runs(words: list[int], least_length: int, least_exponent: int) -> list[Run]:
    """All runs (start, length, period) long enough, in the order of their ends."""
    size, link, prefixes = suffix_automaton(words)
    top = preferred_paths(size, link)
    coloured: dict[int, list[tuple[int, int]]] = {}  # by path: longest suffix and last end of its segments, topmost last
    longest = len(words) // least_exponent
    going: dict[int, list[int]] = {}  # by period: begin and last end of the latest run
    found: list[Run] = []

    def close(period: int, begin: int, end: int) -> None:
        if end - begin + 1 >= max(least_length, least_exponent * period):
            found.append((begin, end - begin + 1, period))

    def meet(end: int, earlier: int, length: int) -> None:
        period = end - earlier
        if period > length or period > longest:
            return
        begin, run = end - length - period + 1, going.get(period)
        if run is not None and run[1] >= end - 1:
            run[0], run[1] = min(run[0], begin), end
            return
        if run is not None:
            close(period, *run)
        going[period] = [begin, end]

    for end, state in enumerate(prefixes):
        while state > 0:
            path, own = top[state], size[state]
            segments = coloured.setdefault(path, [])
            length = 0
            while segments and segments[-1][0] <= own:
                length, earlier = segments.pop()
                meet(end, earlier, length)
            if segments and length < own:  # the rest of this segment keeps its colour
                meet(end, segments[-1][1], own)
            segments.append((own, end))
            state = link[path]
    for period, run in going.items():
        close(period, *run)
    return found


def repetitive_stretches(codes: np.ndarray, begins: np.ndarray, least_length: int, least_exponent: int) -> list[tuple[int, int, int]]:
    """Where runs may be: (first word to look at, first word that repeats, end) of each stretch.

    ``codes`` are the words of many messages, which begin at ``begins``. A run of
    period q repeats every word after its first q within q words; these are
    (exponent - 1) q at least, so in a stretch of m such words q is at most
    m / (exponent - 1), and words repeated later than that do not count. That is
    applied until nothing changes. Stretches lie within one message.
    """
    owner = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(codes))))
    order = np.argsort(owner * (int(codes.max(initial=0)) + 1) + codes, kind="stable")
    same = (codes[order[1:]] == codes[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    distance = np.full(len(codes), len(codes) + 1, np.int64)
    distance[order[1:][same]] = (order[1:] - order[:-1])[same]
    alive = np.flatnonzero(distance <= len(codes))
    while len(alive):
        first = np.append(True, np.diff(alive) > 1)
        starts = np.flatnonzero(first)
        lengths = np.diff(np.append(starts, len(alive)))
        limit = np.where(lengths * least_exponent >= least_length * (least_exponent - 1), lengths // (least_exponent - 1), 0)
        kept = distance[alive] <= np.repeat(limit, lengths)
        if kept.all():
            lows = np.maximum(alive[starts] - limit, begins[owner[alive[starts]]])
            return list(zip(lows.tolist(), alive[starts].tolist(), (alive[starts] + lengths).tolist()))
        alive = alive[kept]
    return []


def runs_in(codes: np.ndarray, begins: np.ndarray, least_length: int, least_exponent: int) -> dict[int, list[Run]]:
    """The runs of each message that has any, by start and period."""
    found: dict[int, list[Run]] = {}
    for low, first, end in repetitive_stretches(codes, begins, least_length, least_exponent):
        message = int(np.searchsorted(begins, low, side="right")) - 1
        for start, length, period in squares_to_runs(codes[low:end].tolist(), least_length, least_exponent):
            if low + start + period >= first:  # others belong to the stretch before
                found.setdefault(message, []).append((low + start - int(begins[message]), length, period))
    return {message: sorted(runs, key=lambda run: (run[0], run[2])) for message, runs in found.items()}


def collapsed(words: list[str], runs: list[Run]) -> str:
    """The words that no run contains after its first period, joined by spaces."""
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return " ".join(words[i] for i in np.flatnonzero(kept).tolist())


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def alarm_word_runs(alarms: DataFrame, least_length: int = 6, least_exponent: int = 4) -> DataFrame:
    """Periodic runs in every alarm message: alarm_event_id, runs, collapsed_name.

    Words are what ASCII white space separates. A run is a stretch of words with
    smallest period q that no neighbouring word extends, of ``least_length`` and
    ``least_exponent`` (2 or more) periods at least; ``runs`` has start, length
    and period of each by start and period. ``collapsed_name`` is the message
    with every run cut to its first period. Null and empty messages have no runs
    and collapse to an empty text; long ones are looked at whole, with memory
    for their longest repetitive stretch. Null ids and repeated rows give a row
    each, empty tables none; other columns are left out.
    """
    if least_exponent < 2:
        raise ValueError("a run has two periods at least")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, done = batch.column("alarm_event_id"), 0
            for chunk in vocabulary.chunks(batch.column("alarm_name")):
                lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(chunk))
                words, offsets = lists.flatten(), np.asarray(lists.offsets, np.int64)
                codes = np.asarray(words.dictionary_encode().indices, np.int64)
                found = runs_in(codes, offsets[:-1] - offsets[0], least_length, least_exponent)
                names = pc.binary_join(lists, pa.scalar(" ", words.type)).to_pylist()
                for message, runs in found.items():
                    names[message] = collapsed(lists[message].as_py(), runs)
                runs = [[dict(zip(("start", "length", "period"), run)) for run in found.get(i, ())] for i in range(len(chunk))]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(done, len(chunk)), pa.array(runs, RUNS), pa.array(names, pa.string())],
                    ["alarm_event_id", "runs", "collapsed_name"],
                )
                done += len(chunk)

    key = alarms.schema["alarm_event_id"].dataType.simpleString()
    return alarms.select("alarm_event_id", "alarm_name").mapInArrow(
        find, f"alarm_event_id {key}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed_name string"
    )
