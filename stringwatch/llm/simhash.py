"""SimHash groups of alarm messages by the general pigeonhole principle.

Fingerprints that differ in at most ``distance`` bits are linked. The 64 bits
are cut into parts of correlated bits; every fingerprint gets a threshold for
each part, so that their sum is ``distance`` - parts + 1. Whatever lies within
``distance`` then lies within the threshold in one part at least (-1 skips a
part). Dynamic programming picks the thresholds with the fewest candidates that
a histogram of the parts' values lets expect, so crowded values are left to
other parts. Each fingerprint probes its parts' values and their neighbours, and
the bits that differ are counted for every candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringwatch.llm.components import connected_components
from stringwatch.storage import Scratch

BITS = 64
#: bins of a part's histogram: its first 16 bits; the histograms stay below 3 MB at any input
BIN_BITS = 16
SHINGLES_AT_ONCE = 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority of the XXH64 bits of the word shingles of a lower-cased text; 0 without words."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    if len(parts) < words:
        spans = [(0, len(joined))]
    else:
        spans = list(zip((ends - lengths)[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist()))
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for begin in range(0, len(spans), SHINGLES_AT_ONCE):
        some = spans[begin : begin + SHINGLES_AT_ONCE]
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in some), np.uint64, len(some))
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(spans), bitorder="little").view("<u8")[0])


def fingerprints(alarms: DataFrame, words: int = 3) -> DataFrame:
    """alarm_event_id and fingerprint (the 64 bits as bigint)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("alarm_name")
            found = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("alarm_event_id"), pa.array(found.view(np.int64))], ["alarm_event_id", "fingerprint"]
            )

    key = alarms.schema["alarm_event_id"].dataType.simpleString()
    return alarms.select("alarm_event_id", "alarm_name").mapInArrow(compute, f"alarm_event_id {key}, fingerprint bigint")


def part_count(fingerprint_count: int) -> int:
    """Wider parts once a part's values would be shared by too many fingerprints."""
    return 4 if fingerprint_count <= 1 << 22 else 3 if fingerprint_count <= 1 << 27 else 2


def _bits(values: np.ndarray) -> np.ndarray:
    return (values[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)


def bit_correlations(prints: DataFrame) -> np.ndarray:
    """Correlations of the 64 bits over all fingerprints."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS + 1))
        for batch in batches:
            values = np.asarray(batch.column(0)).view(np.uint64)
            for begin in range(0, len(values), 1 << 16):
                bits = np.pad(_bits(values[begin : begin + (1 << 16)]).astype(np.float64), ((0, 0), (0, 1)), constant_values=1)
                total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "n"])

    cells = prints.select("fingerprint").mapInArrow(count, "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros((BITS + 1) ** 2)
    for row in cells.collect():  # (64 + 1) ** 2 rows
        counts[row.cell] = row.n
    counts = counts.reshape(BITS + 1, BITS + 1)
    n = max(counts[-1, -1], 1)
    means = counts[-1, :-1] / n
    spread = np.sqrt(np.maximum(means * (1 - means), 1e-12))
    return (counts[:-1, :-1] / n - np.outer(means, means)) / np.outer(spread, spread)


def correlated_parts(correlations: np.ndarray, parts: int) -> list[list[int]]:
    """Each part starts with the most correlated pair left and takes the bits closest to it."""
    strength = np.abs(correlations) - np.eye(BITS) * 2
    left, found = list(range(BITS)), []
    for i in range(parts):
        width = (BITS - sum(map(len, found))) // (parts - i)
        inner = strength[np.ix_(left, left)]
        part = [left[k] for k in np.unravel_index(inner.argmax(), inner.shape)][:width]
        left = [b for b in left if b not in part]
        while len(part) < width:
            nearest = left[int(strength[np.ix_(left, part)].mean(1).argmax())]
            part.append(nearest)
            left.remove(nearest)
        found.append(sorted(part))
    return found


def part_values(values: np.ndarray, part: list[int]) -> np.ndarray:
    """The bits of a part, side by side."""
    out = np.zeros(len(values), np.uint64)
    for place, bit in enumerate(part):
        out |= ((values >> np.uint64(bit)) & np.uint64(1)) << np.uint64(place)
    return out


def histograms(prints: DataFrame, parts: list[list[int]]) -> np.ndarray:
    """How many fingerprints have each value (its first ``BIN_BITS`` bits) in each part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(parts) << BIN_BITS, np.int64)
        for batch in batches:
            values = np.asarray(batch.column(0)).view(np.uint64)
            for i, part in enumerate(parts):
                bins = part_values(values, part[:BIN_BITS]).astype(np.int64) + (i << BIN_BITS)
                total += np.bincount(bins, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bin", "n"])

    counted = prints.select("fingerprint").mapInArrow(count, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(parts) << BIN_BITS)
    out[counted["bin"].to_numpy(np.int64)] = counted["n"].to_numpy()
    return out.reshape(len(parts), -1)


def expected_candidates(counts: np.ndarray, widths: list[int], largest: int) -> np.ndarray:
    """Candidates and probes by part, threshold (-1 .. largest) and bin, as estimated from the histograms."""
    bins = np.arange(counts.shape[1])
    out = np.zeros((len(counts), largest + 2, counts.shape[1]))
    for i, width in enumerate(widths):
        share = 2.0 ** -max(width - BIN_BITS, 0)
        used = min(width, BIN_BITS)
        rings = [counts[i]]
        if largest >= 1:
            rings.append(sum(counts[i][bins ^ (1 << b)] for b in range(used)) * width / used)
        if largest >= 2:
            pairs = list(combinations(range(used), 2))
            rings.append(sum(counts[i][bins ^ (1 << a ^ 1 << b)] for a, b in pairs) * (width * (width - 1) / 2 / len(pairs)))
        probes = [1, width, width * (width - 1) // 2]
        for t, ring in enumerate(rings):
            out[i, t + 1] = out[i, t] + ring * share + probes[t]
    return out


def allocate(costs: np.ndarray, budget: int) -> np.ndarray:
    """Thresholds (rows x parts) of least cost whose sum is ``budget``; costs: parts x thresholds x rows."""
    parts, choices, rows = costs.shape
    least, span = -parts, budget + 2 * parts + 1
    best = np.full((parts + 1, span, rows), np.inf)
    best[0, -least] = 0
    picked = np.zeros((parts, span, rows), np.int8)
    for i in range(parts):
        for total in range(span):
            for choice in range(choices):
                before = total - (choice - 1)
                if 0 <= before < span:
                    cost = best[i, before] + costs[i, choice]
                    better = cost < best[i + 1, total]
                    best[i + 1, total][better] = cost[better]
                    picked[i, total][better] = choice - 1
    thresholds, total = np.zeros((rows, parts), np.int64), np.full(rows, budget - least)
    for i in range(parts - 1, -1, -1):
        thresholds[:, i] = picked[i, total, np.arange(rows)]
        total = total - thresholds[:, i]
    return thresholds


def neighbours(width: int, radius: int) -> np.ndarray:
    """Masks of 0 to ``radius`` bits of a part."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
    return np.array(masks, np.uint64)


def linked_fingerprints(prints: DataFrame, scratch: Scratch, distance: int = 3, parts: int | None = None) -> DataFrame:
    """a < b: all pairs of different fingerprints that differ in at most ``distance`` bits.

    ``prints`` has distinct fingerprints. A set whose members all differ in three
    bits at most has 128 members at most, so links do not grow with the square
    of a group of copies.
    """
    parts = parts or part_count(prints.count())
    groups = correlated_parts(bit_correlations(prints), parts)
    widths, budget = [len(g) for g in groups], distance - parts + 1
    largest = min(2, distance)
    costs = expected_candidates(histograms(prints, groups), widths, largest)

    def values(batches: Iterator[pa.RecordBatch], probing: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            everything = np.asarray(batch.column(0)).view(np.uint64)
            for begin in range(0, len(everything), 1 << 13):
                own = everything[begin : begin + (1 << 13)]
                if probing:
                    bins = [part_values(own, g[:BIN_BITS]).astype(np.int64) for g in groups]
                    thresholds = allocate(np.stack([costs[i][:, b] for i, b in enumerate(bins)]), budget)
                for i, group in enumerate(groups):
                    keys = part_values(own, group)
                    radii = range(largest + 1) if probing else (0,)
                    for radius in radii:
                        rows = np.flatnonzero(thresholds[:, i] == radius) if probing else np.arange(len(own))
                        if len(rows):
                            masks = neighbours(widths[i], radius)
                            probed = (keys[rows][:, None] ^ masks).ravel() | np.uint64(i << 56)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(probed.view(np.int64)), pa.array(np.repeat(own[rows], len(masks)).view(np.int64))],
                                ["slot", "fingerprint"],
                            )

    schema = "slot bigint, fingerprint bigint"
    source = prints.select("fingerprint")
    index = source.mapInArrow(lambda b: values(b, False), schema).withColumnRenamed("fingerprint", "a")
    probes = source.mapInArrow(lambda b: values(b, True), schema).withColumnRenamed("fingerprint", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    found = probes.join(index, (probes.slot == index.slot) & (F.col("a") < F.col("b")) & near)
    return scratch.stage(found.select("a", "b").distinct(), "near")


def alarm_near_copies(alarms: DataFrame, distance: int = 3, words: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """Groups of alarm messages with close fingerprints.

    Returns alarm_event_id, fingerprint (16 hex digits) and component_id, the
    smallest alarm_event_id reachable over links of at most ``distance`` bits.
    Messages without words (null, empty, white space) have fingerprint zero and
    are linked like others. Null ids: their messages link, but only other ids
    name a component (null if there are none). Repeated rows give a row each,
    empty tables none; other columns are left out.
    """
    scratch = scratch or Scratch(alarms.sparkSession)
    rows = scratch.stage(fingerprints(alarms, words), "fingerprints")
    firsts = scratch.stage(rows.groupBy("fingerprint").agg(F.min("alarm_event_id").alias("first")), "distinct")
    links = linked_fingerprints(firsts.select("fingerprint"), scratch, distance)
    member = connected_components(links, scratch)
    rooted = firsts.join(member, firsts.fingerprint == member.node, "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch.stage(rooted.join(names, "root").select("fingerprint", "component_id"), "named")
    return rows.join(named, "fingerprint", "left").select(
        "alarm_event_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
