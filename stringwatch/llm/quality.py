"""Quality of alarm messages by a generalised additive model with pairs.

Every text gives a few numbers: lengths, shares of kinds of characters, repeated
words and lines. Shallow trees, boosted over the features in turn, add up to one
lookup table per feature and one per chosen pair of features; a score is a sum
of table entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringwatch.llm import vocabulary

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "space", "sentence_end", "other_mark",
    "pipe", "non_ascii", "line", "short_word", "long_word", "marked_word", "distinct_words", "repeated_word", "distinct_lines",
)
CHUNK_BYTES = 2 << 20

BYTES = np.arange(256)
SPACE = (BYTES == 32) | ((BYTES >= 9) & (BYTES <= 13))
LETTER = ((BYTES | 32) >= 97) & ((BYTES | 32) <= 122)
DIGIT = (BYTES >= 48) & (BYTES <= 57)
MARK = (BYTES > 32) & (BYTES < 127) & ~LETTER & ~DIGIT
CLASSES = (
    (BYTES >= 65) & (BYTES <= 90), DIGIT, SPACE, np.isin(BYTES, [44, 46, 59, 58]), MARK & ~np.isin(BYTES, [44, 46, 59, 58, 124]),
    BYTES == 124, BYTES >= 128,
)
_rng = np.random.default_rng(1)
BYTE_HASH = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
PLACE_HASH = _rng.integers(1, 1 << 63, 1024, dtype=np.uint64) | np.uint64(1)


def _stretches(data: np.ndarray, breaks: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and hash of each stretch between breaking bytes; rows break too."""
    inside = ~breaks
    begins = inside.copy()
    begins[1:] &= breaks[:-1]
    begins[row_starts] = inside[row_starts]
    begin = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= breaks[1:]
    stops[row_starts[1:] - 1] = inside[row_starts[1:] - 1]
    end = np.flatnonzero(stops) + 1
    if not len(begin):
        return begin, end, np.zeros(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data))))[: len(data)] if begin[0] == 0 else np.arange(
        len(data)
    ) - np.concatenate([np.zeros(begin[0], np.int64), np.repeat(begin, np.diff(np.append(begin, len(data))))])
    part = BYTE_HASH[data] * PLACE_HASH[place & 1023]
    part[breaks] = 0
    return begin, end, np.add.reduceat(part, begin)


def features(texts: pa.Array) -> np.ndarray:
    """Rows x features. Null and empty texts are all zero."""
    return np.concatenate([_features(c) for c in vocabulary.chunks(texts, CHUNK_BYTES)] or [np.zeros((0, len(FEATURES)))])


def _features(texts: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    sizes = np.diff(offsets)
    out = np.zeros((len(texts), len(FEATURES)))
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return out
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    size = sizes[filled].astype(np.float64)
    starts = (offsets[:-1] - offsets[0])[filled]
    columns = [np.log1p(size)]
    shares = [np.add.reduceat(c[data].astype(np.int32), starts) / size for c in CLASSES]

    def per_row(at: np.ndarray, weights=None) -> np.ndarray:
        return np.bincount(np.searchsorted(starts, at, side="right") - 1, weights, len(filled))

    begin, end, word = _stretches(data, SPACE[data], starts)
    words = np.maximum(per_row(begin), 1)
    length = end - begin
    row = np.searchsorted(starts, begin, side="right") - 1
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    mixed = word ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(mixed, return_index=True)
    line_begin, _, line = _stretches(data, data == 10, starts)
    line_row = np.searchsorted(starts, line_begin, side="right") - 1
    _, first_line = np.unique(line ^ (line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    lines = np.maximum(per_row(line_begin), 1)
    marked = MARK[data[end - 1]] & ~np.isin(data[end - 1], [44, 46, 59, 58]) if len(end) else np.zeros(0, bool)
    columns += [
        np.log1p(per_row(begin)), per_row(begin, length) / words, shares[0], shares[1], shares[2], shares[3], shares[4], shares[5], shares[6],
        lines / words, per_row(begin, length <= 2) / words, per_row(begin, length >= 14) / words, per_row(begin, marked) / words,
        per_row(begin[first]) / words, per_row(begin, same) / words, per_row(line_begin[first_line]) / lines,
    ]
    out[filled] = np.stack(columns, 1)
    return out


class AdditiveModel:
    """Sum of one table per feature and one per pair; fitted on the driver on a bounded sample."""

    def __init__(self, bins: int = 32, pair_bins: int = 8, rounds: int = 80, pairs: int = 6, rate: float = 0.15):
        self.bins, self.pair_bins, self.rounds, self.pair_count, self.rate = bins, pair_bins, rounds, pairs, rate
        self.intercept, self.edges, self.tables, self.pairs, self.pair_edges, self.pair_tables = 0.0, [], [], [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.intercept = float(np.log(share / (1 - share)))
        if len(np.unique(y)) < 2:
            return self
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        binned = [np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)]
        margin = np.full(len(y), self.intercept)
        for _ in range(self.rounds):
            for table, own in zip(self.tables, binned):
                slope, curve = self._sums(y, margin, own, len(table))
                step = self.rate * shallow_tree(slope, curve)
                table += step
                margin += step[own]
        coarse = [np.unique(np.quantile(c, np.linspace(0, 1, self.pair_bins + 1)[1:-1])) for c in x.T]
        placed = [np.searchsorted(e, c, side="right") for e, c in zip(coarse, x.T)]
        gains = []
        for i in range(x.shape[1]):
            for j in range(i):
                shape = len(coarse[i]) + 1, len(coarse[j]) + 1
                slope, curve = self._sums(y, margin, placed[i] * shape[1] + placed[j], shape[0] * shape[1])
                gains.append((quadrants(slope.reshape(shape), curve.reshape(shape))[0], i, j))
        for _, i, j in sorted(gains, reverse=True)[: self.pair_count]:
            self.pairs.append((i, j))
            self.pair_edges.append((coarse[i], coarse[j]))
            self.pair_tables.append(np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)))
        for _ in range(self.rounds // 4):
            for (i, j), table in zip(self.pairs, self.pair_tables):
                slope, curve = self._sums(y, margin, placed[i] * table.shape[1] + placed[j], table.size)
                step = self.rate * quadrants(slope.reshape(table.shape), curve.reshape(table.shape))[1]
                table += step
                margin += step[placed[i], placed[j]]
        return self

    @staticmethod
    def _sums(y, margin, bins, number):
        p = 1 / (1 + np.exp(-margin))
        return np.bincount(bins, y - p, number), np.bincount(bins, p * (1 - p), number)

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.intercept)
        for edges, table, column in zip(self.edges, self.tables, x.T):
            margin += table[np.searchsorted(edges, column, side="right")]
        for (i, j), (a, b), table in zip(self.pairs, self.pair_edges, self.pair_tables):
            margin += table[np.searchsorted(a, x[:, i], side="right"), np.searchsorted(b, x[:, j], side="right")]
        return 1 / (1 + np.exp(-margin))


def shallow_tree(slope: np.ndarray, curve: np.ndarray, leaves: int = 4, ridge: float = 2.0) -> np.ndarray:
    """Steps of a tree over ordered bins: the best cut, repeated until there are ``leaves`` leaves."""
    g, h = np.concatenate([[0], np.cumsum(slope)]), np.concatenate([[0], np.cumsum(curve)])
    bounds = [0, len(slope)]
    value = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(bounds, bounds[1:]):
            cuts = np.arange(a + 1, b)
            if len(cuts):
                gain = value(a, cuts) + value(cuts, b) - value(a, b)
                best = max(best, (float(gain.max()), int(cuts[gain.argmax()])), key=lambda x: x[0])
        if best[1] is None:
            break
        bounds = sorted([*bounds, best[1]])
    steps = [(g[b] - g[a]) / (h[b] - h[a] + ridge) for a, b in zip(bounds, bounds[1:])]
    return np.repeat(steps, np.diff(bounds))


def quadrants(slope: np.ndarray, curve: np.ndarray, ridge: float = 2.0) -> tuple[float, np.ndarray]:
    """Gain and steps of the best cut of a table in both directions at once."""
    g, h = slope.cumsum(0).cumsum(1), curve.cumsum(0).cumsum(1)
    step = np.zeros(slope.shape)
    if min(slope.shape) < 2:
        return 0.0, step

    def corners(c):
        inner = c[:-1, :-1]
        return inner, c[:-1, -1:] - inner, c[-1:, :-1] - inner, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + inner

    parts = list(zip(corners(g), corners(h)))
    gain = sum(a**2 / (b + ridge) for a, b in parts) - g[-1, -1] ** 2 / (h[-1, -1] + ridge)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    leaf = [a[i, j] / (b[i, j] + ridge) for a, b in parts]
    step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = leaf
    return float(gain[i, j]), step


def held_out(key: str = "alarm_event_id") -> Column:
    """Rows that are never learned from; also those without an id."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(True))


def fit_quality(alarms: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> AdditiveModel:
    """Fit on at most ``sample_rows`` labelled alarms (those of smallest hash) that are not held out."""
    known = (
        labels.where(F.col("quality").isNotNull() & ~held_out())
        .groupBy("alarm_event_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("alarm_event_id"))
        .limit(sample_rows)
        .withColumnRenamed("alarm_event_id", "_known_id")
    )
    texts = alarms.join(F.broadcast(known), alarms.alarm_event_id == known._known_id).select("alarm_event_id", "alarm_name", "quality")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("alarm_name"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("alarm_event_id"), batch.column("quality").cast(pa.int32()), *(pa.array(c) for c in x.T)],
                ["alarm_event_id", "quality", *FEATURES],
            )

    key = alarms.schema["alarm_event_id"].dataType.simpleString()
    numbers = ", ".join(f"{name} double" for name in FEATURES)
    measured = texts.mapInArrow(measure, f"alarm_event_id {key}, quality int, {numbers}").dropDuplicates(["alarm_event_id"]).toPandas()
    measured = measured.sort_values("alarm_event_id")
    return AdditiveModel().fit(measured[list(FEATURES)].to_numpy(), (measured["quality"].to_numpy() > 0).astype(float))


def alarm_quality(alarms: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = 20_000) -> DataFrame:
    """Quality of every alarm message: alarm_event_id, held_out, score and predicted.

    ``labels`` has alarm_event_id and quality (0 or 1, null: unknown; of several
    the largest counts). Only texts are scored; a text alone decides. ``score``
    is the probability of label 1, ``predicted`` 1 from ``threshold`` on. Null
    and empty messages are scored by their zero features; very long ones are
    read whole. Null ids are held out; repeated rows give a row each; without
    labels, or with one kind of them, all get the share of ones. Other columns
    are left out.
    """
    model = fit_quality(alarms, labels, sample_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("alarm_event_id"), pa.array(model.scores(features(batch.column("alarm_name"))), pa.float64())],
                ["alarm_event_id", "score"],
            )

    key = alarms.schema["alarm_event_id"].dataType.simpleString()
    scored = alarms.select("alarm_event_id", "alarm_name").mapInArrow(score, f"alarm_event_id {key}, score double")
    return scored.select("alarm_event_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
