"""Evaluation messages inside training alarms, found by spaced seeds.

Two aligned windows of words that differ in ``substitutions`` places agree in
two of ``substitutions`` + 2 blocks at least. Each mask keeps one pair of blocks
and ignores the other positions, so a hash join per mask finds every such pair
of windows; the aligned words around each hit are then compared one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringwatch.storage import Scratch

# fixed values: ranges of kana, Han, Thai, Lao, Burmese and Khmer, which write no spaces between words
UNSPACED = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
#: a run of word characters; a character of a script without spaces is a word of its own
WORD = re.compile(f"[{UNSPACED}]|[^\\W{UNSPACED}]+")
WORDS_AT_ONCE = 1 << 20
#: bits of the filter that keeps hopeless positions out of the join, and where a seed's bins are cut from it;
#: its 4 MB do not grow with any table, a filter that fills up only lets more through
FILTER_BITS, FILTER_SHIFTS = 25, (39, 17, 0)
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def masks(window: int, substitutions: int) -> list[list[int]]:
    """Positions kept by each mask: two of ``substitutions`` + 2 blocks of the window."""
    blocks = np.array_split(np.arange(window), min(substitutions + 2, window))
    if len(blocks) == 1:
        return [list(range(window))]
    return [sorted([*a.tolist(), *b.tolist()]) for a, b in combinations(blocks, 2)]


class WordHashes(dict):
    """64-bit hashes of lower-cased words, kept across texts up to a bound."""

    def __missing__(self, word: str) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word.encode(), 7)
        return found

    def of(self, text: str | None) -> np.ndarray:
        if len(self) > 500_000:
            self.clear()
        words = WORD.findall((text or "").lower())
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def seed_hashes(words: np.ndarray, window: int, number: int, mask: list[int]) -> np.ndarray:
    """Hash of the kept words of every window; ``number`` tells masks and window lengths apart."""
    places = len(words) - window + 1
    out = np.full(max(places, 0), number * 0x9E3779B1 + window, np.uint64)
    for i, position in enumerate(mask if places > 0 else ()):
        out *= MULTIPLIERS[i % 4]
        out ^= out >> np.uint64(29)
        out += words[position : position + places]
    out *= MULTIPLIERS[0]
    return out ^ out >> np.uint64(31)


def tolerated(window: int, whole: int, substitutions: int) -> int:
    """Fewer substitutions in proportion for items shorter than a whole window."""
    return substitutions * window // whole


def longest_overlap(left: np.ndarray, right: np.ndarray, window: int, substitutions: int) -> tuple[int, int, int]:
    """Words covered by windows with at most ``substitutions`` differences, how many agree, and the first place."""
    same = left == right
    total = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(total[window:] - total[:-window] >= window - substitutions)
    if not len(good):
        return 0, 0, -1
    covered = np.zeros(len(same) + 1, np.int64)
    np.add.at(covered, good, 1)
    np.add.at(covered, good + window, -1)
    inside = np.cumsum(covered)[:-1] > 0
    return int(inside.sum()), int(same[inside].sum()), int(good[0])


def contaminated_alarms(
    alarms: DataFrame,
    evaluation: DataFrame,
    window: int = 13,
    substitutions: int = 2,
    exact_below: int = 8,
    alone_below: int = 3,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Which evaluation messages each alarm contains.

    ``evaluation`` has item_id and alarm_name. An alarm contains an item if
    ``window`` consecutive words of both agree but for ``substitutions`` places
    at most. Shorter items are their own window, with substitutions in
    proportion; of fewer than ``exact_below`` words none is allowed, and of fewer
    than ``alone_below`` words the item has to be the whole message, since such
    words stand in many. Words are runs of word characters, lower-cased; in
    scripts without spaces every character is one. Items without words are
    nowhere.

    Returns alarm_event_id, item_id, first_word (of the alarm's first such
    window), overlap_words (item words inside such windows, at the best
    alignment) and same_words: one row per pair. Null, empty and short messages
    contain nothing. Alarms are told apart by id; rows that share an id (or
    have none) give a row for their best overlap. Items with the same words give
    rows of their own. Empty tables give no rows; other columns are left out.
    """
    scratch = scratch or Scratch(alarms.sparkSession)
    spark = alarms.sparkSession

    def allowed(size: int) -> int:
        return tolerated(size, window, substitutions) if size >= exact_below else 0

    def item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHashes()
        for batch in batches:
            lists = [hashed.of(t.as_py()) for t in batch.column("alarm_name")]
            keep = [i for i, w in enumerate(lists) if len(w)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item_id").take(pa.array(keep, pa.int64())),
                    pa.array([lists[i].view(np.int64).tolist() for i in keep], pa.list_(pa.int64())),
                    pa.array([min(window, len(lists[i])) for i in keep], pa.int32()),
                ],
                ["item_id", "words", "size"],
            )

    item_key = evaluation.schema["item_id"].dataType.simpleString()
    item_rows = scratch.stage(
        evaluation.select("item_id", "alarm_name")
        .mapInArrow(item_words, f"item_id {item_key}, words array<bigint>, size int")
        .withColumn("text_no", F.xxhash64("words")),
        "items",
    )
    items = item_rows.select("text_no", "words", "size").dropDuplicates(["text_no"])
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most a window of them
    plans = [
        (size, number, mask)
        for size in sizes
        for number, mask in enumerate(masks(size, allowed(size)))
    ]

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text_no, words, own in zip(*(batch.column(c).to_pylist() for c in ("text_no", "words", "size"))):
                words = np.array(words, np.int64).view(np.uint64)
                for size, number, mask in plans:
                    if size == own:
                        seeds = seed_hashes(words, size, number, mask).view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(seeds), pa.array([text_no] * len(seeds), pa.int64()), pa.array(np.arange(len(seeds), dtype=np.int32))],
                            ["seed", "text_no", "item_place"],
                        )

    seeds = scratch.stage(
        items.select("text_no", "words", "size").mapInArrow(item_seeds, "seed bigint, text_no bigint, item_place int"), "seeds"
    )
    # three bits per seed, of a fixed number of bits, whatever the evaluation holds
    cuts = [F.shiftrightunsigned("seed", s).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) for s in FILTER_SHIFTS]
    bins = seeds.select(F.explode(F.array(*cuts)).alias("bin")).distinct()
    words_of_filter = (
        bins.groupBy(F.shiftright("bin", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bin & 63 as int))")).alias("bits"))
    ).toPandas()
    sieve = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    sieve[words_of_filter["word"].to_numpy(np.int64)] = words_of_filter["bits"].to_numpy(np.int64).view(np.uint64)
    sent = spark.sparkContext.broadcast(sieve)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, kept = WordHashes(), sent.value

        def found_in(keys: list, lists: list[np.ndarray]) -> pa.RecordBatch:
            """Windows of many alarms at once; those that reach over an alarm's end are none."""
            words, lengths = np.concatenate(lists), np.array([len(x) for x in lists])
            ends = np.cumsum(lengths)
            seeds_found, places, rows = [], [], []
            for size, number, mask in plans:
                own = seed_hashes(words, size, number, mask)
                hit = np.arange(len(own))
                for shift in FILTER_SHIFTS:
                    at = own[hit] >> np.uint64(shift) & np.uint64((1 << FILTER_BITS) - 1)
                    hit = hit[(kept[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)]
                row = np.searchsorted(ends, hit, side="right")
                inside = hit + size <= ends[row]
                if size < alone_below:
                    inside &= lengths[np.minimum(row, len(lengths) - 1)] == size
                seeds_found.append(own[hit[inside]])
                places.append(hit[inside])
                rows.append(row[inside])
            seeds_found, places, rows = map(np.concatenate, (seeds_found, places, rows))
            order = np.argsort(rows, kind="stable")
            used, begins = np.unique(rows[order], return_index=True)
            parts = [order[a:b] for a, b in zip(begins, [*begins[1:], len(order)])]
            starts = ends - [len(x) for x in lists]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[i] for i in used], key_type),
                    pa.array([seeds_found[p].view(np.int64) for p in parts], pa.list_(pa.int64())),
                    pa.array([(places[p] - starts[i]).astype(np.int32) for i, p in zip(used, parts)], pa.list_(pa.int32())),
                    pa.array([lists[i].view(np.int64) for i in used], pa.list_(pa.int64())),
                ],
                ["alarm_event_id", "seeds", "places", "words"],
            )

        for batch in batches:
            key_type = batch.column("alarm_event_id").type
            keys, lists, held = [], [], 0
            for key, text in zip(batch.column("alarm_event_id").to_pylist(), batch.column("alarm_name")):
                keys.append(key)
                lists.append(hashed.of(text.as_py()))
                held += len(lists[-1])
                if plans and held >= WORDS_AT_ONCE:
                    yield found_in(keys, lists)
                    keys, lists, held = [], [], 0
            if plans and held:
                yield found_in(keys, lists)

    if not plans:  # no item has words
        return spark.createDataFrame([], f"alarm_event_id {alarms.schema['alarm_event_id'].dataType.simpleString()}, item_id {item_key}, first_word bigint, overlap_words bigint, same_words bigint")
    key = alarms.schema["alarm_event_id"].dataType.simpleString()
    touched = scratch.stage(
        alarms.select("alarm_event_id", "alarm_name")
        .mapInArrow(hits, f"alarm_event_id {key}, seeds array<bigint>, places array<int>, words array<bigint>")
        .withColumn("row_no", F.monotonically_increasing_id()),
        "touched",
    )
    lined_up = (
        touched.select("row_no", F.explode(F.arrays_zip("seeds", "places")).alias("hit"))
        .select("row_no", F.col("hit.seeds").alias("seed"), F.col("hit.places").alias("place"))
        .join(seeds, "seed")
        .select("row_no", "text_no", (F.col("place") - F.col("item_place")).alias("shift"))
        .distinct()
    )
    # each item is laid over the words of the alarm at the shift of the hit; places outside hold nothing
    pairs = (
        lined_up.join(touched.select("row_no", "alarm_event_id", F.col("words").alias("alarm_words")), "row_no")
        .withColumn("from", F.greatest("shift", F.lit(0)))
        .join(items.select("text_no", "words", "size"), "text_no")
        .withColumn("skipped", F.col("from") - F.col("shift"))
        .withColumn("item_words", F.expr("slice(words, skipped + 1, size(words))"))
        .withColumn("alarm_words", F.expr("slice(alarm_words, from + 1, size(item_words))"))
        .select("alarm_event_id", "text_no", "from", "size", "alarm_words", F.expr("slice(item_words, 1, size(alarm_words))").alias("item_words"))
    )

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                longest_overlap(np.asarray(a), np.asarray(b), size, allowed(size))
                for a, b, size in zip(batch["alarm_words"], batch["item_words"], batch["size"])
            ]
            out = batch[["alarm_event_id", "text_no"]].copy()
            out["overlap_words"], out["same_words"], first = zip(*rows) if rows else ((), (), ())
            out["first_word"] = batch["from"] + np.array(first, np.int64)
            yield out[out["overlap_words"] > 0]

    verified = pairs.mapInPandas(
        verify, f"alarm_event_id {key}, text_no bigint, overlap_words bigint, same_words bigint, first_word bigint"
    )
    best = verified.groupBy("alarm_event_id", "text_no").agg(
        F.max(F.struct("overlap_words", "same_words", (-F.col("first_word")).alias("back"))).alias("best")
    )
    named = item_rows.select("text_no", "item_id")
    return best.join(named, "text_no").select(
        "alarm_event_id",
        "item_id",
        (-F.col("best.back")).alias("first_word"),
        F.col("best.overlap_words").alias("overlap_words"),
        F.col("best.same_words").alias("same_words"),
    )


def clean_alarms(alarms: DataFrame, evaluation: DataFrame, scratch: Scratch | None = None, **settings) -> DataFrame:
    """The alarms that contain no evaluation message, with all their columns.

    An alarm without id stays unless a message with its very words is contaminated.
    """
    scratch = scratch or Scratch(alarms.sparkSession)
    identity = F.coalesce(F.col("alarm_event_id").cast("string"), F.concat(F.lit("#"), F.md5("alarm_name")))
    marked = alarms.withColumn("_clean_key", identity)
    found = contaminated_alarms(
        marked.select(F.col("_clean_key").alias("alarm_event_id"), "alarm_name"), evaluation, scratch=scratch, **settings
    )
    rejected = scratch.stage(found.select(F.col("alarm_event_id").alias("_clean_key")).distinct(), "rejected")
    return marked.join(rejected, "_clean_key", "left_anti").select(*alarms.columns)
