"""Phrases of alarm messages whose words come together more often than by chance.

Messages are parsed prefix-free: pieces between punctuation marks, long ones cut
wherever a window of words triggers, are chunks, which overlap by the words of a
window. Distinct chunks with their numbers form a dictionary, and everything is
counted there: a phrase in a chunk counts as often as the chunk, and belongs to
the chunk in which it begins before the overlap, so that none counts twice.

Counting goes up by length. Words are counted as such; pairs of frequent words,
then longer phrases of frequent pairs, by hashes of 96 bits together with
one chunk that holds them, from which the words of those that reach the limit
are read in the end. Which hashes are frequent is told to tasks by a bit sieve
of fixed size: more data let more rare phrases through to the next count, and
change no result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stringwatch.storage import Scratch

#: pieces up to so many words are one chunk; in longer ones one window in so many triggers
WHOLE_WORDS, TRIGGER = 24, 16
#: bits of the sieve, 4 MB at any input, and the places of a hash in it
SIEVE_BITS, SIEVE_SHIFTS = 25, (0, 19, 39)
#: bytes of chunks that a task counts at once
CHUNK_BYTES = 8 << 20
#: fixed values: signs that end a piece
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
LETTERS = bytes.maketrans(PIECE_ENDS + b"\t", b"\n" * len(PIECE_ENDS) + b" ")


def chunks_of(words: list[bytes], overlap: int) -> Iterator[tuple[int, bytes]]:
    """The chunks of a piece, each with the number of its words at which phrases are counted."""
    begin = 0
    if len(words) > WHOLE_WORDS:
        for i in range(1, len(words) - overlap):
            if zlib.crc32(b" ".join(words[i : i + overlap])) % TRIGGER == 0:
                yield i - begin, b" ".join(words[begin : i + overlap])
                begin = i
    yield len(words) - begin, b" ".join(words[begin:])


def parsed_chunks(alarms: DataFrame, overlap: int) -> DataFrame:
    """The dictionary of the parse: alarm_code, own (words at which phrases are counted), chunk, number."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for code, text in zip(batch.column("alarm_code").to_pylist(), batch.column("alarm_name")):
                for piece in (text.as_py() or "").encode().lower().translate(LETTERS).split(b"\n"):
                    words = piece.split()
                    if words:
                        found.update((code, own, chunk) for own, chunk in chunks_of(words, overlap))
            codes, owns, chunks = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(codes, batch.column("alarm_code").type),
                    pa.array(owns, pa.int32()),
                    pa.array(chunks, pa.binary()).cast(pa.string()),
                    pa.array(found.values(), pa.int64()),
                ],
                ["alarm_code", "own", "chunk", "number"],
            )

    kind = alarms.schema["alarm_code"].dataType.simpleString()
    parts = alarms.select("alarm_code", "alarm_name").mapInArrow(parse, f"alarm_code {kind}, own int, chunk string, number bigint")
    return parts.groupBy("alarm_code", "own", "chunk").agg(F.sum("number").alias("number"))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to about ``CHUNK_BYTES``."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _mixed(values: np.ndarray, more: np.ndarray) -> np.ndarray:
    values = (values ^ more) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def _hash(text: str | None, seed: int = 5) -> int:
    return 0 if text is None else xxhash.xxh64_intdigest(text.encode(), seed)


class Positions:
    """The words of many chunks side by side, with the hashes of the phrases that begin at each."""

    def __init__(self, table: pa.Table, longest: int):
        def column(name: str) -> pa.Array:
            whole = table.column(name).combine_chunks()
            return whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole

        lists = pc.split_pattern(column("chunk").cast(pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        self.words, self.codes = coded.dictionary.to_pylist(), np.asarray(coded.indices, np.int64)
        sizes = np.diff(np.asarray(lists.offsets, np.int64))
        rows = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.left = sizes[rows] - place
        self.counted = place < np.asarray(column("own"), np.int64)[rows]
        self.weight = np.asarray(column("number"), np.int64)[rows]
        groups = pc.fill_null(column("alarm_code").cast(pa.string()), pa.scalar("\0")).dictionary_encode()
        self.groups = [None if g == "\0" else g for g in groups.dictionary.to_pylist()]
        self.group = np.asarray(groups.indices, np.int64)[rows]
        self.chunk = np.asarray(column("chunk_no"), np.int64)[rows]
        self.keys = self._hashes(longest, 5)
        # 96 bits tell phrases apart, half of the second hash is enough
        self.checks = {m: (h >> np.uint64(32)).astype(np.uint32).view(np.int32) for m, h in self._hashes(longest, 6).items()}

    def _hashes(self, longest: int, seed: int) -> dict[int, np.ndarray]:
        words = np.fromiter((_hash(w, seed) for w in self.words), np.uint64, len(self.words))[self.codes]
        base = np.fromiter((_hash(g, seed) for g in self.groups), np.uint64, len(self.groups))[self.group]
        out = {1: _mixed(base, words)}
        for m in range(2, longest + 1):
            out[m] = _mixed(out[m - 1][:-1], words[m - 1 :])
        return out

    def begins(self, m: int) -> np.ndarray:
        """Whether a phrase of m words begins at each place and lies within its chunk."""
        return self.left[: len(self.keys[m])] >= m


def _in_sieve(sieve: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for shift in SIEVE_SHIFTS:
        at = keys >> np.uint64(shift) & np.uint64((1 << SIEVE_BITS) - 1)
        found &= (sieve[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def _sieve(keys: DataFrame) -> np.ndarray:
    """Bits of all keys (bigint); at most 2 ** SIEVE_BITS / 64 rows reach the driver."""
    cuts = [F.shiftrightunsigned("key", s).bitwiseAND(F.lit((1 << SIEVE_BITS) - 1)) for s in SIEVE_SHIFTS]
    words = (
        keys.select(F.explode(F.array(*cuts)).alias("bin"))
        .groupBy(F.shiftright("bin", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bin & 63 as int))")).alias("bits"))
        .toPandas()
    )
    sieve = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    sieve[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return sieve


def _frequent(positions: Positions, sieve: np.ndarray, m: int) -> np.ndarray:
    """Places where all m words (m = 2) or all pairs of the m words may be frequent."""
    part = 1 if m == 2 else 2
    single = _in_sieve(sieve, positions.keys[part])
    found = positions.begins(m)
    for i in range(m - part + 1):
        found &= single[i : i + len(found)]
    return found


def counted_keys(chunks: DataFrame, sieve: np.ndarray, lengths: list[int], least: int) -> DataFrame:
    """key and check of the phrases of these lengths that reach the limit, occurrences, and the chunk_no of one chunk with them."""
    sent = chunks.sparkSession.sparkContext.broadcast(sieve)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _together(batches):
            positions = Positions(table, max(lengths))
            parts = []
            for m in lengths:
                at = np.flatnonzero(_frequent(positions, sent.value, m) & positions.counted[: len(positions.keys[m])])
                parts.append((positions.keys[m][at], positions.checks[m][at], positions.weight[at], positions.chunk[at]))
            keys, checks, weights, places = map(np.concatenate, zip(*parts))
            order = np.lexsort((checks, keys))
            keys, checks, weights = keys[order], checks[order], weights[order]
            begins = np.flatnonzero(np.append(len(keys) > 0, (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[begins].view(np.int64)),
                    pa.array(checks[begins]),
                    pa.array(np.add.reduceat(weights, begins) if len(begins) else weights),
                    pa.array(places[order][begins].astype(np.int32)),
                ],
                ["key", "check", "occurrences", "chunk_no"],
            )

    counted = chunks.mapInArrow(count, "key bigint, check int, occurrences bigint, chunk_no int")
    found = counted.groupBy("key", "check").agg(F.sum("occurrences").alias("occurrences"), F.min("chunk_no").alias("chunk_no"))
    return found.where(F.col("occurrences") >= least)


def named_phrases(chunks: DataFrame, frequent: DataFrame, longest: int) -> DataFrame:
    """alarm_code, phrase and occurrences: the words of the frequent phrases, read from the chunks named with them."""
    pairs = frequent.select(F.col("key").bitwiseXOR(F.col("chunk_no").cast("bigint")).alias("key"))
    sent = chunks.sparkSession.sparkContext.broadcast(_sieve(pairs))
    kind = chunks.schema["alarm_code"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _together(batches):
            positions = Positions(table, longest)
            codes, names = positions.codes, positions.words
            for m in range(2, longest + 1):
                keys, checks = positions.keys[m].view(np.int64), positions.checks[m]
                wanted = _in_sieve(sent.value, (keys ^ positions.chunk[: len(keys)]).view(np.uint64))
                at = np.flatnonzero(wanted & positions.begins(m) & positions.counted[: len(keys)])
                phrases = [" ".join(names[c] for c in codes[b : b + m].tolist()) for b in at.tolist()]
                groups = pa.array([positions.groups[g] for g in positions.group[at].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[at]), pa.array(checks[at]), pa.array(positions.chunk[at].astype(np.int32)),
                        groups.cast(table.schema.field("alarm_code").type), pa.array(phrases, pa.string()),
                    ],
                    ["key", "check", "chunk_no", "alarm_code", "phrase"],
                )

    found = chunks.mapInArrow(read, f"key bigint, check int, chunk_no int, alarm_code {kind}, phrase string")
    joined = found.join(frequent, ["key", "check", "chunk_no"])
    return joined.groupBy("key", "check").agg(
        F.first(F.struct("alarm_code", "phrase", "occurrences")).alias("one")  # all alike
    ).select("one.*")


def _word_keys(words: DataFrame) -> DataFrame:
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = [None if g is None else str(g) for g in batch.column("alarm_code").to_pylist()]
            base = np.fromiter(map(_hash, groups), np.uint64, len(groups))
            own = np.fromiter(map(_hash, batch.column("phrase").to_pylist()), np.uint64, len(groups))
            yield pa.RecordBatch.from_arrays([pa.array(_mixed(base, own).view(np.int64))], ["key"])

    return words.select("alarm_code", "phrase").mapInArrow(keyed, "key bigint")


def _phrase(words: Column, begin: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words, begin, length), " ")


def weakest_cuts(phrases: DataFrame, parts: DataFrame, totals: DataFrame) -> DataFrame:
    """Every phrase with the counts and the score of its lowest-scoring cut, the first of equal ones.

    The score is floor(1000 * occurrences * words / (first part * rest)), in
    exact whole numbers of up to 38 digits.
    """
    split = F.split("phrase", " ")
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.size(split) - 1)).alias("cut")).select(
        "alarm_code", "phrase", "occurrences", "cut",
        _phrase(split, 1, F.col("cut")).alias("first_part"),
        _phrase(split, F.col("cut") + 1, F.size(split) - F.col("cut")).alias("rest"),
    )

    def counted(frame: DataFrame, part: str, name: str) -> DataFrame:
        other = parts.select(F.col("alarm_code").alias("_code"), F.col("phrase").alias("_part"), F.col("occurrences").alias(name))
        return frame.join(other, F.col("alarm_code").eqNullSafe(F.col("_code")) & (F.col(part) == F.col("_part"))).drop("_code", "_part")

    both = counted(counted(cuts, "first_part", "first_occurrences"), "rest", "rest_occurrences")
    sized = both.join(totals.withColumnRenamed("alarm_code", "_code"), F.col("alarm_code").eqNullSafe(F.col("_code"))).drop("_code")
    exact = {c: f"cast({c} as decimal(19, 0))" for c in ("occurrences", "words", "first_occurrences", "rest_occurrences")}
    score = F.expr(
        f"({exact['occurrences']} * {exact['words']} * cast(1000 as decimal(4, 0))) div ({exact['first_occurrences']} * {exact['rest_occurrences']})"
    )
    best = F.min(F.struct(score.alias("score"), "cut", "first_occurrences", "rest_occurrences")).alias("best")
    return (
        sized.groupBy("alarm_code", "phrase", "occurrences", "words")
        .agg(best)
        .select("alarm_code", "phrase", "occurrences", "words", "best.first_occurrences", "best.rest_occurrences", "best.score")
    )


def not_covered(phrases: DataFrame, covered_percent: int) -> DataFrame:
    """The phrases that lie in no longer phrase with ``covered_percent`` of their occurrences."""
    split = F.split("phrase", " ")
    inner = (
        phrases.select("alarm_code", "occurrences", split.alias("w"))
        .where(F.size("w") > 2)
        .select("alarm_code", "occurrences", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("m"))
        .select("alarm_code", "occurrences", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("i"))
        .select(F.col("alarm_code").alias("_code"), _phrase(F.col("w"), F.col("i"), F.col("m")).alias("_inner"), "occurrences")
        .groupBy("_code", "_inner")
        .agg(F.max("occurrences").alias("_most"))
    )
    covers = (
        F.col("alarm_code").eqNullSafe(F.col("_code"))
        & (F.col("phrase") == F.col("_inner"))
        & (F.col("_most") * 100 >= F.col("occurrences") * covered_percent)
    )
    return phrases.join(inner, covers, "left_anti")


def alarm_phrases(
    alarms: DataFrame,
    longest: int = 5,
    least: int = 100,
    covered_percent: int = 100,
    first: int = 2000,
    scratch: Scratch | None = None,
) -> DataFrame:
    """The ``first`` phrases of 2 to ``longest`` words of each alarm_code, by score.

    Messages are lower-cased (A-Z) and split at ``. , ; : ! ?`` and line ends;
    phrases lie within pieces and occur ``least`` times or more, overlaps
    included. The score of a phrase is that of its weakest cut in two, see
    :func:`weakest_cuts`; phrases that a longer one covers are left out. Returns
    alarm_code, rank (from 1; by score, occurrences, then phrase), phrase,
    occurrences, first_occurrences, rest_occurrences, words (of all messages of
    the code) and score. A null alarm_code is a code of its own. Null and empty
    messages have no words; repeated rows count each; ids are not looked at.
    Empty tables give no rows; other columns are left out.
    """
    scratch = scratch or Scratch(alarms.sparkSession)
    chunks = scratch.stage(parsed_chunks(alarms, longest - 1), "chunks", codec="zstd")
    chunks = chunks.withColumn("chunk_no", F.hash("alarm_code", "own", "chunk"))
    totals = scratch.stage(chunks.groupBy("alarm_code").agg(F.sum(F.col("own") * F.col("number")).alias("words")), "totals")
    words = (
        chunks.select("alarm_code", "number", F.explode(F.slice(F.split("chunk", " "), F.lit(1), F.col("own"))).alias("phrase"))
        .groupBy("alarm_code", "phrase")
        .agg(F.sum("number").alias("occurrences"))
        .where(F.col("occurrences") >= least)
    )
    words = scratch.stage(words, "words")
    pairs = scratch.stage(counted_keys(chunks, _sieve(_word_keys(words)), [2], least), "pairs")
    frequent = pairs
    if longest > 2:
        frequent = pairs.unionAll(scratch.stage(counted_keys(chunks, _sieve(pairs), list(range(3, longest + 1)), least), "longer"))
    phrases = scratch.stage(named_phrases(chunks, frequent, longest), "phrases")
    scored = scratch.stage(weakest_cuts(phrases, words.unionByName(phrases), totals), "scored")
    order = Window.partitionBy("alarm_code").orderBy(F.desc("score"), F.desc("occurrences"), "phrase")
    return (
        not_covered(scored, covered_percent)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= first)
        .select("alarm_code", "rank", "phrase", "occurrences", "first_occurrences", "rest_occurrences", "words", "score")
    )
