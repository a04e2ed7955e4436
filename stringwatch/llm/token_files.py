"""Token ids of alarm messages as Huffman-coded files.

Ids are counted over the whole table, which gives one length-limited canonical
Huffman code. Messages are put in ascending order of their ids; tasks write
blocks that decode on their own, with the bit offset of every 256th id, so that
a reader decodes all stretches of many blocks side by side with one table.

A file set is a folder: ``codebook`` has a row per id that occurs (token_id,
code_bits), ``blocks`` a row per block (range_no, block_no, block_start, keys,
lengths, checkpoints, payload); payloads are big-endian 32-bit words.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringwatch.llm import vocabulary
from stringwatch.storage import stage, staging_path

#: longest code; 2 ** CODE_BITS entries in the table of a reader
CODE_BITS = 18
STRETCH = 256
BLOCK_IDS = 1 << 16
JOINED_PIECES = 2_000


def limited_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package merging; counts are positive."""
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes longer than {limit} bits")
    if n == 1:
        return np.ones(1, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)
        merged = merged[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, symbol)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    steps = (1 << (lengths.max() - lengths[order])).astype(np.int64)
    codes = np.empty(len(lengths), np.int64)
    codes[order] = (np.cumsum(steps) - steps) >> (lengths.max() - lengths[order])
    return codes


class Codebook:
    """Codes of ids and the table that decodes them."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        order = np.argsort(symbols)
        self.symbols, self.lengths = symbols[order].astype(np.int64), lengths[order].astype(np.int64)
        codes = canonical_codes(self.lengths)
        size = int(self.symbols.max()) + 1
        self.code, self.bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[self.symbols], self.bits[self.symbols] = codes, self.lengths
        self.width = int(self.lengths.max())
        spans = 1 << (self.width - self.lengths)
        self.table = np.zeros(1 << self.width, np.int64)
        by_code = np.argsort(codes << (self.width - self.lengths))
        filled = np.repeat((self.symbols << 5 | self.lengths)[by_code], spans[by_code])
        self.table[: len(filled)] = filled

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Words of the bit stream, and the bit offset of every ``STRETCH``-th id."""
        bits = self.bits[ids]
        ends = np.cumsum(bits)
        begins = ends - bits
        words = int(ends[-1] + 31) // 32 + 1
        values = self.code[ids] << (64 - (begins & 31) - bits).astype(np.uint64)
        at = begins >> 5
        # bits of different ids are disjoint: sums are unions, exact below 2 ** 53
        stream = np.bincount(at, (values >> np.uint64(32)).astype(np.float64), words + 1)
        stream += np.bincount(at + 1, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), words + 1)
        return stream[:words].astype(">u4").tobytes(), begins[::STRETCH]

    def decode(self, payloads: list[bytes], checkpoints: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
        """The ids of each block, all stretches of all blocks in step."""
        words = np.frombuffer(b"".join(payloads) + bytes(8), ">u4").astype(np.uint64)
        firsts = np.cumsum([0] + [len(p) * 8 for p in payloads[:-1]])
        at = np.concatenate([c + f for c, f in zip(checkpoints, firsts)])
        left = np.concatenate([np.minimum(STRETCH, n - np.arange(0, n, STRETCH)) for n in sizes])
        out = np.zeros((len(at), STRETCH), np.int64)
        mask, lanes = np.uint64((1 << self.width) - 1), np.arange(len(at))
        for k in range(int(left.max(initial=0))):
            if k:
                going = left[lanes] > k
                if not going.all():
                    lanes, at = lanes[going], at[going]
            word = at >> 5
            pair = words[word] << np.uint64(32) | words[word + 1]
            top = (pair >> (64 - self.width - (at & 31)).astype(np.uint64)) & mask
            entry = self.table[top.astype(np.int64)]
            out[lanes, k] = entry >> 5
            at = at + (entry & 31)
        ends = np.cumsum([-(-n // STRETCH) for n in sizes])
        return [out[e - -(-n // STRETCH) : e].reshape(-1)[:n] for n, e in zip(sizes, ends)]


def id_type(tokenizer_path: str, end_id: int) -> str:
    """Smallest unsigned type that holds every id."""
    largest = max(end_id, *vocabulary.load(tokenizer_path).get_vocab().values())
    return "<u2" if largest < 1 << 16 else "<u4"


@functools.lru_cache(2)
def piece_table(tokenizer_path: str, kind: str) -> tuple[vocabulary.PieceTable, list[str]]:
    """Ids of parts of texts, one table for all tasks of a worker, and the special strings.

    A run of letters is merged at once, as the library's own model does it; other
    new parts go through the library many at a time, in one text: a special
    string between them keeps them apart, and its id tells where.
    """
    tokenizer = vocabulary.load(tokenizer_path)
    code, width = np.dtype(kind).char, np.dtype(kind).itemsize  # tasks run on little-endian machines
    special = vocabulary.specials(tokenizer)
    mark = special[0] if special else None
    merge, written = tokenizer.model.tokenize, vocabulary.letters_as_bytes(tokenizer) if tokenizer.normalizer is None else {}

    def ids_of(pieces: list[str]) -> list[bytes]:
        out, alone, joined = [b""] * len(pieces), [], []
        for i, piece in enumerate(pieces):
            if written and vocabulary.PLAIN_PART.match(piece):
                out[i] = array(code, [token.id for token in merge(piece.translate(written))]).tobytes()
            else:
                (alone if mark is None or any(s in piece for s in special) else joined).append(i)
        for i, e in zip(alone, tokenizer.encode_batch_fast([pieces[i] for i in alone], add_special_tokens=False)):
            out[i] = array(code, e.ids).tobytes()
        for begin in range(0, len(joined), JOINED_PIECES):
            some = joined[begin : begin + JOINED_PIECES]
            text = mark.join(pieces[i] for i in some)
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, kind)
            ends = np.append(np.flatnonzero(ids == tokenizer.token_to_id(mark)), len(ids))
            raw, first = ids.tobytes(), 0
            for i, last in zip(some, ends.tolist()):
                out[i] = raw[first * width : last * width]
                first = last + 1
        return out

    return vocabulary.PieceTable(ids_of), special


def encoded(alarms: DataFrame, tokenizer_path: str, end_id: int, kind: str) -> DataFrame:
    """alarm_event_id and ids (little-endian integers of type ``kind``), the end id last."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], kind).tobytes()
        table, special = piece_table(tokenizer_path, kind)
        for batch in batches:
            keys, done = batch.column("alarm_event_id"), 0
            for chunk in vocabulary.chunks(batch.column("alarm_name")):
                parts, index, starts = vocabulary.parts_of(chunk, special)
                ids, ends = vocabulary.gathered(table.values(parts), index, kind)
                stops = np.append(np.append(0, ends)[starts], ends[-1]).tolist()
                rows_ids = [ids[a:b].tobytes() + end for a, b in zip(stops, stops[1:])]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(done, len(chunk)), pa.array(rows_ids, pa.binary())], ["alarm_event_id", "ids"]
                )
                done += len(chunk)

    key = alarms.schema["alarm_event_id"].dataType.simpleString()
    return alarms.select("alarm_event_id", "alarm_name").mapInArrow(encode, f"alarm_event_id {key}, ids binary")


def id_counts(messages: DataFrame, kind: str) -> DataFrame:
    """token_id and how often it occurs in the whole table; at most one row per id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind)
            more = np.bincount(ids, minlength=len(total))
            more[: len(total)] += total
            total = more
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["token_id", "number"])

    return messages.select("ids").mapInArrow(count, "token_id bigint, number bigint").groupBy("token_id").agg(F.sum("number").alias("number"))


def write_alarm_tokens(
    alarms: DataFrame,
    tokenizer_path: str,
    path: str,
    end_id: int = 2,
    block_ids: int = BLOCK_IDS,
    code_bits: int = CODE_BITS,
) -> str:
    """Encode all alarm messages and write them to ``path`` in ascending order of alarm_event_id.

    Null and empty messages are the end id alone; null ids come first; equal ids
    follow each other. A message is never split over blocks, a very long one has
    a block of its own. An empty table gives empty files.
    """
    kind = id_type(tokenizer_path, end_id)
    width = np.dtype(kind).itemsize
    messages = stage(encoded(alarms, tokenizer_path, end_id, kind), "ids", codec="zstd")
    spark, key = messages.sparkSession, messages.schema["alarm_event_id"].dataType.simpleString()
    counted = id_counts(messages, kind).toPandas()  # at most one row per id of the vocabulary
    lengths = limited_lengths(counted["number"].to_numpy(), code_bits) if len(counted) else np.zeros(0, np.int64)
    symbols = counted["token_id"].to_numpy()
    spark.createDataFrame(
        [(int(s), int(n)) for s, n in zip(symbols, lengths)], "token_id bigint, code_bits int"
    ).coalesce(1).write.parquet(f"{path}/codebook")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, keys, waiting, held, start, number = None, [], [], 0, 0, 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(waiting), kind)
            payload, checkpoints = book.encode(ids)
            columns = [
                pa.array([TaskContext.get().partitionId()], pa.int32()),
                pa.array([number], pa.int64()),
                pa.array([start], pa.int64()),
                pa.array([keys], pa.list_(key_type)),
                pa.array([[len(w) // width for w in waiting]], pa.list_(pa.int32())),
                pa.array([checkpoints.tolist()], pa.list_(pa.int64())),
                pa.array([payload], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["range_no", "block_no", "block_start", "keys", "lengths", "checkpoints", "payload"])

        for batch in batches:
            book = book or Codebook(symbols, lengths)
            key_type = batch.schema.field("alarm_event_id").type
            for one, ids in zip(batch.column("alarm_event_id").to_pylist(), batch.column("ids").to_pylist()):
                if waiting and held + len(ids) // width > block_ids:
                    yield block()
                    start, number = start + held, number + 1
                    keys, waiting, held = [], [], 0
                keys.append(one)
                waiting.append(ids)
                held += len(ids) // width
        if waiting:
            yield block()

    ordered = messages.repartitionByRange("alarm_event_id").sortWithinPartitions("alarm_event_id", "ids")
    ordered.mapInArrow(
        blocks,
        f"range_no int, block_no bigint, block_start bigint, keys array<{key}>, lengths array<int>, checkpoints array<bigint>, payload binary",
    ).write.parquet(f"{path}/blocks")
    return path


def read_alarm_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The files back: alarm_event_id, start (ids of all messages before), n_tokens, ids_crc32.

    ``ids`` follow ``with_ids``; they and their checksum are of little-endian 32-bit integers.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    key = blocks.schema["keys"].dataType.elementType.simpleString()
    book = spark.read.parquet(f"{path}/codebook").toPandas()  # at most one row per id of the vocabulary
    sizes = blocks.groupBy("range_no").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))
    starts, total = {}, 0
    for row in sorted(sizes.collect()):  # one row per range
        starts[row.range_no], total = total, total + row.n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = None
        for whole in batches:
            code = code or Codebook(book["token_id"].to_numpy(), book["code_bits"].to_numpy())
            for begin in range(0, whole.num_rows, 32):
                batch = whole.slice(begin, 32)
                lengths = [np.array(x, np.int64) for x in batch.column("lengths").to_pylist()]
                checkpoints = [np.array(x, np.int64) for x in batch.column("checkpoints").to_pylist()]
                found = code.decode(batch.column("payload").to_pylist(), checkpoints, [int(n.sum()) for n in lengths])
                firsts = [starts[r] + s for r, s in zip(batch.column("range_no").to_pylist(), batch.column("block_start").to_pylist())]
                keys, at, n, ids = [], [], [], []
                for names, first, sizes_, block in zip(batch.column("keys").to_pylist(), firsts, lengths, found):
                    ends = np.cumsum(sizes_)
                    keys += names
                    at += (first + ends - sizes_).tolist()
                    n += sizes_.tolist()
                    raw = block.astype("<u4").tobytes()
                    ids += [raw[4 * (e - s) : 4 * e] for e, s in zip(ends.tolist(), sizes_.tolist())]
                columns = (
                    [
                        pa.array(keys, batch.schema.field("keys").type.value_type),
                        pa.array(at, pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    ]
                    + [pa.array(ids, pa.binary())] * with_ids
                )
                yield pa.RecordBatch.from_arrays(columns, names_out)

    schema = f"alarm_event_id {key}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    names_out = [field.split()[0] for field in schema.split(", ")]
    return blocks.mapInArrow(decode, schema)


def token_path(spark: SparkSession) -> str:
    return staging_path(spark, "tokens")
