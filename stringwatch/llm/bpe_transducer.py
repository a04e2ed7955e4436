"""Byte-level BPE of alarm messages by a finite-state transducer made on demand.

The merges are compiled into a transducer that reads bytes and writes tokens.
Its hypotheses are places where the token being read may have begun; a token may
follow another only if no merge would cross the seam, which makes the tokens of
every prefix unique. States are the sets of hypotheses that occur, made when
first needed up to a bound; a step writes the tokens all hypotheses agree
on, so what is pending is never longer than the longest token.

Ids are decoded as a stream: a state machine of UTF-8 holds back the bytes of a
character that the next token completes.
"""

from __future__ import annotations

import base64
import functools
import gc
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stringwatch.llm import vocabulary

#: states made at most, and answers kept about tokens that follow others
STATE_LIMIT, KNOWN_LIMIT = 100_000, 700_000
#: parts of texts whose ids are kept, and bytes of text looked at together
KEPT_PARTS, CHUNK_BYTES = 200_000, 8 << 20
#: a begun token is given up early if none of its ends fits, looked at where it has so few
FEW_ENDS = 24
#: bits for a place in the tree of tokens
NODE_BITS = 24
NODES = (1 << NODE_BITS) - 1
#: ids that the stream decoder is given at once
DECODED_IDS = 1 << 16
NEVER = 1 << 62
#: a space and a run of ASCII letters, which every pattern meant here matches as one
PLAIN_PART = re.compile(r" ?[A-Za-z]+\Z")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of every line; the rank is the id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> tuple[list[bytes], list[tuple[int, bool, bool]]]:
    """Tokens of a short piece, and of each merge its rank and whether it touches the left and right end."""
    parts, steps = [piece[i : i + 1] for i in range(len(piece))], []
    while len(parts) > 1:
        found = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        least = min(found)
        if least == NEVER:
            break
        at = found.index(least)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        steps.append((least, at == 0, at == len(parts) - 1))
    return parts, steps


class Seams:
    """Which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.edges: dict[bytes, tuple | None] = {}
        self.proper: dict[bytes, bool] = {}

    def _edges(self, token: bytes) -> tuple[list, list] | None:
        """The tokens at the left and right end while the token is merged, as (bytes, begin, end) in ranks; None if ranks fall."""
        if token not in self.edges:
            parts, steps = [token[i : i + 1] for i in range(len(token))], merged(token, self.ranks)[1]
            order = [rank for rank, _, _ in steps]
            sides = None
            if order == sorted(order):
                left, right = [[parts[0], -1, NEVER]], [[parts[-1], -1, NEVER]]
                for rank, first, last in steps:
                    at = next(i for i in range(len(parts) - 1) if self.ranks.get(parts[i] + parts[i + 1]) == rank)
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                    for side, touched, end in ((left, first, parts[0]), (right, last, parts[-1])):
                        if touched:
                            side[-1][2] = rank
                            side.append([end, rank, NEVER])
                sides = left, right
            self.edges[token] = sides
        return self.edges[token]

    def is_proper(self, token: bytes) -> bool:
        """Whether the merges make this token of its own bytes."""
        known = self.proper.get(token)
        if known is None:
            known = self.proper[token] = len(merged(token, self.ranks)[0]) == 1
        return known

    def fits(self, first: bytes, second: bytes) -> bool:
        """Whether the bytes of both together are merged to just these two.

        A merge over the seam happens if its rank comes before the next change
        of the ends it joins; of equal ranks the left one goes first.
        """
        one, two = self._edges(first), self._edges(second)
        if one is None or two is None:
            return merged(first + second, self.ranks)[0] == [first, second]
        rank = self.ranks.get
        for a, begin_a, end_a in one[1]:
            for b, begin_b, end_b in two[0]:
                if begin_b < end_a and begin_a <= end_b:
                    over = rank(a + b)
                    if over is not None and over < end_a and over <= end_b:
                        return False
        return True


class State:
    """A set of hypotheses, each a token before and the bytes of the token being read, with tokens not yet written."""

    __slots__ = ("hypotheses", "pending", "edges", "final")

    def __init__(self, hypotheses: tuple[int, ...], pending: tuple[tuple[int, ...], ...]):
        self.hypotheses, self.pending = hypotheses, pending
        self.edges: dict[int, tuple[State, tuple[int, ...]]] = {}
        self.final = pending[next(i for i, h in enumerate(hypotheses) if not h & NODES)]


class Transducer:
    """Tokens of pieces by the ranks, as the merges would give them.

    A hypothesis is a number: the rank of the token before (plus one, none is 0)
    above, the place in the tree of all tokens' bytes below.
    """

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the ranks have no token for the bytes {missing}")
        self.ranks, self.seams = ranks, Seams(ranks)
        self.token = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}
        self.rank, self.ends = [-1], [[]]  # by place in the tree: id of a token, tokens that go on (a few)
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                if len(self.ends[node]) <= FEW_ENDS:
                    self.ends[node].append(token)
                after = self.child.get(node << 8 | byte)
                if after is None:
                    after = self.child[node << 8 | byte] = len(self.rank)
                    self.rank.append(-1)
                    self.ends.append([])
                node = after
            self.rank[node] = rank
        self.known: dict[int, int] = {}
        self.states: dict[tuple, State] = {}
        self.start = self._state((0,), ((),))

    def _state(self, hypotheses: tuple, pending: tuple) -> State:
        state = self.states.get((hypotheses, pending))
        if state is None:
            state = State(hypotheses, pending)
            if len(self.states) < STATE_LIMIT:
                self.states[hypotheses, pending] = state
        return state

    def _follow(self, hypothesis: int) -> int:
        """Odd if a token that begins so may follow the one before; above, the id (plus one) if it may end here."""
        node, before = hypothesis & NODES, self.token.get((hypothesis >> NODE_BITS) - 1)
        ends, rank = self.ends[node], self.rank[node]
        begins = bool(ends)
        if before is not None and 0 < len(ends) <= FEW_ENDS:
            begins = any(self.seams.is_proper(end) and self.seams.fits(before, end) for end in ends)
        if rank >= 0:
            token = self.token[rank]
            if not (self.seams.is_proper(token) and (before is None or self.seams.fits(before, token))):
                rank = -1
        found = (rank + 1) << 1 | begins
        if len(self.known) < KNOWN_LIMIT:
            self.known[hypothesis] = found
        return found

    def _step(self, hypotheses: tuple, pending: tuple, byte: int) -> tuple[tuple, tuple, tuple]:
        """Hypotheses and what is pending after a byte, and the tokens all agree on."""
        child, known, after, waiting = self.child.get, self.known.get, [], []
        for hypothesis, tokens in zip(hypotheses, pending):
            node = child((hypothesis & NODES) << 8 | byte)
            if node is None:
                continue
            moved = hypothesis & ~NODES | node
            found = known(moved)
            if found is None:
                found = self._follow(moved)
            if found & 1:
                after.append(moved)
                waiting.append(tokens)
            if found > 1:
                after.append((found >> 1) << NODE_BITS)
                waiting.append((*tokens, (found >> 1) - 1))
        first, agreed = waiting[0], 0
        for token in first:
            if not all(len(w) > agreed and w[agreed] == token for w in waiting):
                break
            agreed += 1
        if agreed:
            waiting = [w[agreed:] for w in waiting]
        return tuple(after), tuple(waiting), first[:agreed]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern; a piece that is a token itself is that token.

        States are made while there is room; beyond it steps are made without them.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, ids, room = self.start, [], len(self.states) < STATE_LIMIT
        for at, byte in enumerate(piece):
            edge = state.edges.get(byte)
            if edge is None:
                if not room:
                    hypotheses, pending = state.hypotheses, state.pending
                    for byte in piece[at:]:
                        hypotheses, pending, written = self._step(hypotheses, pending, byte)
                        ids += written
                    ids += pending[next(i for i, h in enumerate(hypotheses) if not h & NODES)]
                    return ids
                *after, written = self._step(state.hypotheses, state.pending, byte)
                edge = state.edges[byte] = self._state(*after), written
            state, written = edge
            if written:
                ids += written
        ids += state.final
        return ids


# fixed values: well-formed UTF-8 as (first byte, second byte, further bytes)
WELL_FORMED = [
    ((0xC2, 0xDF), (0x80, 0xBF), 0),
    ((0xE0, 0xE0), (0xA0, 0xBF), 1),
    ((0xE1, 0xEC), (0x80, 0xBF), 1),
    ((0xED, 0xED), (0x80, 0x9F), 1),
    ((0xEE, 0xEF), (0x80, 0xBF), 1),
    ((0xF0, 0xF0), (0x90, 0xBF), 2),
    ((0xF1, 0xF3), (0x80, 0xBF), 2),
    ((0xF4, 0xF4), (0x80, 0x8F), 2),
]


@functools.cache
def utf8_machine() -> list[list[int]]:
    """Next state by state and byte; 0 is between characters, -1 an error; 1 and 2 want so many plain further bytes."""
    table = [[-1] * 256 for _ in range(3 + len(WELL_FORMED))]
    table[0][:0x80] = [0] * 0x80
    for state in (1, 2):
        table[state][0x80:0xC0] = [state - 1] * 0x40
    for number, ((first, last), (low, high), further) in enumerate(WELL_FORMED):
        table[0][first : last + 1] = [3 + number] * (last + 1 - first)
        table[3 + number][low : high + 1] = [further] * (high + 1 - low)
    return table


class StreamDecoder:
    """Text of a stream of ids; a character is given out once its last byte has come.

    Bytes that are not UTF-8 become U+FFFD, one for each longest beginning of a
    character, as is usual.
    """

    def __init__(self, tokens: list[bytes], complete: np.ndarray):
        self.tokens, self.complete = tokens, complete
        self.state, self.held = 0, b""

    @staticmethod
    def completeness(tokens: list[bytes]) -> np.ndarray:
        """Whether a token is whole characters."""
        table, out = utf8_machine(), np.zeros(len(tokens), bool)
        for i, token in enumerate(tokens):
            state = 0
            for byte in token:
                state = table[state][byte]
                if state < 0:
                    break
            out[i] = state == 0
        return out

    def _cut_short(self) -> str:
        cut = "�" if self.state else ""
        self.state, self.held = 0, b""
        return cut

    def _read(self, token: bytes) -> str:
        table, out = utf8_machine(), []
        for byte in token:
            after = table[self.state][byte]
            if after < 0 and self.state:
                out.append(self._cut_short())
                after = table[0][byte]
            if after < 0:
                out.append("�")
            elif after:
                self.state, self.held = after, self.held + bytes([byte])
            else:
                out.append((self.held + bytes([byte])).decode())
                self.state, self.held = 0, b""
        return "".join(out)

    def feed(self, ids: np.ndarray) -> str:
        """The characters that these ids complete."""
        out, done = [], 0
        for at in [*np.flatnonzero(~self.complete[ids]).tolist(), len(ids)]:
            if done < at:
                out.append(self._cut_short())
                out.append(b"".join(map(self.tokens.__getitem__, ids[done:at].tolist())).decode())
            if at < len(ids):
                out.append(self._read(self.tokens[ids[at]]))
            done = at + 1
        return "".join(out)

    def finish(self) -> str:
        """What a stream that ends within a character leaves."""
        return self._cut_short()


@functools.lru_cache(2)
def piece_table(ranks_path: str, pattern: str) -> vocabulary.PieceTable:
    """Ids of parts of texts as little-endian 32-bit integers; one for all tasks of a worker."""
    gc.set_threshold(200_000)  # steps make many short-lived tuples and no cycles
    encode, split = Transducer(read_ranks(ranks_path)).encode, regex.compile(pattern).finditer

    def ids_of(parts: list[str]) -> list[bytes]:
        out = []
        for part in parts:
            if PLAIN_PART.match(part):  # one match of the pattern
                ids = encode(part.encode())
            else:
                ids = [i for match in split(part) for i in encode(match.group().encode())]
            out.append(array("i", ids).tobytes())  # tasks run on little-endian machines
        return out

    return vocabulary.PieceTable(ids_of, KEPT_PARTS)


@functools.lru_cache(2)
def decoding_table(ranks_path: str) -> tuple[list[bytes], np.ndarray]:
    ranks = read_ranks(ranks_path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens, StreamDecoder.completeness(tokens)


def decoded_texts(rows: Iterable[np.ndarray], ranks_path: str) -> Iterator[str]:
    """The text of each row of ids, fed to the stream decoder in stretches."""
    decoder = StreamDecoder(*decoding_table(ranks_path))
    for ids in rows:
        parts = [decoder.feed(ids[i : i + DECODED_IDS]) for i in range(0, len(ids), DECODED_IDS)]
        yield "".join(parts) + decoder.finish()


def alarm_token_ids(alarms: DataFrame, ranks_path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """Token ids of every alarm message: alarm_event_id, token_ids (array of int).

    ``ranks_path`` is a file of base64 tokens and ranks, ``pattern`` splits a
    message into the pieces that are merged; it must end a match wherever a run
    of letters ends, and take letters with a space before them as one. No special
    tokens. With ``decoded`` the column decoded_name follows, the message
    decoded from its ids in the same pass. Null and empty messages have no ids;
    very long ones are encoded whole. Null ids and repeated rows give a row
    each, empty tables none; other columns are left out.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(ranks_path, pattern)
        for batch in batches:
            keys, done = batch.column("alarm_event_id"), 0
            for chunk in vocabulary.chunks(batch.column("alarm_name"), CHUNK_BYTES):
                parts, index, starts = vocabulary.parts_of(chunk, [])
                flat, ends = vocabulary.gathered(table.values(parts), index, "<i4")
                offsets = np.append(np.append(0, ends)[starts], ends[-1])
                columns = [keys.slice(done, len(chunk)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))]
                if decoded:
                    texts = decoded_texts((flat[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist())), ranks_path)
                    columns.append(pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)
                done += len(chunk)

    key = alarms.schema["alarm_event_id"].dataType.simpleString()
    names = ["alarm_event_id", "token_ids", "decoded_name"][: 3 if decoded else 2]
    schema = f"alarm_event_id {key}, token_ids array<int>" + ", decoded_name string" * decoded
    return alarms.select("alarm_event_id", "alarm_name").mapInArrow(encode, schema)


def decoded_alarms(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """The messages again: alarm_event_id, token_ids, alarm_name; null ids of a message give an empty one.

    An id that the ranks do not have is an error.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("token_ids").fill_null([])
            flat, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
            found = decoded_texts((flat[a:b] for a, b in zip(offsets, offsets[1:])), ranks_path)
            yield pa.RecordBatch.from_arrays(
                [batch.column("alarm_event_id"), batch.column("token_ids"), pa.array(found, pa.string())],
                ["alarm_event_id", "token_ids", "alarm_name"],
            )

    key = tokens.schema["alarm_event_id"].dataType.simpleString()
    return tokens.select("alarm_event_id", "token_ids").mapInArrow(
        decode, f"alarm_event_id {key}, token_ids array<int>, alarm_name string"
    )
