"""Tokenizers inside tasks: each distinct part of a batch is looked at once.

In a byte-level vocabulary a run of letters always ends a pre-token, and a space
after another sign always begins one, so a text may be cut there and its parts
treated one by one. Parts, mostly words with the space before them, repeat;
Arrow finds the distinct ones of a batch.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: a run of letters, with the space before it, is one pre-token
PLAIN_PART = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ž]+\Z")
#: bytes of text looked at together
CHUNK_BYTES = 16 << 20
#: results kept for later batches by one worker in each of two generations, and the longest piece kept
KEPT_PIECES, KEPT_LENGTH = 500_000, 16


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Slices of about ``limit`` bytes; a longer text is a slice of its own. Null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64))
    begin, done = 0, 0
    while begin < len(texts):
        end = max(int(np.searchsorted(ends, done + limit, side="right")), begin + 1)
        yield texts.slice(begin, end - begin)
        begin, done = end, int(ends[end - 1])


def letters_as_bytes(tokenizer) -> dict[int, str]:
    """How the vocabulary writes the bytes of a space and of the letters of :data:`PLAIN_PART`, for ``str.translate``."""
    signs = " " + "".join(map(chr, range(0x41, 0x17F)))
    return {ord(c): tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in signs if c == " " or PLAIN_PART.match(c)}


def specials(tokenizer) -> list[str]:
    """Strings that the tokenizer takes out of a text before anything else."""
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


class Kept:
    """Values kept up to a bound; what was not used lately goes first."""

    def __init__(self, limit: int = KEPT_PIECES):
        self.limit = limit
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def find(self, keys: list[str]) -> list:
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        found = list(map(self.young.get, keys))
        if self.old:
            again = self.old.get
            for i, value in enumerate(found):
                if value is None and (value := again(keys[i])) is not None:
                    found[i] = self.young[keys[i]] = value
        return found

    def keep(self, keys: list[str], values: list) -> None:
        self.young.update({k: value for k, value in zip(keys, values) if len(k) <= KEPT_LENGTH})


class PieceTable:
    """Values of the parts that texts are cut into, by ``compute`` where they are not kept."""

    def __init__(self, compute: Callable[[list[str]], list], limit: int = KEPT_PIECES):
        self.compute, self.kept = compute, Kept(limit)

    def values(self, parts: list[str]) -> list:
        found = self.kept.find(parts)
        missing = [i for i, value in enumerate(found) if value is None]
        if missing:
            new = [parts[i] for i in missing]
            values = self.compute(new)
            for i, value in zip(missing, values):
                found[i] = value
            self.kept.keep(new, values)
        return found


def _cuts(raw: np.ndarray) -> np.ndarray:
    """Places between two bytes where a pre-token ends whatever lies around.

    After a letter (of A-Z and À-ž) before an ASCII sign that is none, and before
    a space that follows a visible ASCII sign or such a letter.
    """
    letter = ((raw | 0x20) >= 0x61) & ((raw | 0x20) <= 0x7A)
    before, after = letter[:-1].copy(), (raw[1:] < 0x80) & ~letter[1:]
    lead = np.flatnonzero((raw[:-2] >= 0xC3) & (raw[:-2] <= 0xC5))  # first bytes of À to ž, but for two signs among them
    second = raw[lead + 1]
    sign = (raw[lead] == 0xC3) & ((second == 0x97) | (second == 0xB7)) | (raw[lead] == 0xC5) & (second == 0xBF)
    before[lead[~sign] + 1] = True
    visible = (raw[:-1] > 0x20) & (raw[:-1] < 0x7F)
    return np.flatnonzero(before & after | visible & (raw[1:] == 0x20)) + 1


def parts_of(texts: pa.Array, special: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct parts, index of the part at each place, first place of each text.

    ``texts`` are large strings without null. Texts with a special string are one
    part; an empty text is an empty part.
    """
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[: bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    cuts = _cuts(raw[bounds[0] :]) + bounds[0] if len(raw) - bounds[0] > 2 else np.zeros(0, np.int64)
    begins_text = np.zeros(bounds[-1] + 1, bool)
    begins_text[bounds] = True
    cuts = cuts[~begins_text[cuts]]
    whole = np.zeros(len(texts), bool)
    for s in special:
        whole |= np.asarray(pc.match_substring(texts, s))
    if whole.any():
        cuts = cuts[~whole[np.searchsorted(bounds, cuts, side="right") - 1]]
    starts = np.searchsorted(cuts, bounds[:-1]) + np.arange(len(texts))
    places = np.empty(len(cuts) + len(texts) + 1, np.int64)
    is_text = np.zeros(len(places), bool)
    is_text[starts] = True
    is_text[-1] = True
    places[is_text], places[~is_text] = bounds, cuts
    parts = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places), data if data is not None else pa.py_buffer(b""))
    coded = parts.dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices), starts


def gathered(values: list[bytes], index: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The integers of the part at each place, one after the other, and where each place ends among them."""
    flat = np.frombuffer(b"".join(values), kind)
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // np.dtype(kind).itemsize
    begins, lengths = np.cumsum(sizes) - sizes, sizes[index]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    small = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((begins[index] - ends + lengths).astype(small), lengths)
    at += np.arange(total, dtype=small)
    return flat[at], ends
