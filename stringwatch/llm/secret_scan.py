"""Secrets in alarm messages: fixed patterns, and values whose guess cost is high.

Three patterns give the base spans. Beside them, every value in a credential
context is cut into dictionary words, dates, repeats, keyboard walks, sequences
and single brute-force characters; dynamic programming finds the cut that needs
the fewest guesses. Values that would still take many guesses are spans of kind
``guess``; placeholders such as ``password = changeme`` are not.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from stringwatch.llm import vocabulary

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: a value after a credential word, up to white space or a quotation mark
CONTEXT = re.compile(
    r"""(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|auth)[_-]?key)["']?\s*(?:[:=]|\bis\b)\s*["']?([^\s"']+)"""
)
#: whatever has a match of a pattern above matches it; found by one linear scan
CANDIDATE = r"(?i:pass|pwd|secret|token|credential|key)|AKIA|[0-9a-f]{32}"
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890")
LOOKS_LIKE = str.maketrans({"@": "a", "4": "a", "0": "o", "1": "l", "!": "i", "3": "e", "5": "s", "$": "s", "7": "t"})
LONGEST_WORD = 20
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
LONGEST_UNIT = 8


def _neighbour_keys() -> set[tuple[str, str]]:
    near = set()
    for row in ROWS:
        near |= set(zip(row, row[1:]))
    for upper, lower in zip(ROWS, ROWS[1:3]):
        near |= set(zip(upper, lower)) | set(zip(upper[1:], lower))
    return near | {(b, a) for a, b in near}


NEAR = _neighbour_keys()


def dictionary(tokenizer_path: str) -> dict[str, float]:
    """log10 of the guesses of common words: the letter strings of a vocabulary, in its order."""
    ranked = sorted(vocabulary.load(tokenizer_path).get_vocab().items(), key=lambda item: item[1])
    words = dict.fromkeys(w for t, _ in ranked if len(w := t.lstrip("Ġ▁").lower()) >= 3 and w.isascii() and w.isalpha())
    return {w: math.log10(rank + 2) for rank, w in enumerate(words)}


def _single(character: str) -> float:
    if character.isdigit():
        return 1.0
    if character.isalpha():
        return math.log10(26)
    return math.log10(33)


class _Begins:
    """Places where a segment may begin whose cost grows with the logarithm of its length.

    Of two places the earlier one, once it is as cheap, stays so for all later
    ends; the later one is dropped then, so few are kept.
    """

    def __init__(self):
        self.kept: list[tuple[int, float]] = []

    def add(self, begin: int, cost: float) -> None:
        self.kept.append((begin, cost))

    def least(self, end: int, unit: int = 1) -> float:
        best, kept = math.inf, []
        for begin, cost in self.kept:
            total = cost + math.log10((end - begin) / unit)
            if total < best:
                best = total
                kept.append((begin, cost))
        self.kept = kept
        return best


def guess_cost(value: str, words: dict[str, float], units: dict[str, float] | None = None) -> float:
    """log10 of the guesses that the cheapest of all cuts of ``value`` needs.

    Segments are words (also in other case or with signs for letters), dates,
    walks on the keyboard and sequences of three characters or more, repeats of
    up to eight characters, and single characters; any of them may begin or end
    inside a longer one.
    """
    n = len(value)
    if not n:
        return 0.0
    units = {} if units is None else units
    lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = lower.translate(LOOKS_LIKE)
    chains = [  # whether neighbours go on, guesses of one character more, places where a chain may begin
        (lambda a, b: (a, b) in NEAR, math.log10(40 * 4), _Begins()),
        (lambda a, b: a.isalnum() and b.isalnum() and ord(b) - ord(a) == 1, math.log10(62 * 2), _Begins()),
        (lambda a, b: a.isalnum() and b.isalnum() and ord(b) - ord(a) == -1, math.log10(62 * 2), _Begins()),
    ]
    chain_begin = [0, 0, 0]
    period_begin = {unit: 0 for unit in range(1, LONGEST_UNIT + 1)}
    repeats = {unit: [_Begins() for _ in range(unit)] for unit in period_begin}
    best = [0.0] * (n + 1)
    for end in range(1, n + 1):
        least = best[end - 1] + _single(value[end - 1])
        for begin in range(max(0, end - LONGEST_WORD), end - 2):
            if best[begin] >= least:
                continue
            cost = words.get(lower[begin:end])
            if cost is None and (cost := words.get(plain[begin:end])) is not None:
                cost += 0.6
            if cost is not None:
                least = min(least, best[begin] + cost + (0.3 if value[begin:end] != lower[begin:end] else 0.0))
        if value[end - 1].isdigit():
            for begin in range(max(0, end - 10), end - 3):
                if DATE.fullmatch(value, begin, end):
                    least = min(least, best[begin] + math.log10(120 * (365 if end - begin > 4 else 1)))
        for i, (together, guesses, begins) in enumerate(chains):
            if end > 1 and not together(lower[end - 2], lower[end - 1]):
                chain_begin[i] = end - 1
                begins.kept.clear()
            if end - 3 >= chain_begin[i]:
                begins.add(end - 3, best[end - 3])
                least = min(least, begins.least(end) + guesses)
        for unit, first in period_begin.items():
            if end > unit and value[end - 1] != value[end - 1 - unit]:
                period_begin[unit] = first = end - unit
                for begins in repeats[unit]:
                    begins.kept.clear()
            if end - 2 * unit >= first:
                begins = repeats[unit][end % unit]
                begins.add(end - 2 * unit, best[end - 2 * unit])
                text = value[end - unit : end]
                if text not in units:
                    units[text] = guess_cost(text, words, units)
                least = min(least, begins.least(end, unit) + units[text])
        best[end] = least
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three fixed patterns, each leftmost and without overlaps of its own."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return found


def guess_spans(text: str, words: dict[str, float], least_cost: float) -> list[tuple[int, int, int]]:
    found = []
    for match in CONTEXT.finditer(text):
        value = match[1].rstrip(".,;:!?)]}")
        if len(value) >= 6 and guess_cost(value, words) >= least_cost:
            found.append((match.start(1), 3, match.start(1) + len(value)))
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def alarm_secrets(alarms: DataFrame, tokenizer_path: str, least_cost: float = 8.0) -> DataFrame:
    """Secrets of every alarm message.

    Returns alarm_event_id, n_assign, n_access, n_hex, base_sha256 (of the base
    spans ``kind:start:end`` in the order of start and kind, code points, end
    exclusive), spans (all of them, likewise) and n_guess. ``guess`` spans are
    credential values of six characters or more that take 10 ** ``least_cost``
    guesses or more; a base span stays whatever its value costs.

    Null and empty messages have no spans; very long ones are scanned whole.
    Null ids and repeated rows give a row each, empty tables none; other columns
    are left out.
    """
    words = dictionary(tokenizer_path)  # at most the vocabulary

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0)
        for batch in batches:
            texts = pc.fill_null(batch.column("alarm_name"), "")
            rows = [nothing] * len(texts)
            for i in pc.indices_nonzero(pc.match_substring_regex(texts, CANDIDATE)).to_pylist():
                text = texts[i].as_py()
                base = base_spans(text)
                guess = guess_spans(text, words, least_cost)
                number = [sum(kind == k for _, kind, _ in base) for k in range(3)]
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                rows[i] = (*number, digest, written(base + guess), len(guess))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("alarm_event_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["alarm_event_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"],
            )

    key = alarms.schema["alarm_event_id"].dataType.simpleString()
    return alarms.select("alarm_event_id", "alarm_name").mapInArrow(
        scan,
        f"alarm_event_id {key}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_guess bigint",
    )
