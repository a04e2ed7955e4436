"""Token counts of alarm messages with a shortcut for whole tokens.

Once, before the job, every string of the vocabulary is encoded alone; those
that stay one token are proven whole. In the job a pre-token found among them
counts one, and only the others go through the merges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from stringwatch.llm import vocabulary


PLAIN_WORD = re.compile(r" ?[A-Za-z]+\Z")


def whole_tokens(tokenizer_path: str) -> frozenset[str]:
    """Vocabulary strings that the merges leave as one token: at most the vocabulary."""
    tokenizer = vocabulary.load(tokenizer_path)
    special = set(vocabulary.specials(tokenizer))
    return frozenset(
        s for s in tokenizer.get_vocab(with_added_tokens=False) if s not in special and len(tokenizer.model.tokenize(s)) == 1
    )


class TokenCounter:
    """Counts pieces of text; equal to encoding them with the library."""

    def __init__(self, tokenizer_path: str, whole: frozenset[str]):
        self.tokenizer = vocabulary.load(tokenizer_path)
        self.special = vocabulary.specials(self.tokenizer)
        self.whole = whole
        self.table = vocabulary.PieceTable(self._count)

    def _count(self, pieces: list[str]) -> list[int]:
        split, merge, whole = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model.tokenize, self.whole
        counts = []
        for piece in pieces:
            if PLAIN_WORD.match(piece):  # a pre-token, as the vocabulary writes it
                token = "Ġ" + piece[1:] if piece[0] == " " else piece
                counts.append(1 if token in whole else len(merge(token)))
            elif any(s in piece for s in self.special):
                counts.append(len(self.tokenizer.encode(piece, add_special_tokens=False).ids))
            else:
                counts.append(sum(1 if p in whole else len(merge(p)) for p, _ in split(piece)) if piece else 0)
        return counts

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; null is empty."""
        totals = []
        for chunk in vocabulary.chunks(texts):
            parts, index, starts = vocabulary.parts_of(chunk, self.special)
            numbers = np.array(self.table.values(parts), np.int64)
            totals.append(np.add.reduceat(numbers[index], starts))
        return np.concatenate(totals) if totals else np.zeros(0, np.int64)


def alarm_token_counts(alarms: DataFrame, tokenizer_path: str, token_limit: int = 1024) -> DataFrame:
    """Size of every alarm message: alarm_event_id, n_bytes (UTF-8), n_tokens, over_limit.

    The tokenizer is a byte-level one of the tokenizers library, without special
    tokens added; special strings inside messages are handled as by its default.
    Null and empty messages have no bytes and no tokens. Very long messages are
    counted whole. Null ids and repeated rows give a row each; empty tables give
    no row; other columns are left out.
    """
    whole = whole_tokens(tokenizer_path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(tokenizer_path, whole)
        for batch in batches:
            texts = batch.column("alarm_name")
            tokens = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("alarm_event_id"),
                    pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()),
                    pa.array(tokens),
                    pa.array(tokens > token_limit),
                ],
                ["alarm_event_id", "n_bytes", "n_tokens", "over_limit"],
            )

    key = alarms.schema["alarm_event_id"].dataType.simpleString()
    return alarms.select("alarm_event_id", "alarm_name").mapInArrow(
        count, f"alarm_event_id {key}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
