"""Token counts and token files against the library itself."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stringwatch.llm import token_files, tokens, vocabulary
from stringwatch.llm.queries import LLM_QUERIES, tokenizer_file

TEXTS = [
    "String 3 current low at inverter 12",
    "",
    None,
    " leading and trailing ",
    "two  spaces, a\ttab and\nline\n\n ends \n",
    "special <|endoftext|> inside, glued<|endoftext|>x and <|endoftext|>",
    "don't we'll I'M 12345 ... ---    wide　space  x",
    "äöü ñandú 电流过低 🔥🔥 é",
    "word " * 30000,
    "x" * 20000,
    "\x1c sep\x85next",
    "String 3 current low at inverter 12",
]


@pytest.fixture(scope="module")
def alarms(spark):
    rows = [(i if i != 4 else None, t, "n", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "alarm_event_id long, alarm_name string, n_tokens string, ids int")


def ids_of(text):
    return vocabulary.load(tokenizer_file()).encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library(alarms):
    got = {(r.alarm_event_id, r.n_bytes): r for r in tokens.alarm_token_counts(alarms, tokenizer_file(), 100).collect()}
    for i, text in enumerate(TEXTS):
        row = got[(i if i != 4 else None, len((text or "").encode()))]
        assert row.n_tokens == len(ids_of(text)), text[:40]
        assert row.over_limit == (row.n_tokens > 100)


def test_whole_tokens_are_proven():
    library = vocabulary.load(tokenizer_file())
    whole = tokens.whole_tokens(tokenizer_file())
    assert 40_000 < len(whole) <= library.get_vocab_size()
    assert "<|endoftext|>" not in whole
    assert all([t.value for t in library.model.tokenize(s)] == [s] for s in list(whole)[:500])


def test_files_give_back_all_ids_in_order(spark, alarms, tmp_path):
    path = token_files.write_alarm_tokens(alarms, tokenizer_file(), str(tmp_path / "tokens"), block_ids=1000)
    rows = token_files.read_alarm_tokens(spark, path).orderBy("start").collect()
    order = [4] + [i for i in range(len(TEXTS)) if i != 4]
    start = 0
    for i, row in zip(order, rows, strict=True):
        want = np.array(ids_of(TEXTS[i]) + [2], "<u4")
        assert (row.alarm_event_id, row.start, row.n_tokens) == (None if i == 4 else i, start, len(want))
        assert row.ids == want.tobytes() and row.ids_crc32 == zlib.crc32(want.tobytes())
        start += len(want)


def test_empty_tables(spark, alarms, tmp_path):
    none = alarms.limit(0)
    assert tokens.alarm_token_counts(none, tokenizer_file()).count() == 0
    path = token_files.write_alarm_tokens(none, tokenizer_file(), str(tmp_path / "none"))
    assert token_files.read_alarm_tokens(spark, path).count() == 0


@pytest.mark.parametrize("limit", [4, 6, 18])
def test_lengths_are_optimal_under_the_limit(limit):
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89])
    lengths = token_files.limited_lengths(counts, limit)
    assert lengths.max() <= limit and sum(2.0**-lengths) == 1
    if limit == 18:
        import heapq

        heap, total = list(counts), 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            total += both
            heapq.heappush(heap, both)
        assert (counts * lengths).sum() == total


def test_code_round_trip():
    rng = np.random.default_rng(3)
    ids = rng.geometric(0.02, 5000) * 7
    symbols, counts = np.unique(ids, return_counts=True)
    book = token_files.Codebook(symbols, token_files.limited_lengths(counts, 12))
    one, two = book.encode(ids), book.encode(ids[:3])
    got = book.decode([one[0], two[0]], [one[1], two[1]], [5000, 3])
    assert (got[0] == ids).all() and (got[1] == ids[:3]).all()


def test_single_symbol():
    book = token_files.Codebook(np.array([9]), token_files.limited_lengths(np.array([4]), 18))
    payload, checkpoints = book.encode(np.array([9, 9, 9, 9]))
    assert (book.decode([payload], [checkpoints], [4])[0] == 9).all()


def test_queries_over_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    counts = LLM_QUERIES["op1_token_counts"](spark, sf_dir).collect()
    files = LLM_QUERIES["op9_token_files"](spark, sf_dir).orderBy("doc_id").collect()
    assert len(counts) == len(files) == len(texts)
    assert all(r.n_tokens == len(ids_of(texts[r.doc_id])) for r in counts)
    start = 0
    for row in files:
        want = np.array(ids_of(texts[row.doc_id]) + [2], "<u4").tobytes()
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(want) // 4, zlib.crc32(want))
        start += row.n_tokens


def test_chunks_keep_every_row():
    texts = pa.array(["a" * 10, None, "b" * 50, "c"])
    parts = list(vocabulary.chunks(texts, 12))
    assert [p.to_pylist() for p in parts] == [["a" * 10, ""], ["b" * 50], ["c"]]
