import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from stringwatch.llm import bpe_transducer
from stringwatch.llm.queries import LLM_QUERIES, RANKS

PATH = public_tokenizers.path(RANKS)
FIXED = [
    "", " ", "   \n\n  x", "INVERTER fault 101001: string 5 low", "l'année où l'été", "日本語のテキスト", "👩‍👩‍👧‍👦 ok 👍🏽", "a" * 5000,
    "don't WE'LL x're", "<|endoftext|> plain", "tab\tand\r\nlines ", "\x01 mark \x01", "١٢٣ 4½", "é́" * 50, " 　 x",
]


@pytest.fixture(scope="module")
def library():
    ranks = bpe_transducer.read_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_equal_the_library(library, monkeypatch):
    monkeypatch.setattr(bpe_transducer, "STATE_LIMIT", 500)  # most steps are made without states
    ranks = bpe_transducer.read_ranks(PATH)
    machine, rng, tokens = bpe_transducer.Transducer(ranks), random.Random(3), list(ranks)
    for n in range(4000):
        piece = [
            lambda: bytes(rng.choice(b"abehinorst ") for _ in range(rng.randint(1, 40))),
            lambda: b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 4))),
            lambda: bytes(rng.randrange(256) for _ in range(rng.randint(1, 30))),
            lambda: bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 200))),
        ][n % 4]()
        assert machine.encode(piece) == library._core_bpe.encode_single_piece(piece)


def test_ranks_that_fall_and_tokens_the_merges_never_make():
    """Hand-made ranks: a token formed after a later one, and one that only a whole piece can be."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 260, b"xyz": 270, b"cd": 280, b"ab": 310, b"aa": 320, b"aaaa": 315}
    machine, rng = bpe_transducer.Transducer(ranks), random.Random(5)
    assert machine.encode(b"xyz") == [270]
    for _ in range(3000):
        piece = bytes(rng.choice(b"abcdxyz") for _ in range(rng.randint(1, 14)))
        parts = bpe_transducer.merged(piece, ranks)[0]
        assert machine.encode(piece) == ([ranks[piece]] if piece in ranks else [ranks[p] for p in parts])
    with pytest.raises(ValueError):
        bpe_transducer.Transducer({b"a": 0})


def test_pending_tokens_are_bounded():
    machine = bpe_transducer.Transducer(bpe_transducer.read_ranks(PATH))
    machine.encode(" antidisestablishmentarianism".encode() * 200)
    longest = max(map(len, machine.ranks))
    assert max(len(tokens) for _, pending in machine.states for tokens in pending) <= longest
    assert len(machine.states) < 500


def test_decoder_gives_out_whole_characters():
    tokens = [bytes([b]) for b in range(256)] + ["é".encode(), "👍".encode()[:3], "ab".encode()]
    complete = bpe_transducer.StreamDecoder.completeness(tokens)
    rng = random.Random(7)
    for _ in range(3000):
        ids = [rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x91, 0x8D, 0xED, 0xA0, 0xFF, 256, 257, 258]) for _ in range(rng.randint(0, 12))]
        decoder = bpe_transducer.StreamDecoder(tokens, complete)
        cut = rng.randint(0, len(ids))
        first = decoder.feed(np.array(ids[:cut], int))
        text = first + decoder.feed(np.array(ids[cut:], int)) + decoder.finish()
        raw = b"".join(tokens[i] for i in ids)
        assert text == raw.decode("utf-8", "replace")
    decoder = bpe_transducer.StreamDecoder(tokens, complete)
    assert [decoder.feed(np.array([i])) for i in (0xE2, 0x82, 0xAC)] == ["", "", "€"]


def test_alarm_messages(spark, library):
    rows = [(i, t) for i, t in enumerate(FIXED)] + [(None, "no id"), (3, "twice"), (3, "twice"), (99, None)]
    alarms = spark.createDataFrame(rows, "alarm_event_id bigint, alarm_name string").selectExpr("*", "1 as token_ids", "2 as flat")
    found = bpe_transducer.alarm_token_ids(alarms, PATH, public_tokenizers.PATTERN)
    want = sorted((str(i), library.encode_ordinary(t or ""), t or "") for i, t in rows)
    assert sorted((str(r.alarm_event_id), list(r.token_ids), r.alarm_name) for r in bpe_transducer.decoded_alarms(found, PATH).collect()) == want
    both = bpe_transducer.alarm_token_ids(alarms, PATH, public_tokenizers.PATTERN, decoded=True)
    assert sorted((str(r.alarm_event_id), list(r.token_ids), r.decoded_name) for r in both.collect()) == want
    assert bpe_transducer.alarm_token_ids(alarms.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    gone = spark.createDataFrame([(1, None)], "alarm_event_id bigint, token_ids array<int>")
    assert bpe_transducer.decoded_alarms(gone, PATH).first().alarm_name == ""


def test_query_on_all_documents(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = LLM_QUERIES["op11_bpe_transducer"](spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode_ordinary(texts[row.doc_id] or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((texts[row.doc_id] or "").encode()).hexdigest()
