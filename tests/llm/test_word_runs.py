import hashlib
import random
import zlib

import numpy as np
import pytest

from stringwatch.llm import word_runs
from stringwatch.llm.queries import LLM_QUERIES


def brute_runs(words, least_length=6, least_exponent=4):
    """Every maximal stretch for every period, kept if the period is its smallest."""
    n, out = len(words), []
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q))
            if length >= max(least_length, least_exponent * q) and not smaller:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(rng, count):
    for _ in range(count):
        kind = rng.randrange(4)
        if kind == 0:
            yield [rng.randrange(2) for _ in range(rng.randint(0, 60))]
        elif kind == 1:
            base = [rng.randrange(6) for _ in range(rng.randint(1, 8))]
            yield [rng.randrange(9) for _ in range(rng.randint(0, 9))] + base * rng.randint(1, 9) + base[: rng.randint(0, 8)] + [rng.randrange(9) for _ in range(rng.randint(0, 9))]
        elif kind == 2:
            a, b = [rng.randrange(3) for _ in range(rng.randint(1, 4))], [rng.randrange(3) for _ in range(rng.randint(1, 4))]
            yield (a * rng.randint(1, 6) + b * rng.randint(1, 6)) * rng.randint(1, 5)
        else:
            yield [rng.randrange(1, 1 + rng.randint(1, 30)) for _ in range(rng.randint(0, 120))]


@pytest.mark.parametrize("least", [(6, 4), (2, 2), (5, 3), (20, 4)])
def test_runs_equal_brute_force(least):
    rng = random.Random(sum(least))
    some = list(texts(rng, 700))
    codes = np.array([w for t in some for w in t], np.int64)
    begins = np.cumsum([0] + [len(t) for t in some[:-1]])
    found = word_runs.runs_in(codes, begins, *least)
    for i, words in enumerate(some):
        assert found.get(i, []) == brute_runs(words, *least), words
        direct = word_runs.squares_to_runs(words, *least)
        assert sorted(direct, key=lambda r: (r[0], r[2])) == brute_runs(words, *least)


def test_long_powers_stay_fast():
    words = [0, 1] * 30_000
    assert word_runs.squares_to_runs(words, 6, 4) == [(0, 60_000, 2)]


def test_alarm_messages(spark):
    rows = [
        (1, "low low low low low low"), (2, "a b a b a b a b a b"), (3, ""), (4, None), (5, " \t\r\n\x0b\x0c "), (None, "x x x x x x x y"),
        (6, "no　ascii space no　ascii space"), (7, "low low low low low low"), (7, "low low low low low low"), (8, "w " * 4000 + "end"), (9, "a a a a a"),
    ]
    alarms = spark.createDataFrame(rows, "alarm_event_id bigint, alarm_name string").selectExpr("*", "1 as runs", "2 as collapsed_name")
    got = sorted((str(r.alarm_event_id), [tuple(x) for x in r.runs], r.collapsed_name) for r in word_runs.alarm_word_runs(alarms).collect())
    want = []
    for i, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        runs = brute_runs(words) if len(words) < 100 else [(0, 4000, 1)]
        want.append((str(i), runs, word_runs.collapsed(words, runs)))
    assert got == sorted(want)
    assert word_runs.alarm_word_runs(alarms.limit(0)).count() == 0
    with pytest.raises(ValueError):
        word_runs.alarm_word_runs(alarms, least_exponent=1)


def test_query_on_all_documents(spark):
    folder = "/root/testdata/sf0.001"
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = LLM_QUERIES["op12_word_runs"](spark, folder).collect()
    assert len(rows) == len(source)
    planted = 0
    for row in rows:
        words = [w.decode() for w in (source[row.doc_id] or "").encode().split()]
        h, n = zlib.crc32(str(row.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = brute_runs(words) if n < 3000 else None
        if runs is None:
            continue
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + k for s, k, q in runs)]
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
    assert planted
