import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stringwatch.llm import collocations
from stringwatch.llm.queries import LLM_QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_phrases(rows, longest=5, least=100, covered=100, first=2000):
    """Every phrase of every piece, counted one by one."""
    counts, totals = {}, Counter()
    for code, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[code] += len(words)
            own = counts.setdefault(code, Counter())
            for i in range(len(words)):
                own.update(tuple(words[i : i + m]) for m in range(1, longest + 1) if i + m <= len(words))
    out = []
    for code, own in counts.items():
        chosen, scored = {p: a for p, a in own.items() if len(p) > 1 and a >= least}, []
        covers = {}
        for p, a in chosen.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    covers[p[i : i + m]] = max(a, covers.get(p[i : i + m], 0))
        for p, a in chosen.items():
            if 100 * covers.get(p, -1) >= covered * a:
                continue
            cuts = [(1000 * a * totals[code] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:first], 1):
            out.append((code, rank, phrase.decode(), -a, left, right, totals[code], -score))
    return sorted(out, key=str)


def result(frame):
    names = ["alarm_code", "rank", "phrase", "occurrences", "first_occurrences", "rest_occurrences", "words", "score"]
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


def messages(rng, count):
    vocabulary = ["String", "string", "low", "é", "fault", "a", "b", "c", "INVERTER", "x1"]
    for _ in range(count):
        words = []
        for _ in range(rng.randint(0, 40)):
            words += rng.choice([[rng.choice(vocabulary)], ["grid", "voltage", "too", "High", "now"], ["low", "low"]])
        yield rng.choice(["de", "en", None]), rng.choice([" ", "  ", "\t"]).join(w + rng.choice(["", "", "", ".", ",", "\n"]) for w in words)
    yield "en", " ".join(rng.choice("pqr") for _ in range(2000))
    yield "en", "z " * 500
    yield "fr", None
    yield "fr", ""
    yield "es", " .,;\n "


@pytest.mark.parametrize("longest, least, covered, first", [(5, 12, 100, 2000), (2, 5, 100, 2000), (3, 20, 60, 7), (5, 100, 100, 2000)])
def test_phrases_equal_brute_force(spark, longest, least, covered, first):
    rows = list(messages(random.Random(longest + least), 250))
    alarms = spark.createDataFrame(rows, "alarm_code string, alarm_name string").selectExpr("*", "1 as chunk", "2 as number")
    got = result(collocations.alarm_phrases(alarms, longest, least, covered, first))
    assert got == brute_phrases(rows, longest, least, covered, first) and got


def test_chunks_count_every_phrase_once():
    rng = random.Random(2)
    for n in list(range(1, 60)) + [500]:
        words = [rng.choice([b"a", b"b", b"c", b"dd"]) for _ in range(n)]
        got, want = Counter(), Counter()
        for own, chunk in collocations.chunks_of(words, 4):
            parts = chunk.split(b" ")
            got.update(tuple(parts[i : i + m]) for i in range(own) for m in range(1, 6) if i + m <= len(parts))
        want.update(tuple(words[i : i + m]) for i in range(n) for m in range(1, 6) if i + m <= n)
        assert got == want


def test_scores_beyond_64_bits(spark):
    big = [(10**12 + 7, 10**16 + 3, 10**12 + 9, 10**14 + 1), (100, 10**16, 101, 100), (10**13, 10**16 + 1, 10**13, 10**13 + 3)]
    rows = [(f"c{i}", a, n, le, r) for i, (a, n, le, r) in enumerate(big)]
    whole = spark.createDataFrame(rows, "alarm_code string, occurrences bigint, words bigint, l bigint, r bigint")
    phrases = whole.select("alarm_code", F.lit("p q").alias("phrase"), "occurrences")
    parts = whole.select("alarm_code", F.lit("p").alias("phrase"), F.col("l").alias("occurrences")).unionAll(
        whole.select("alarm_code", F.lit("q").alias("phrase"), F.col("r").alias("occurrences"))
    )
    got = {r.alarm_code: r.score for r in collocations.weakest_cuts(phrases, parts, whole.select("alarm_code", "words")).collect()}
    assert got == {c: 1000 * a * n // (le * r) for c, a, n, le, r in rows}


def test_empty_and_null(spark):
    alarms = spark.createDataFrame([], "alarm_code string, alarm_name string, alarm_event_id bigint")
    assert collocations.alarm_phrases(alarms).count() == 0
    numbers = spark.createDataFrame([(7, "a b c")] * 3 + [(None, "a b")] * 4, "alarm_code int, alarm_name string")
    assert [(r.alarm_code, r.phrase, r.occurrences) for r in collocations.alarm_phrases(numbers, least=3).orderBy("alarm_code").collect()] == [
        (None, "a b", 4), (7, "a b c", 3),
    ]


def test_query_on_all_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.lang or "und", r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = LLM_QUERIES["op13_collocations"](spark, folder)
    named = got.withColumnsRenamed({"lang": "alarm_code", "a": "occurrences", "l": "first_occurrences", "r": "rest_occurrences", "n": "words"})
    assert result(named) == brute_phrases(rows)
