"""Spaced seeds against a comparison of all pairs of windows."""

import random
import re

import numpy as np
import pytest

from stringwatch.llm import decontamination
from stringwatch.llm.queries import LLM_QUERIES

WORDS = [f"w{i}" for i in range(40)]


def words_of(text):
    return re.findall(r"\w+", (text or "").lower())


def brute(docs, items, window=13, substitutions=2, exact=8, alone=3):
    """All pairs with some aligned windows that differ in few words, from the full table of equal words."""
    numbers = {}
    coded = lambda text: np.array([numbers.setdefault(w, len(numbers)) for w in words_of(text)], np.int64)
    docs = [(d, coded(t)) for d, t in docs]
    found = set()
    for item, own in [(i, coded(t)) for i, t in items]:
        if not len(own):
            continue
        size = min(window, len(own))
        allowed = substitutions * size // window if size >= exact else 0
        for doc, words in docs:
            if len(words) < size or len(own) < alone and len(words) != len(own):
                continue
            # equal words counted along diagonals
            total = np.zeros((len(own) + 1, len(words) + 1), np.int64)
            for i, word in enumerate(own):
                total[i + 1, 1:] = total[i, :-1] + (words == word)
            if (total[size:, size:] - total[:-size, :-size] >= size - allowed).any():
                found.add((doc, item))
    return found


def sentence(rng, n):
    return [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n)]


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(4)
    items = [(i, sentence(rng, n)) for i, n in enumerate([60, 30, 13, 12, 9, 8, 7, 25])]
    docs = []
    for d in range(120):
        text = sentence(rng, rng.randint(0, 90))
        _, own = rng.choice(items)
        begin = rng.randrange(len(own))
        part = list(own[begin : begin + rng.randint(5, 40)])
        for _ in range(rng.randint(0, 4)):
            part[rng.randrange(len(part))] = "changed"
        at = rng.randint(0, len(text))
        docs.append((d, ", ".join(text[:at] + part + text[at:]).upper()))
    docs += [(120, None), (121, ""), (122, "w " * 60000 + " ".join(items[0][1]))]
    return docs, [(i, " ".join(w)) for i, w in items] + [(8, None), (9, ""), (10, " ".join(items[1][1]))]


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, 1, "z") for d, t in docs], "alarm_event_id long, alarm_name string, words int, item_id string"),
        spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, alarm_name string, size int"),
    )


def test_all_overlaps_are_found(spark, tables):
    docs, items = tables
    got = decontamination.contaminated_alarms(*frames(spark, docs, items)).collect()
    want = brute(docs, items)
    assert {(r.alarm_event_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert 20 < len(want) < 400
    for row in got:
        assert 0 < row.same_words <= row.overlap_words and row.first_word >= 0
    assert next(r for r in got if r.alarm_event_id == 122).overlap_words == 60


def test_clean_alarms_keep_the_rest(spark, tables):
    docs, items = tables
    alarms, evaluation = frames(spark, [*docs, (None, docs[0][1]), (None, " ".join(words_of(items[0][1]))), (5, docs[5][1])], items)
    kept = decontamination.clean_alarms(alarms, evaluation)
    assert kept.columns == alarms.columns
    bad = {d for d, _ in brute(docs, items)}
    ids = sorted(r.alarm_event_id for r in kept.where("alarm_event_id is not null").collect())
    assert ids == sorted([d for d, _ in docs if d not in bad] + [5] * (5 not in bad))
    assert kept.where("alarm_event_id is null").count() == (0 in bad) * 0 + (0 not in bad) * 1


def test_empty_tables(spark, tables):
    alarms, evaluation = frames(spark, *tables)
    assert decontamination.contaminated_alarms(alarms.limit(0), evaluation).count() == 0
    assert decontamination.contaminated_alarms(alarms, evaluation.limit(0)).count() == 0
    assert decontamination.clean_alarms(alarms, evaluation.limit(0)).count() == alarms.count()


def test_masks_survive_any_two_substitutions():
    import itertools

    kept = decontamination.masks(13, 2)
    assert len(kept) == 6
    for broken in itertools.combinations(range(13), 2):
        assert any(not set(broken) & set(mask) for mask in kept)


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in LLM_QUERIES["op2_decontamination"](spark, sf_dir).collect()}
    assert got == brute(docs, items)


def test_short_items_and_scripts_without_spaces(spark):
    items = [(0, "Why is it low?"), (1, "reset"), (2, "string low"), (3, "电流过低"), (4, "いつ直りますか"), (5, "?!")]
    docs = [
        (0, "He asked: why is it, low today"), (1, "why is it very low"), (2, "reset"), (3, "reset now"), (4, "String: LOW"), (5, "a string low"),
        (6, "告警：第三串电流过低，请检查"), (7, "电流不低"), (8, "さて、いつ直りますか。"), (9, ""), (10, None),
    ]
    got = {(r.alarm_event_id, r.item_id) for r in decontamination.contaminated_alarms(*frames(spark, docs, items)).collect()}
    assert got == {(0, 0), (2, 1), (4, 2), (6, 3), (8, 4)}
    assert {r.alarm_event_id for r in decontamination.clean_alarms(*frames(spark, docs, items)).collect()} == {1, 3, 5, 7, 9, 10}
