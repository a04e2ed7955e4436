"""Near copies against brute force; components against a union-find."""

import random

import numpy as np
import pytest
import xxhash

from stringwatch.llm import simhash
from stringwatch.llm.components import connected_components
from stringwatch.llm.queries import LLM_QUERIES
from stringwatch.storage import Scratch

TEXTS = [
    None, "", " \t\n", "one", "ONE", "two words", "a b c", "a b c a b c a b c", "Ünïcode STAYS as it İs",
    "string current low at inverter seven " * 40, "string current low at inverter seven " * 40 + "now", "w " * 70000,
]


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(
        {9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(ids, prints):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    different = sorted(parent)
    for i, a in enumerate(different):
        for b in different[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for i, p in zip(ids, prints):
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    return [least.get(root(p)) for p in prints]


def test_fingerprints_equal_the_definition(spark):
    for text in TEXTS:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_groups_with_odd_rows(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "one", "x", "y"), (None, "alone and nameless", "x", "y"), (3, "one", "x", "y")]
    alarms = spark.createDataFrame(rows, "alarm_event_id long, alarm_name string, fingerprint string, root string")
    got = simhash.alarm_near_copies(alarms).collect()
    prints = [plain_fingerprint(r[1]) for r in rows]
    want = sorted(((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, brute_groups([r[0] for r in rows], prints))), key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_empty_table(spark):
    none = spark.createDataFrame([], "alarm_event_id long, alarm_name string")
    assert simhash.alarm_near_copies(none).count() == 0


@pytest.mark.parametrize("parts", [2, 3, 4])
def test_no_link_is_lost(spark, parts):
    rng = random.Random(parts)
    centers = [rng.getrandbits(64) for _ in range(60)]
    prints = set()
    for center in centers:
        for _ in range(12):
            value = center
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                value ^= 1 << bit
            prints.add(value)
    signed = np.array(sorted(prints), np.uint64).view(np.int64)
    frame = spark.createDataFrame([(int(v),) for v in signed], "fingerprint bigint")
    got = {frozenset((r.a, r.b)) for r in simhash.linked_fingerprints(frame, Scratch(spark), parts=parts).collect()}
    want = {
        frozenset((int(a), int(b))) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((int(a) ^ int(b)) & (1 << 64) - 1).count("1") <= 3
    }
    assert got == want and len(want) > 100


def test_allocation_sums_to_the_budget():
    rng = np.random.default_rng(2)
    for parts, budget in ((4, 0), (3, 1), (2, 2)):
        costs = np.cumsum(rng.random((parts, 4, 50)), axis=1)
        found = simhash.allocate(costs, budget)
        assert (found.sum(1) == budget).all()
        import itertools

        for row in range(50):
            least = min(
                sum(costs[i, t + 1, row] for i, t in enumerate(ts)) for ts in itertools.product(range(-1, 3), repeat=parts) if sum(ts) == budget
            )
            assert sum(costs[i, t + 1, row] for i, t in enumerate(found[row])) == pytest.approx(least)


def test_correlated_bits_share_a_part():
    correlations = np.eye(64)
    for a, b in ((0, 40), (3, 63), (40, 17), (0, 17)):
        correlations[a, b] = correlations[b, a] = 0.9
    parts = simhash.correlated_parts(correlations, 4)
    assert sorted(sum(parts, [])) == list(range(64)) and all(len(p) == 16 for p in parts)
    assert any({0, 17, 40} <= set(p) for p in parts)


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (5, 5), (3, 1), (20, 21)] + [(100 + i, 101 + i) for i in range(40)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in connected_components(frame, Scratch(spark)).collect()}
    want = {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 20: 20, 21: 20} | {i: 100 for i in range(100, 141)}
    assert got == want


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    prints = [plain_fingerprint(r.text) for r in docs]
    want = [(r.doc_id, f"{p:016x}", c) for r, p, c in zip(docs, prints, brute_groups([r.doc_id for r in docs], prints))]
    got = LLM_QUERIES["op6_near_copies"](spark, sf_dir).orderBy("doc_id").select("doc_id", "fingerprint", "component_id").collect()
    assert [tuple(r) for r in got] == want

