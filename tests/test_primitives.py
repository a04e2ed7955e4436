"""Primitives against plain loops on random input."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stringwatch.functions.isotonic import isotonic
from stringwatch.functions.lof import lof_scores
from stringwatch.operators import quantiles as q
from stringwatch.operators import runs


def brute_lof(values, k, floor):
    n = len(values)
    if n < 2:
        return [None] * n
    k = min(k, n - 1)
    near = [sorted((abs(values[j] - values[i]), j) for j in range(n) if j != i)[:k] for i in range(n)]
    kd = [m[-1][0] for m in near]
    density = [1 / (sum(max(d, kd[j], floor) for d, j in m) / k) for m in near]
    return [sum(density[j] for _, j in near[i]) / k / density[i] for i in range(n)]


def test_lof_matches_brute_force(spark):
    rng = random.Random(1)
    groups = [[round(rng.gauss(1, 0.3), 1) for _ in range(rng.randint(1, 14))] for _ in range(200)]
    groups.append([1.0, 1.01, 0.99, 1.0, 0.4])
    frame = spark.createDataFrame([(g, [float(v) for v in x]) for g, x in enumerate(groups)], "g int, v array<double>")
    for k in (2, 5):
        got = {r.g: r.s for r in frame.select("g", lof_scores(F.col("v"), k, 0.01).alias("s")).collect()}
        for g, values in enumerate(groups):
            assert got[g] == pytest.approx(brute_lof(values, k, 0.01))


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    rows = []
    samples = {
        "normal": rng.normal(0, 1, 2000),
        "ties": rng.integers(-3, 4, 500).astype(float),
        "wide": np.exp(rng.normal(0, 30, 301)) * rng.choice([-1, 1], 301),
        "same": np.full(77, 0.1),
        "one": np.array([5.0]),
        "two": np.array([1.0, 4.0]),
        "tiny": np.array([0.0, -0.0, 1e-310, -1e-310, 1e308]),
    }
    for name, values in samples.items():
        rows += [(name, float(v)) for v in values]
    rows += [("normal", None), ("normal", math.nan)]
    frame = spark.createDataFrame(rows, "k string, v double")
    probabilities = [0.0, 0.005, 0.5, 0.9, 0.995, 1.0]
    got = {r.k: r for r in q.quantiles(frame, ["k"], "v", probabilities).collect()}
    assert set(got) == set(samples)
    for name, values in samples.items():
        assert got[name].n == len(values)
        assert got[name].q == pytest.approx(np.quantile(values, probabilities).tolist(), rel=1e-12)
    everything = np.concatenate(list(samples.values()))
    assert q.scalar_quantiles(frame, "v", [0.25]) == pytest.approx([np.quantile(everything, 0.25)])
    assert q.scalar_quantiles(frame.where("false"), "v", [0.25]) is None


def test_quantiles_with_infinities_null_keys_and_a_dominant_value(spark):
    rows = [("edge", math.inf), ("edge", -math.inf), ("edge", 1.0), ("edge", 2.0), ("ups", math.inf), ("ups", math.inf)]
    rows += [(None, 7.0), (None, 9.0)] + [("hot", 1.5)] * 5000 + [("hot", 0.5)] * 10 + [("hot", 2.5)] * 10
    frame = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r.k: (r.n, r.q) for r in q.quantiles(frame, ["k"], "v", [0.0, 0.5, 1.0]).collect()}
    assert got == {
        "edge": (4, [-math.inf, 1.5, math.inf]), "ups": (2, [math.inf] * 3), None: (2, [7.0, 8.0, 9.0]), "hot": (5020, [0.5, 1.5, 2.5]),
    }
    ranks = {(r.k, r.v): r.rk for r in q.average_ranks(frame, ["k"], "v", "rk").collect()}
    assert ranks["edge", -math.inf] == 1 and ranks["edge", math.inf] == 4 and ranks["ups", math.inf] == 1.5
    assert ranks["hot", 1.5] == 10 + 5001 / 2 and ranks[None, 9.0] == 2


def test_average_ranks(spark):
    rng = random.Random(5)
    values = [rng.randint(-5, 5) * 0.5 for _ in range(300)]
    frame = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0)], "k string, v double")
    got = {(r.k, r.v): r.rk for r in q.average_ranks(frame, ["k"], "v", "rk").collect()}
    for v in set(values):
        below, ties = sum(x < v for x in values), sum(x == v for x in values)
        assert got["a", v] == below + (ties + 1) / 2
    assert got["b", 1.0] == 1


@pytest.fixture(scope="module")
def sequences(spark):
    """Random presence and flags on a five-minute grid, several keys."""
    rng = random.Random(7)
    rows = []
    for key in ("a", "b", "c"):
        minute = 0
        for _ in range(300):
            minute += rng.choice([5, 5, 5, 5, 5, 10, 7])
            rows.append((key, minute, rng.random() < 0.7, rng.random() < 0.9))
    frame = spark.createDataFrame(rows, "device_no string, minute int, raw boolean, ok boolean")
    return rows, frame.select("*", F.timestamp_seconds(F.col("minute") * 60).alias("event_time"))


def brute_streaks(rows):
    out, previous, run = {}, {}, {}
    for key, minute, raw, _ in rows:
        if key not in previous or minute - previous[key] != 5:
            run[key] = 0
        run[key] = run[key] + 1 if raw else 0
        previous[key] = minute
        out[key, minute] = run[key]
    return out


@pytest.mark.parametrize("chunk", [None, 37, 1440])
def test_streaks_and_chunks(spark, sequences, chunk):
    rows, frame = sequences
    line = runs.Timeline(("device_no",), chunk_minutes=chunk)
    got = {(r.device_no, r.minute): r.n for r in runs.with_streak(frame, line, F.col("raw"), "n").collect()}
    assert got == brute_streaks(rows)


@pytest.mark.parametrize("chunk", [None, 60])
def test_collapse(spark, sequences, chunk):
    rows, frame = sequences
    line = runs.Timeline(("device_no",), chunk_minutes=chunk)
    got = sorted(
        (r.device_no, r.s, r.e, r.points, r.duration_minutes)
        for r in runs.collapse(frame, line, F.col("raw"))
        .select("*", (F.unix_seconds("start_time") / 60).alias("s"), (F.unix_seconds("end_time") / 60).alias("e"))
        .collect()
    )
    expected, last = [], {}
    for key, minute, raw, _ in rows:
        if not raw:
            continue
        if key in last and minute - last[key] == 5:
            event = [e for e in expected if e[0] == key][-1]
            event[2], event[3], event[4] = minute, event[3] + 1, event[4] + 5
        else:
            expected.append([key, minute, minute, 1, 5])
        last[key] = minute
    assert got == sorted(tuple(e) for e in expected)


def test_isotonic_fit_equals_the_min_max_formula(spark):
    rng, rows = random.Random(8), [(0, []), (1, None), (2, [(1.0, 1.0)])]
    rows += [(i, [(rng.choice([rng.random(), round(rng.random(), 1)]), float(rng.randint(1, 9))) for _ in range(rng.randint(1, 20))]) for i in range(3, 120)]
    frame = spark.createDataFrame(rows, "i int, points array<struct<value: double, weight: double>>")
    got = {r.i: r.fit for r in frame.select("i", isotonic(F.col("points")).alias("fit")).collect()}
    assert got[0] == [] and got[1] is None
    higher = 0
    for i, points in rows[2:]:
        n = len(points)

        def mean(j, k):
            part = points[j : k + 1]
            return sum(v * w for v, w in part) / sum(w for _, w in part)

        want = [max(min(mean(j, k) for k in range(at, n)) for j in range(at + 1)) for at in range(n)]
        assert got[i] == pytest.approx(want)
        running = [max(v for v, _ in points[: at + 1]) for at in range(n)]
        higher += running != pytest.approx(want)
    assert higher > 50  # a running maximum is another thing


def test_bounded_quantiles_equal_the_general_ones(spark):
    rng = random.Random(12)
    pool = [0.0, -0.0, 1.5, 1.5, 2.25, float("inf"), float("-inf"), float("nan"), None]
    rows = [(g, rng.choice(pool) if rng.random() < 0.7 else round(rng.uniform(-5, 5), 2)) for g in ("a", "b", "c", None) for _ in range(60)]
    rows += [("only null", None), ("one", 3.0)]
    frame = spark.createDataFrame(rows, "g string, v double")
    for p in (0.0, 0.05, 0.5, 0.9, 1.0):
        general = {r.g: (r.n, r.q) for r in q.quantile(frame, ["g"], "v", p, "q").collect()}
        bounded = {r.g: (r.n, r.q) for r in q.bounded_quantile(frame, ["g"], "v", p, "q").collect()}
        assert set(general) == set(bounded) == {"a", "b", "c", None, "one"}
        for key, (n, value) in general.items():
            assert bounded[key][0] == n and (bounded[key][1] == pytest.approx(value) or (value != value and bounded[key][1] != bounded[key][1]))


def test_quantiles_of_several_columns(spark):
    frame = spark.createDataFrame([(1, 1.0, 5), (1, 2.0, None), (2, None, 7)], "g int, x double, y int")
    got = {(r.g, r.column): (r.n, r.q) for r in q.quantiles_of_columns(frame, ["g"], ["x", "y"], [0.5]).collect()}
    assert got == {(1, "x"): (2, [1.5]), (1, "y"): (1, [5.0]), (2, "y"): (1, [7.0])}


def test_interpolated_quantiles_are_rounded_once(spark):
    rng = random.Random(5)
    groups = {g: sorted(rng.random() * 50 for _ in range(rng.randint(1, 30))) for g in range(200)}
    frame = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, v double")
    found = {r.g: r.q for r in q.bounded_quantile(frame, ["g"], "v", 0.95, "q").collect()}
    for g, values in groups.items():
        position = 0.95 * (len(values) - 1)
        low, high, share = values[math.floor(position)], values[math.ceil(position)], position - math.floor(position)
        assert found[g] == (low if low == high else math.fma(low, 1 - share, high * share))
    ends = spark.createDataFrame([(0, 1.0), (0, float("inf")), (1, float("-inf")), (1, float("-inf"))], "g int, v double")
    assert {r.g: r.q for r in q.bounded_quantile(ends, ["g"], "v", 0.95, "q").collect()} == {0: float("inf"), 1: float("-inf")}


def test_density_is_one_over_the_mean_distance(spark):
    values = [0.91, 1.0, 1.03, 1.07, 1.21, 1.33, 1.38, 1.6]
    near = []
    for i, v in enumerate(values):
        near.append(sorted((abs(w - v), j) for j, w in enumerate(values) if j != i)[:5])
    density = []
    for m in near:
        total = 0.0
        for d, j in m:
            total += max(d, near[j][-1][0], 0.01)
        density.append(1.0 / (total / 5))
    expected = []
    for i, m in enumerate(near):
        total = 0.0
        for _, j in m:
            total += density[j]
        expected.append(total / 5 / density[i])
    frame = spark.createDataFrame([(values,)], "v array<double>")
    assert frame.select(lof_scores(F.col("v"), 5, 0.01).alias("s")).first().s == expected
