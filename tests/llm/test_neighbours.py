"""The prefix forest against brute force: recall, order, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stringwatch.llm import neighbours
from stringwatch.llm.queries import LLM_QUERIES


def brute(ids, vectors, queries, k=10):
    found = {}
    for i in np.flatnonzero(queries):
        score = np.sqrt(((vectors - vectors[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, score)) if ids[j] != ids[i]][:k]
        found[int(ids[i])] = [(int(ids[j]), score[j]) for j in order]
    return found


def as_lists(rows, name="device_no"):
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r[name], r.score))
        assert len(found[r.query_id]) == r["rank"]
    return found


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])


def test_query_reaches_the_recall(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    ids, vectors = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    want = brute(ids, vectors, ids % 100 == 0)
    got = as_lists(LLM_QUERIES["op7_nearest_profiles"](spark, sf_dir).collect(), "vec_id")
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert recall(got, want) >= 0.9
    place = {i: n for n, i in enumerate(ids)}
    for query, found in got.items():
        assert query not in {i for i, _ in found}
        exact = [np.sqrt(((vectors[place[i]] - vectors[place[query]]) ** 2).sum()) for i, _ in found]
        assert [s for _, s in found] == pytest.approx(exact, rel=1e-12)
        assert found == sorted(found, key=lambda x: (x[1], x[0]))


def test_buckets_and_climbing(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", 60)
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(12, 16))
    vectors = (centers[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16)) * 0.2).astype(np.float32)
    ids = np.arange(3000)
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "device_no long, current_profile array<float>")
    got = as_lists(neighbours.nearest_profiles(frame, F.col("device_no") % 100 == 0, trees=6).collect())
    want = brute(ids, vectors.astype(float), ids % 100 == 0)
    assert recall(got, want) >= 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 2.0, 0.0], "a") for i in range(0, 40)]
    odd = [
        (100, None, "a"), (101, [0.0, 0.0, 0.0], "a"), (102, [1.0, None, 0.0], "a"), (103, [nan, 1.0, 1.0], "a"), (104, [inf, 1.0, 1.0], "a"),
        (105, [1.0], "a"), (None, [1.0, 2.0, 0.0], "a"), (106, [1.0, 2.0, -0.0], "a"), (200, [9.0, 9.0, 9.0], "a"), (200, [9.0, 9.0, 9.0], "a"),
    ]
    frame = spark.createDataFrame(same + odd, "device_no long, current_profile array<double>, score string")
    got = as_lists(neighbours.nearest_profiles(frame, F.col("device_no").isin(0, 5, 39, 100, 101, 106, 200)).collect())
    assert set(got) == {0, 5, 39, 106, 200}
    for query in (0, 5, 39, 106):
        assert got[query] == [(i, 0.0) for i in range(40) if i != query][:10]
    assert [i for i, _ in got[200]] == list(range(10))


def test_fewer_candidates_and_empty_tables(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 3.0])], "device_no long, current_profile array<double>")
    got = as_lists(neighbours.nearest_profiles(frame, F.col("device_no") == 0).collect())
    assert got == {0: [(1, pytest.approx(2**0.5)), (2, pytest.approx(10**0.5))]}
    assert neighbours.nearest_profiles(frame.limit(0), F.col("device_no") == 0).count() == 0
    assert neighbours.nearest_profiles(frame, F.col("device_no") == 9).count() == 0
    assert neighbours.nearest_profiles(frame.limit(1), F.col("device_no") == 0).count() == 0
