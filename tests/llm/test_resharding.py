"""Minimum-cost flow against exhaustive search; shards against their law."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stringwatch.llm import resharding
from stringwatch.llm.queries import LLM_QUERIES
from stringwatch.storage import Scratch


def cheapest_by_search(supplies, capacities, costs):
    best = np.inf
    options = [
        [c for c in itertools.product(range(s + 1), repeat=len(capacities)) if sum(c) == s] for s in supplies
    ]
    for flow in itertools.product(*options):
        if all(sum(f[j] for f in flow) <= c for j, c in enumerate(capacities)):
            best = min(best, sum(costs[i][j] * x for i, f in enumerate(flow) for j, x in enumerate(f)))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_flow_is_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    supplies = rng.integers(0, 5, 3).tolist()
    capacities = rng.integers(0, 4, 3)
    capacities[0] += max(0, sum(supplies) - capacities.sum())
    costs = rng.integers(0, 6, (3, 3)).astype(float)
    flow = resharding.cheapest_flow(supplies, capacities.tolist(), costs)
    assert (flow >= 0).all() and flow.sum(1).tolist() == supplies and (flow.sum(0) <= capacities).all()
    assert (flow * costs).sum() == cheapest_by_search(supplies, capacities.tolist(), costs)


def test_least_bytes_move():
    supplies, capacities = [100, 10, 40], resharding.equal_capacities(150, 4)
    flow = resharding.cheapest_flow(supplies, capacities, 1 - np.eye(3, 4))
    assert sum(flow[i, j] for i in range(3) for j in range(4) if i != j) == 100 - capacities[0] + 40 - capacities[2]
    with pytest.raises(ValueError):
        resharding.cheapest_flow([5], [4], np.ones((1, 1)))


def test_query_obeys_its_law(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = LLM_QUERIES["op3_resharding"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots, sizes = {}, [0] * 24
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert r.law == "bytes" and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(24))
    assert max(sizes) - min(sizes) < 0.02 * np.mean(sizes)


def test_only_affected_shards_are_written(spark):
    rows = [(i, "x" * 92, i % 3, "old", i) for i in range(300)] + [(1000 + i, "x" * 92, 0, "old", i) for i in range(100)]
    alarms = spark.createDataFrame(rows, "alarm_event_id long, alarm_name string, present int, shard string, _n long")
    scratch = Scratch(spark)
    path = scratch.path("shards")
    placed, moves = resharding.reshard_alarms(alarms, F.col("present"), 4, [10000, 10000, 10000, 10000], path=path, scratch=scratch)
    assert placed.columns == ["alarm_event_id", "alarm_name", "present", "_n", "shard", "slot"]
    assert moves.affected == [0, 3] and moves.moved_bytes == 10000
    assert {r.shard for r in spark.read.parquet(path).select("shard").distinct().collect()} == {0, 3}
    got = placed.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b")).collect()
    assert sorted(map(tuple, got)) == [(i, 100, 0, 99) for i in range(4)]
    assert placed.where("shard in (1, 2) and present <> shard").count() == 0
    same, moves = resharding.reshard_alarms(alarms.where("alarm_event_id < 300"), F.col("present"), 3)
    assert moves.affected == [] and same.where("present <> shard").count() == 0 and same.count() == 300


def test_odd_rows(spark):
    rows = [(None, None, None), (None, "", 1), (None, "é" * 9, 1), (4, "same", 0), (4, "same", 0), (5, "y" * 100000, 0)]
    alarms = spark.createDataFrame(rows, "alarm_event_id long, alarm_name string, present int")
    placed, _ = resharding.reshard_alarms(alarms, F.col("present"), 3)
    got = placed.collect()
    assert len(got) == 6 and len({(r.shard, r.slot) for r in got}) == 6
    assert len({r.shard for r in got if r.alarm_event_id == 4}) == 1
    empty, moves = resharding.reshard_alarms(alarms.limit(0), F.col("present"), 3)
    assert empty.count() == 0 and moves.moved_bytes == 0
