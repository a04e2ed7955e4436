"""Resharding of alarm files by minimum-cost flow.

Old shard sizes are supplies, new capacities are demands, a byte that changes
its shard costs one. The cheapest flow says how many bytes go from which shard
to which. Old shards are cut into blocks by a hash of the rows' ids; blocks are
picked to make up the transfers, and only shards that gain or lose a block have
their files rewritten.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stringwatch.storage import Scratch

#: blocks of an old shard: enough to fit transfers closely, and each below BLOCK_BYTES on average
LEAST_BLOCKS, BLOCK_BYTES = 256, 128 << 20
ROW_BYTES = 8


def row_size(text: str = "alarm_name") -> Column:
    """UTF-8 bytes of the text and ``ROW_BYTES``; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + ROW_BYTES


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def cheapest_flow(supplies: Sequence[int], capacities: Sequence[int], costs: np.ndarray) -> np.ndarray:
    """Flow (old x new) of least cost that ships all supplies, by successive shortest paths.

    Nodes are shards only: the size of the problem is old times new shards.
    """
    old, new = len(supplies), len(capacities)
    flow, left, room = np.zeros((old, new), np.int64), list(map(int, supplies)), list(map(int, capacities))
    if sum(left) > sum(room):
        raise ValueError("the new shards do not hold all bytes")
    height = np.zeros(old + new)
    while any(left):
        distance, before = np.full(old + new, np.inf), np.full(old + new, -1)
        queue = [(0.0, i) for i in range(old) if left[i]]
        for _, i in queue:
            distance[i] = 0.0
        heapq.heapify(queue)
        while queue:
            d, node = heapq.heappop(queue)
            if d > distance[node]:
                continue
            if node < old:
                steps = [(old + j, costs[node, j]) for j in range(new)]
            else:
                steps = [(i, -costs[i, node - old]) for i in np.flatnonzero(flow[:, node - old])]
            for other, cost in steps:
                longer = d + max(cost + height[node] - height[other], 0.0)
                if longer < distance[other] - 1e-12:
                    distance[other], before[other] = longer, node
                    heapq.heappush(queue, (longer, other))
        ends = [j for j in range(new) if room[j] and np.isfinite(distance[old + j])]
        end = min(ends, key=lambda j: distance[old + j] + height[old + j])
        path, node = [old + end], old + end
        while before[node] >= 0:
            node = int(before[node])
            path.append(node)
        path.reverse()
        amount = min([left[path[0]], room[end]] + [int(flow[b, a - old]) for a, b in zip(path, path[1:]) if a >= old])
        for a, b in zip(path, path[1:]):
            if a < old:
                flow[a, b - old] += amount
            else:
                flow[b, a - old] -= amount
        left[path[0]] -= amount
        room[end] -= amount
        reached = distance[old + end]
        height += np.minimum(distance, reached)
    return flow


@dataclass
class Moves:
    """Where every block goes, and what that costs."""

    blocks: list[tuple[int, int, int, int]]  # old shard, block, new shard, rows before it in the new shard
    affected: list[int]
    flow: np.ndarray
    moved_bytes: int


def pick_blocks(blocks: Sequence[tuple[int, int, int, int]], flow: np.ndarray, capacities: Sequence[int]) -> Moves:
    """Deal whole blocks (old shard, block, bytes, rows) out so that sizes come close to the flow."""
    target: dict[tuple[int, int], int] = {}
    filled, held = [0] * len(capacities), [[] for _ in capacities]
    for old in sorted({b[0] for b in blocks}):
        wanted = {int(j): int(flow[old, j]) for j in np.flatnonzero(flow[old])} or {old: 0}
        for _, block, size, _ in sorted((b for b in blocks if b[0] == old), key=lambda b: (-b[2], b[1])):
            j = max(wanted, key=lambda j: (wanted[j], j == old, -j))
            wanted[j] -= size
            target[old, block] = j
            filled[j] += size
            held[j].append((size, old, block))
    for _ in range(4 * len(capacities)):  # even out what whole blocks leave over
        over = max(range(len(capacities)), key=lambda j: filled[j] - capacities[j])
        under = min(range(len(capacities)), key=lambda j: filled[j] - capacities[j])
        gap = (filled[over] - capacities[over]) - (filled[under] - capacities[under])
        small = [b for b in held[over] if b[0] < gap]
        if not small:
            break
        best = min(small, key=lambda b: (abs(gap - 2 * b[0]), b))
        held[over].remove(best)
        held[under].append(best)
        filled[over] -= best[0]
        filled[under] += best[0]
        target[best[1], best[2]] = under
    before, out, moved, affected = [0] * len(capacities), [], 0, set()
    for old, block, size, rows in sorted(blocks):
        new = target[old, block]
        out.append((old, block, new, before[new]))
        before[new] += rows
        if new != old:
            moved += size
            affected |= {old, new}
    return Moves(out, sorted(j for j in affected if j < len(capacities)), flow, moved)


def reshard_alarms(
    alarms: DataFrame,
    old_shard: Column,
    shards: int = 24,
    capacities: Sequence[int] | None = None,
    costs: np.ndarray | None = None,
    path: str | None = None,
    scratch: Scratch | None = None,
    order: Column | None = None,
) -> tuple[DataFrame, Moves]:
    """Move alarms from their old shards into ``shards`` new ones.

    ``old_shard`` numbers the present shards from 0 (null counts as 0), shard i
    staying in place as new shard i. ``capacities`` are bytes (default: as equal
    as can be); ``costs`` per byte, old x new (default: 1 for every change).
    A row's size is :func:`row_size`. The files of affected shards are written
    to ``path`` (default: a new folder of the shared one), in folders
    ``shard=<n>``; the others are left as they are.

    Returns all alarms with their columns, ``shard`` and ``slot`` (gapless from
    0 in every shard), read from the written files and from the untouched
    shards, and the moves. Null and empty texts have ``ROW_BYTES`` bytes. Blocks
    and slots go by a hash of the id (of the text without one), then by size and
    text, so equal ids stay in one block; with ``order``, a column of keys that a
    second reading gives again, they go by a hash of that, and rows of one id
    come apart. Input columns named shard or slot are replaced. An empty table
    moves nothing.
    """
    scratch = scratch or Scratch(alarms.sparkSession)
    spark = alarms.sparkSession
    kept = [c for c in alarms.columns if c.lower() not in ("shard", "slot")]
    identity = F.coalesce(F.col("alarm_event_id").cast("string"), F.concat(F.lit("#"), F.coalesce("alarm_name", F.lit(""))))
    key = identity if order is None else order
    placed = alarms.select(
        *kept, F.coalesce(old_shard, F.lit(0)).cast("int").alias("_old"), row_size().alias("_size"), F.xxhash64(key).alias("_hash")
    )
    number = LEAST_BLOCKS
    while True:
        in_block = F.pmod("_hash", F.lit(number)).cast("int")
        blocks = [
            (r["_old"], r["_block"], r["size"], r["rows"])
            for r in placed.select("_old", "_size", in_block.alias("_block"))
            .groupBy("_old", "_block")
            .agg(F.sum("_size").alias("size"), F.count(F.lit(1)).alias("rows"))
            .collect()  # at most LEAST_BLOCKS a shard, or a row per BLOCK_BYTES
        ]
        total = sum(b[2] for b in blocks)
        old_shards = max((b[0] for b in blocks), default=-1) + 1
        needed = -(-total // (BLOCK_BYTES * max(old_shards, 1)))
        if needed <= number:
            break
        number = needed
    supplies = [0] * old_shards
    for old, _, size, _ in blocks:
        supplies[old] += size
    capacities = list(capacities) if capacities is not None else equal_capacities(total, shards)
    if costs is None:
        costs = 1.0 - np.eye(max(old_shards, 1), len(capacities))
    flow = cheapest_flow(supplies, capacities, costs) if blocks else np.zeros((0, len(capacities)), np.int64)
    moves = pick_blocks(blocks, flow, capacities)
    plan = scratch.stage(
        spark.createDataFrame(moves.blocks or [], "_plan_old int, _plan_block int, shard int, _base bigint"), "moves"
    )
    found = placed.withColumn("_block", in_block).join(
        plan, (F.col("_old") == F.col("_plan_old")) & (F.col("_block") == F.col("_plan_block"))
    )
    inside = Window.partitionBy("shard", "_old", "_block").orderBy("_hash", "_size", "alarm_name")
    ordered = found.repartitionByRange("shard", "_old", "_block").select(
        *kept, "shard", (F.col("_base") + F.row_number().over(inside) - 1).alias("slot")
    )
    affected = moves.affected
    if not affected:
        return ordered, moves
    path = path or scratch.path("shards")
    ordered.where(F.col("shard").isin(affected)).write.option("compression", "zstd").partitionBy("shard").parquet(path)
    schema = ordered.select(*kept, "slot", "shard").schema
    rewritten = spark.read.schema(schema).parquet(path)
    untouched = [j for j in range(len(capacities)) if j not in affected]
    if untouched:
        rewritten = rewritten.unionByName(ordered.where(F.col("shard").isin(untouched)))
    return rewritten.select(*kept, "shard", "slot"), moves
