"""Nearest current profiles by a forest of hash prefixes.

Each tree gives every profile a long string of bits (signs of projections).
Strings are kept as sorted arrays, cut by their first bits into buckets that
tasks hold. A query descends in all trees to the longest prefix it shares with
anything, then ascends in all of them at once, bit by bit, until the prefixes
together cover a wanted number of candidates; their distances are exact.

That number is measured: for a bounded sample of queries the true neighbours
are found by brute force, and the smallest number that reaches the wanted
recall is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stringwatch.storage import Scratch

#: rows of a bucket that tasks aim at; fuller ones are dealt to several tasks
BUCKET_ROWS = 4096
SAMPLE_QUERIES = 64


class Forest:
    """Projections of the trees; the same for the same seed."""

    def __init__(self, dimensions: int, trees: int, bits: int, seed: int, center: np.ndarray):
        rng = np.random.default_rng(seed)
        self.planes = rng.normal(size=(trees, dimensions, bits))
        self.center, self.trees, self.bits = center, trees, bits
        self.weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Bit strings as integers, trees x rows, first bit highest."""
        moved = vectors - self.center
        return np.stack([(moved @ plane > 0) @ self.weights for plane in self.planes])

    def shared(self, codes: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Length of the common prefix of every code with one code of the same tree."""
        differs = codes ^ own[:, None]
        return self.bits - np.ceil(np.log2(differs + 1.0)).astype(np.int64)


def _matrix(column: pd.Series, dimensions: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(-1, dimensions).astype(np.float64)


def usable(profiles: DataFrame) -> DataFrame:
    """device_no and current_profile of rows that can be compared: an id, no null or non-finite number, not zero."""
    number = F.col("current_profile")
    finite = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = profiles.where(F.col("device_no").isNotNull() & number.isNotNull()).where(
        finite & F.exists(number, lambda x: x != 0)
    )
    return kept.select("device_no", "current_profile")


def nearest_profiles(
    profiles: DataFrame,
    is_query: Column,
    neighbours: int = 10,
    recall: float = 0.96,
    trees: int = 12,
    bits: int = 32,
    seed: int = 5,
    scratch: Scratch | None = None,
) -> DataFrame:
    """The ``neighbours`` profiles found nearest to each query profile, by Euclidean distance.

    ``profiles`` has device_no and current_profile, an array of numbers.
    ``is_query`` tells the queries by device_no; all rows but the query's own
    are candidates. Returns query_id, rank (from 1), device_no and score; ties
    go to the smaller device_no; fewer rows if there are fewer candidates.

    Profiles that are null, zero, of another length than most or that hold null
    or non-finite numbers take no part, nor do rows without device_no. Equal
    profiles are searched once and all count; a repeated row counts once. An
    empty table gives no rows; other columns are left out.
    """
    scratch = scratch or Scratch(profiles.sparkSession)
    spark = profiles.sparkSession
    rows = usable(profiles)
    key = rows.schema["device_no"].dataType.simpleString()
    empty = f"query_id {key}, rank int, device_no {key}, score double"
    lengths = rows.groupBy(F.size("current_profile").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], empty)
    dimensions = lengths[0]["d"]
    rows = rows.where(F.size("current_profile") == dimensions)
    element = rows.schema["current_profile"].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = [np.asarray(v, kind).tobytes() for v in batch["current_profile"]]
            yield pd.DataFrame({"device_no": batch["device_no"], "vector": vectors})

    # -0.0 and 0.0 are one number
    rows = rows.withColumn("current_profile", F.transform("current_profile", lambda x: x + F.lit(0).cast(element)))
    flat = scratch.stage(rows.mapInPandas(packed, f"device_no {key}, vector binary").distinct(), "profiles")
    inside = Window.partitionBy("vector").orderBy("device_no")
    firsts = flat.withColumn("place", F.row_number().over(inside)).where(F.col("place") <= neighbours + 1)
    # at most neighbours + 1 ids of a profile; those of the same profile are the nearest there are
    classes = scratch.stage(
        firsts.groupBy("vector").agg(F.min("device_no").alias("class_no"), F.collect_list("device_no").alias("members")), "classes"
    )
    number = classes.count()
    wanted = flat.where(is_query).select(F.col("device_no").alias("query_id"), "vector")
    sample = _matrix(pd.Series([bytes(r.vector) for r in wanted.orderBy(F.xxhash64("query_id")).limit(SAMPLE_QUERIES).collect()]), dimensions, kind)
    if not len(sample):
        return spark.createDataFrame([], empty)
    forest = Forest(dimensions, trees, bits, seed, sample.mean(0))
    quota = _measured_quota(classes, sample, forest, neighbours, recall, dimensions, kind)
    depth = int(max(0, np.ceil(np.log2(number / BUCKET_ROWS))))
    depth = min(depth, bits)

    def planted(batches: Iterator[pd.DataFrame], name: str) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = forest.codes(_matrix(batch["vector"], dimensions, kind))
            for tree in range(trees):
                yield pd.DataFrame(
                    {name: batch[name], "vector": batch["vector"], "tree": tree, "code": codes[tree], "bucket": codes[tree] >> (bits - depth)}
                )

    place = "vector binary, tree int, code bigint, bucket bigint"
    index = scratch.stage(
        classes.select("class_no", "vector").mapInPandas(lambda b: planted(b, "class_no"), f"class_no {key}, {place}"), "forest"
    )
    asked = scratch.stage(wanted.mapInPandas(lambda b: planted(b, "query_id"), f"query_id {key}, {place}"), "asked")
    buckets = (
        index.groupBy("tree", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("parts", F.ceil(F.col("n") / (2 * BUCKET_ROWS)).cast("int"))
    )
    buckets = scratch.stage(buckets, "buckets")
    dealt = index.join(buckets.select("tree", "bucket", "parts"), ["tree", "bucket"]).withColumn(
        "part", F.pmod(F.xxhash64("class_no"), F.col("parts")).cast("int")
    )
    spread = buckets.select("tree", "bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def count(own: pd.DataFrame, sorted_by: pd.DataFrame) -> pd.DataFrame:
        """How many strings of the bucket share each number of bits, from the bucket's own on."""
        codes = np.sort(sorted_by["code"].to_numpy())
        shifts = bits - np.arange(depth, bits + 1)
        found = []
        for query, code in zip(own["query_id"], own["code"]):
            low = np.searchsorted(codes, code >> shifts << shifts)
            high = np.searchsorted(codes, ((code >> shifts) + 1) << shifts)
            found.append(pd.DataFrame({"query_id": query, "depth": np.arange(depth, bits + 1), "n": high - low}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "depth": [], "n": []})

    places = ["tree", "bucket", "part"]
    in_bucket = (
        asked.select("query_id", "tree", "code", "bucket")
        .join(spread, ["tree", "bucket"])
        .groupBy(*places)
        .cogroup(dealt.select(*places, "code").groupBy(*places))
        .applyInPandas(lambda own, other: count(own, other), f"query_id {key}, depth int, n bigint")
    )
    above = [F.struct(F.lit(d).alias("depth"), F.shiftright("bucket", depth - d).alias("prefix")) for d in range(depth)]
    counted = in_bucket
    if above:
        levels = buckets.select("tree", "n", F.inline(F.array(*above))).groupBy("tree", "depth", "prefix").agg(F.sum("n").alias("n"))
        climbing = asked.select("query_id", "tree", F.inline(F.array(*above)))
        counted = in_bucket.unionByName(climbing.join(levels, ["tree", "depth", "prefix"]).select("query_id", "depth", "n"))
    # one part of one tree must have enough strings by itself, so that no query is left with too few
    enough = (F.col("n") >= quota) & (F.col("most") > neighbours)
    reached = (
        counted.groupBy("query_id", "depth")
        .agg(F.sum("n").alias("n"), F.max("n").alias("most"))
        .groupBy("query_id")
        .agg(F.coalesce(F.max(F.when(enough, F.col("depth"))), F.lit(0)).alias("depth"))
    )
    reached = scratch.stage(reached, "reached")
    up = F.greatest(F.lit(depth) - F.col("depth"), F.lit(0))
    first = F.expr(f"shiftleft(shiftright(bucket, {0} + up), up)")
    searched = (
        asked.join(reached, "query_id")
        .withColumn("up", up)
        .withColumn("bucket", F.explode(F.sequence(first, first + F.expr("shiftleft(1L, up)") - 1)))
        .join(spread, ["tree", "bucket"])
        .select(*places, "query_id", "code", "vector", "depth")
    )

    def search(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        """The nearest strings' profiles under the prefix that each query has reached."""
        found = []
        if len(own) and len(other):
            order = np.argsort(other["code"].to_numpy(), kind="stable")
            codes, names = other["code"].to_numpy()[order], other["class_no"].to_numpy()[order]
            vectors = _matrix(other["vector"], dimensions, kind)[order]
            targets = _matrix(own["vector"], dimensions, kind)
            for query, code, level, target in zip(own["query_id"], own["code"], own["depth"], targets):
                shift = bits - level
                low = np.searchsorted(codes, code >> shift << shift)
                high = np.searchsorted(codes, ((code >> shift) + 1) << shift)
                if high == low:
                    continue
                apart = vectors[low:high] - target
                score = np.sqrt(np.einsum("ij,ij->i", apart, apart))
                best = np.lexsort((names[low:high], score))[: neighbours + 1]
                found.append(pd.DataFrame({"query_id": query, "class_no": names[low:high][best], "score": score[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "class_no": [], "score": []})

    nearest = (
        searched.groupBy(*places)
        .cogroup(dealt.select(*places, "class_no", "code", "vector").groupBy(*places))
        .applyInPandas(lambda own, other: search(own, other), f"query_id {key}, class_no {key}, score double")
        .groupBy("query_id", "class_no")
        .agg(F.min("score").alias("score"))
    )
    by_class = Window.partitionBy("query_id").orderBy("score", "class_no")
    kept = nearest.withColumn("place", F.row_number().over(by_class)).where(F.col("place") <= neighbours + 1)
    named = kept.join(classes.select("class_no", "members"), "class_no").select("query_id", "score", F.explode("members").alias("device_no"))
    ranked = Window.partitionBy("query_id").orderBy("score", "device_no")
    return (
        named.where("device_no <> query_id")
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= neighbours)
        .select("query_id", "rank", "device_no", "score")
    )


def _measured_quota(
    classes: DataFrame, sample: np.ndarray, forest: Forest, neighbours: int, recall: float, dimensions: int, kind: str
) -> int:
    """Strings under the prefixes that the sample's queries need for the wanted recall.

    Every profile meets the sample (at most ``SAMPLE_QUERIES`` queries); a task
    returns the nearest it has and how many strings share each prefix length.
    """
    own = forest.codes(sample)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared = np.zeros((len(sample), forest.bits + 1), np.int64)
        nearest = [(np.zeros(0), np.zeros(0, np.int64))] * len(sample)
        for batch in batches:
            vectors = _matrix(batch["vector"], dimensions, kind)
            codes = forest.codes(vectors)
            for s, target in enumerate(sample):
                lengths = forest.shared(codes, own[:, s])
                shared[s] += np.bincount(lengths.ravel(), minlength=forest.bits + 1)
                apart = vectors - target
                score = np.sqrt(np.einsum("ij,ij->i", apart, apart))
                score[score == 0] = np.inf  # the query's own profile
                score = np.concatenate([nearest[s][0], score])
                longest = np.concatenate([nearest[s][1], lengths.max(0)])
                best = np.argsort(score, kind="stable")[:neighbours]
                nearest[s] = score[best], longest[best]
        for s in range(len(sample)):
            at = np.flatnonzero(shared[s])
            yield pd.DataFrame({"query": s, "length": at, "n": shared[s][at], "score": np.nan})
            score, longest = nearest[s]
            yield pd.DataFrame({"query": s, "length": longest, "n": 0, "score": score})

    met = classes.select("vector").mapInPandas(meet, "query int, length int, n bigint, score double")
    counts = np.zeros((len(sample), forest.bits + 1), np.int64)
    for row in met.where("score is null or isnan(score)").groupBy("query", "length").agg(F.sum("n").alias("n")).collect():
        counts[row.query, row.length] = row.n
    best = Window.partitionBy("query").orderBy("score")
    near = met.where("score is not null and not isnan(score) and score < double('infinity')")
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= neighbours).toPandas()
    if near.empty:
        return 1
    covered = counts[:, ::-1].cumsum(1)[:, ::-1]  # strings that share so many bits or more
    queries, lengths = near["query"].to_numpy(), near["length"].to_numpy()
    for quota in np.unique(covered):
        depth = np.where(covered >= quota, np.arange(forest.bits + 1), 0).max(1)
        if (lengths >= depth[queries]).mean() >= recall:
            return int(max(quota, 1))
    return int(covered.max())
