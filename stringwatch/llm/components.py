"""Connected components of links, by alternating stars, on staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringwatch.storage import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links`` has bigint columns a and b; returns node and root, the smallest node it reaches.

    Every round sends each node's larger neighbours, then its smaller ones, to
    its smallest neighbour; rounds grow with the logarithm of a component's
    diameter. Only a count and a checksum per round reach the driver. Nulls and
    links of a node to itself are left out; no links give no rows.
    """
    edges = scratch.stage(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = None
    while True:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("least"))
        small = (
            large.join(smallest, "a")
            .where("b <> least")
            .select(F.col("b").alias("a"), F.col("least").alias("b"))
            .unionAll(smallest.select("a", F.col("least").alias("b")))
            .distinct()
        )
        edges = scratch.stage(small, "links")
        after = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = after
