"""Non-decreasing fit of a short list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def isotonic(points: Column) -> Column:
    """Weighted isotonic means of an array of struct(value, weight), in its order.

    Pooling of adjacent violators as a fold: every point opens a block, which
    takes in the blocks before it as long as their mean is not smaller. Meant for
    lists of a bounded length, such as bins; weights are positive. An empty list
    stays empty, null stays null.
    """

    def block(value: Column, weight: Column, size: Column) -> Column:
        return F.struct(value.cast("double").alias("value"), weight.cast("double").alias("weight"), size.cast("int").alias("size"))

    def pooled(a: Column, b: Column) -> Column:
        weight = a["weight"] + b["weight"]
        return block((a["value"] * a["weight"] + b["value"] * b["weight"]) / weight, weight, a["size"] + b["size"])

    none = F.array().cast("array<struct<value: double, weight: double, size: int>>")

    def push(blocks: Column, point: Column) -> Column:
        def back(state: Column, earlier: Column) -> Column:
            goes_on = (F.size(state["kept"]) == 0) & (earlier["value"] >= state["last"]["value"])
            return F.when(
                goes_on, F.struct(pooled(earlier, state["last"]).alias("last"), state["kept"].alias("kept"))
            ).otherwise(F.struct(state["last"].alias("last"), F.array_prepend(state["kept"], earlier).alias("kept")))

        begin = F.struct(block(point["value"], point["weight"], F.lit(1)).alias("last"), none.alias("kept"))
        return F.aggregate(F.reverse(blocks), begin, back, lambda s: F.array_append(s["kept"], s["last"]))

    return F.aggregate(
        points, none, push, lambda blocks: F.flatten(F.transform(blocks, lambda b: F.array_repeat(b["value"], b["size"])))
    )
