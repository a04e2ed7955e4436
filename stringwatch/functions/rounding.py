"""Arithmetic that rounds once, so that values on a threshold fall on the same side everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stringwatch.functions.arrays import let

# 2^27 + 1 splits a double into two halves whose products are exact
SPLIT = 134_217_729.0


def fused(a: Column, b: Column, c: Column) -> Column:
    """``a * b + c`` with the error of the product and of the sum added back."""

    def halves(x: Column) -> Column:
        high = x * SPLIT - (x * SPLIT - x)
        return F.struct(x.alias("x"), high.alias("h"), (x - high).alias("l"))

    def corrected(t: Column) -> Column:
        x, y = t["a"], t["b"]
        product_error = x["l"] * y["l"] - (((t["p"] - x["h"] * y["h"]) - x["l"] * y["h"]) - x["h"] * y["l"])
        added = t["s"] - t["p"]
        sum_error = (t["p"] - (t["s"] - added)) + (t["c"] - added)
        error = product_error + sum_error
        # infinite values have no error
        return F.when(F.isnan(error), t["s"]).otherwise(t["s"] + error)

    parts = F.struct(halves(a).alias("a"), halves(b).alias("b"), c.alias("c"), (a * b).alias("p"), (a * b + c).alias("s"))
    return let(parts, corrected)


def between(low: Column, high: Column, share: Column) -> Column:
    """The value at ``share`` of the way from ``low`` to ``high``."""
    return F.when(low == high, low).otherwise(fused(low, 1 - share, high * share))
