"""Largest-gap split of one device-time's sorted residuals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stringwatch.functions.arrays import let, median_of_sorted


def largest_gap(residuals: Column, minimum_strings: int, maximum_fraction: float) -> Column:
    """Lower group below the widest gap, as a struct.

    ``residuals`` is an array of (r, string_no). Splits leave at least
    ``minimum_strings`` below and one above; the widest gap wins, the smaller
    group on a tie. A lower group above ``maximum_fraction`` is rejected as a
    whole: size zero, no members.
    """

    def split(ordered: Column) -> Column:
        n = F.size(ordered)
        candidates = F.when(
            n > minimum_strings,
            F.transform(
                F.sequence(F.lit(minimum_strings), n - 1),
                lambda k: F.struct(
                    (F.get(ordered, k)["r"] - F.get(ordered, k - 1)["r"]).alias("gap"), (-k).alias("k")
                ),
            ),
        )
        return let(F.array_max(candidates), lambda best: group(ordered, best["gap"], -best["k"]))

    def group(ordered: Column, gap: Column, k: Column) -> Column:
        kept = k.isNotNull() & (k <= F.size(ordered) * F.lit(float(maximum_fraction)))
        size = F.when(kept, k).otherwise(0)
        lower = F.slice(ordered, 1, size)
        return F.struct(
            gap.alias("gap"),
            size.alias("size"),
            F.when(kept, median_of_sorted(F.transform(lower, lambda s: s["r"]))).alias("median"),
            F.transform(lower, lambda s: s["string_no"]).alias("members"),
        )

    return let(F.sort_array(residuals), split)
