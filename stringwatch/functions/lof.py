"""One-dimensional local outlier factor of a small peer group."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stringwatch.functions.arrays import let


def lof_scores(values: Column, n_neighbors: int, distance_floor: float) -> Column:
    """Scores in input order for an array of doubles without nulls.

    Every value has exactly ``min(n_neighbors, n - 1)`` neighbours; equal
    distances are resolved by position. Groups of fewer than two values have no
    score.
    """
    floor = F.lit(float(distance_floor))
    zero = F.lit(0.0)

    def neighbours(points: Column) -> Column:
        def nearest(value: Column, position: Column) -> Column:
            others = F.transform(
                points,
                lambda other, j: F.struct(
                    F.when(j != position, F.abs(other - value)).alias("d"), j.alias("j")
                ),
            )
            # the point itself has a null distance, which sorts first
            return F.slice(F.sort_array(others), 2, n_neighbors)

        return F.transform(points, nearest)

    def reach_density(near: Column) -> Column:
        return let(
            F.transform(near, lambda m: F.get(m, F.size(m) - 1)["d"]),
            lambda k_distance: F.transform(
                near,
                # one over the mean distance: the last bit decides about scores on a threshold
                lambda m: 1.0
                / (
                    F.aggregate(m, zero, lambda s, y: s + F.greatest(y["d"], F.get(k_distance, y["j"]), floor))
                    / F.size(m)
                ),
            ),
        )

    def factors(near: Column) -> Column:
        return let(
            reach_density(near),
            lambda density: F.transform(
                near,
                lambda m, i: F.aggregate(m, zero, lambda s, y: s + F.get(density, y["j"]))
                / F.size(m)
                / F.get(density, i),
            ),
        )

    return F.when(F.size(values) >= 2, let(neighbours(values), factors)).otherwise(
        F.transform(values, lambda v: F.lit(None).cast("double"))
    )
