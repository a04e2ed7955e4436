"""As-of join with a bounded look-back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stringwatch.functions.timegrid import MICROS_PER_MINUTE


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    columns: Sequence[str],
    tolerance_minutes: int,
    bucket_minutes: int = 60,
) -> DataFrame:
    """Attach the latest right row at or before each left time, within tolerance.

    Both sides are stacked and the right values are carried forward by a window
    over key and time bucket; right rows are repeated into the next bucket their
    tolerance reaches, so a busy key is split by time without losing a match.
    """
    bucket = bucket_minutes * MICROS_PER_MINUTE
    tolerance = tolerance_minutes * MICROS_PER_MINUTE
    at = F.unix_micros(right_time)
    values = F.struct(F.col(right_time).alias("_slot"), *[F.col(c) for c in columns])
    reach = F.sequence(F.floor(at / bucket), F.floor((at + F.lit(tolerance)) / bucket))
    carried = right.where(F.col(right_time).isNotNull()).select(
        *keys, at.alias("_at"), F.explode(reach).alias("_bucket"), F.lit(0).alias("_side"), values.alias("_value")
    )
    rows = left.select(
        *keys,
        F.unix_micros(left_time).alias("_at"),
        # rows without a time match nothing; they are spread over buckets that no time has
        F.coalesce(
            F.floor(F.unix_micros(left_time) / bucket), F.pmod(F.xxhash64(*left.columns), F.lit(4_096)) - (1 << 40)
        ).alias("_bucket"),
        F.lit(1).alias("_side"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_row"),
    )
    stacked = rows.unionByName(carried, allowMissingColumns=True)
    order = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy("_at", "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    matched = stacked.withColumn("_value", F.last("_value", ignorenulls=True).over(order)).where("_side = 1")
    near = F.col("_at") - F.unix_micros("_value._slot") <= tolerance
    return matched.select(
        "_row.*",
        F.when(near, F.col("_value._slot")).alias(f"matched_{right_time}"),
        *[F.when(near, F.col(f"_value.{c}")).alias(c) for c in columns],
    )
