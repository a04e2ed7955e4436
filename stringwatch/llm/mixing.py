"""Mixing alarm sources to target weights by Poisson replication, in SQL functions only.

Each source gets a mean repetition rate; every alarm draws its own number of
copies from the Poisson distribution of that mean by inverting the distribution
at a uniform number that a seeded hash of the alarm gives. Copies are exploded
and put into a global pseudo-random order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: exp(-mean) stays far from underflow below it; larger means are sums of several draws
LARGEST_MEAN = 500.0
#: parts that a source's rows are dealt to where they meet its rate
SALTS = 256


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts))


def _uniform(digest: Column) -> Column:
    """52 bits of a hex digest as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def _distribution(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to where the rest is below the grain of the uniform numbers."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    first = F.exp(-mean)
    return F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all")),
        lambda s, k: F.struct(
            (s["p"] * mean / k).alias("p"),
            (s["c"] + s["p"] * mean / k).alias("c"),
            F.concat(s["all"], F.array(s["c"] + s["p"] * mean / k)).alias("all"),
        ),
        lambda s: s["all"],
    )


def repetition_rates(
    alarms: DataFrame,
    weights: DataFrame,
    epochs: float = 1.0,
    default_weight: float = 0.0,
) -> DataFrame:
    """One row per source: rows, weight and mean repetition rate.

    ``weights`` has station_name and weight, one row per source. Shares are
    normalised over the sources that have rows; the rates make the expected
    total ``epochs`` times the number of rows.
    """
    counts = alarms.groupBy("station_name").agg(F.count(F.lit(1)).alias("source_rows"))
    wanted = weights.select(F.col("station_name").alias("_name"), F.col("weight").cast("double").alias("_weight"))
    known = counts.join(wanted, counts.station_name.eqNullSafe(wanted._name), "left").select(
        "station_name", "source_rows", F.coalesce("_weight", F.lit(default_weight)).alias("weight")
    )
    totals = known.agg(F.sum("source_rows").alias("_rows"), F.sum("weight").alias("_weights"))
    return known.join(totals).select(  # totals is one row
        "station_name",
        "source_rows",
        "weight",
        F.coalesce(
            F.col("weight") * epochs * F.col("_rows") / F.nullif("_weights", F.lit(0.0)) / F.col("source_rows"), F.lit(0.0)
        ).alias("rate"),
    )


def mix_alarm_sources(
    alarms: DataFrame,
    weights: DataFrame,
    epochs: float = 1.0,
    default_weight: float = 0.0,
    seed: int = 17,
    ordered: bool = True,
) -> DataFrame:
    """Replicate alarms so that their sources appear in target proportions.

    Returns the columns of ``alarms`` with ``copy_no`` (from 1) and
    ``shuffle_key``, in the order of that key (``ordered``; without it rows come
    as they are). An alarm whose draw is 0 has no row: that is the operator.

    A null source is a source of its own; null or repeated ids: equal ids draw
    alike, an alarm without id draws by its text. Null and empty texts are
    replicated like others. Empty tables give empty tables. Input columns named
    like an output column are replaced.
    """
    rates = repetition_rates(alarms, weights, epochs, default_weight)
    draws = F.greatest(F.ceil(F.col("rate") / LARGEST_MEAN), F.lit(1)).cast("int")
    # a source may hold a third of all rows: each is met by SALTS copies of its rate
    tables = rates.select(
        F.col("station_name").alias("_mix_source"),
        draws.alias("_mix_draws"),
        _distribution(F.col("rate") / draws).alias("_mix_table"),
    ).withColumn("_mix_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    identity = F.coalesce(F.col("alarm_event_id").cast("string"), F.md5("alarm_name"), F.lit(""))
    uniforms = F.transform(
        F.sequence(F.lit(1), F.col("_mix_draws")),
        lambda i: _uniform(_hash(F.lit(str(seed)), F.col("_mix_identity"), i.cast("string"))),
    )
    number = F.aggregate(
        F.col("_mix_uniforms"),
        F.lit(0),
        lambda total, u: total + F.size(F.filter(F.col("_mix_table"), lambda c: c <= u)),
    )
    kept = [c for c in alarms.columns if c not in ("copy_no", "shuffle_key")]
    drawn = (
        alarms.select(*kept)
        .withColumn("_mix_identity", identity)
        .withColumn("_mix_salt", F.pmod(F.xxhash64("_mix_identity"), F.lit(SALTS)).cast("int"))
        .join(tables, F.col("station_name").eqNullSafe(F.col("_mix_source")) & (F.col("_mix_salt") == F.col("_mix_part")))
        .withColumn("_mix_uniforms", uniforms)
        .withColumn("_mix_number", number)
        .where("_mix_number > 0")
    )
    copies = drawn.select(
        *kept,
        "_mix_identity",
        F.explode(F.sequence(F.lit(1), F.col("_mix_number"))).alias("copy_no"),
    ).withColumn("shuffle_key", _hash(F.lit(str(seed)), F.lit("order"), F.col("_mix_identity"), F.col("copy_no").cast("string")))
    mixed = copies.select(*kept, "copy_no", "shuffle_key")
    return mixed.orderBy("shuffle_key", "alarm_event_id", "copy_no") if ordered else mixed
