"""Session settings every job here relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # scores cost far more than their bytes suggest: small shuffles still use all cores
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
FINE_PARTITIONS = 512


def shuffle_finely(spark: SparkSession) -> None:
    """Shuffles start with many partitions and adaptive execution unites small ones.

    So what a task sorts is bounded by the advised size of a partition and does not
    grow with the tables. A number that the session sets itself stays.
    """
    if spark.conf.get(INITIAL_PARTITIONS, None) is None:
        spark.conf.set(INITIAL_PARTITIONS, str(max(FINE_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))))


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the runtime options on a session that somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("stringwatch")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
