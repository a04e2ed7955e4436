"""The given tables as the project's records, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = {"doc_id": "alarm_event_id", "text": "alarm_name", "source": "station_name", "lang": "alarm_code"}


#: put before the name of a column that has a record's name but not its meaning
ASIDE = "own_"


def as_alarms(documents: DataFrame) -> DataFrame:
    """Documents are alarms whose message is the text and whose station is the source.

    Further columns that already have such a name (in any case of letters) are
    set aside under another one until :func:`as_documents`.
    """
    return documents.toDF(*[NAMES.get(c) or (ASIDE + c if _clashes(c) else c) for c in documents.columns])


def as_documents(alarms: DataFrame) -> DataFrame:
    back = {new: old for old, new in NAMES.items()}
    return alarms.toDF(*[back.get(c) or (c.removeprefix(ASIDE) if _clashes(c) else c) for c in alarms.columns])


def _clashes(name: str) -> bool:
    name = name.lower()
    while name.startswith(ASIDE):
        name = name.removeprefix(ASIDE)
    return name in NAMES.values()


def bounded_batches(spark: SparkSession) -> None:
    """Batches of texts sent to Python are bounded by their bytes, and by few rows where texts are short."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_alarms(table(spark, sf_dir, "documents"))
