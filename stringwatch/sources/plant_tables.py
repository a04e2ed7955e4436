"""Tables kept as one package of CSV files per plant, and their combination.

A table lies below ``plant_id=<plant>`` folders; the plant is the partition
column and is read as text, whatever it looks like.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stringwatch.operators.numbering import with_row_numbers
from stringwatch.schema import key_text, require_columns


def numbered_by_plant(frame: DataFrame, order: Sequence[str]) -> DataFrame:
    """``row`` from 1 in every plant, by ``order``, which is unique inside a plant.

    Rows are numbered over all plants first, so that no task holds a plant.
    """
    numbered = with_row_numbers(frame.drop("row"), ["plant_id", *order], "_number")
    firsts = numbered.groupBy("plant_id").agg(F.min("_number").alias("_first"))
    return numbered.join(firsts, "plant_id").withColumn("row", F.col("_number") - F.col("_first") + 1).drop("_number", "_first")


def write_plant_tables(frame: DataFrame, path: str) -> None:
    """One folder of CSV files per plant; an existing target is an error."""
    require_columns(frame, ("plant_id",), "table")
    frame.hint("rebalance", "plant_id").write.mode("errorifexists").option("header", "true").partitionBy("plant_id").csv(path)


def read_plant_tables(spark: SparkSession, root: str, schema: StructType | str, pattern: str = "*.csv") -> DataFrame:
    """The files of all ``plant_id=*`` folders below ``root`` that match ``pattern``.

    ``schema`` declares the columns of the files, in their order. A file whose
    header differs fails the job, and so does a root without any plant.
    """
    declared = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    fields = [f for f in declared.fields if f.name != "plant_id"]
    # only names are listed here, no file is opened
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root)
    if "plant_id" not in listed.columns or listed.select("path").isEmpty():
        raise FileNotFoundError(f"no plant_id folders with {pattern} below {root}")
    return (
        spark.read.option("pathGlobFilter", pattern)
        .schema(StructType([*fields, StructField("plant_id", StringType())]))
        .option("header", "true")
        .option("enforceSchema", "false")
        .option("mode", "FAILFAST")
        .csv(root)
    )


def combine_plant_tables(frame: DataFrame, order: Sequence[str] = ("row",)) -> DataFrame:
    """All plants as one table: ``row`` counts over all, plants in text order, ``event_id`` names its plant too.

    ``order`` is unique inside a plant; by default the plants' own row numbers.
    A table without ``event_id`` keeps its columns.
    """
    require_columns(frame, ("plant_id", *order), "per-plant table")
    plant = key_text("plant_id")
    keyed = frame.withColumn("plant_id", plant).withColumnsRenamed({c: f"_order_{c}" for c in order if c == "row"})
    names = [f"_order_{c}" if c == "row" else c for c in order]
    result = with_row_numbers(keyed, ["plant_id", *names], "row")
    if "event_id" in frame.columns:
        result = result.withColumn("event_id", F.concat(F.lit("plant-"), "plant_id", F.lit("-"), "event_id"))
    return result.drop(*[n for n in names if n.startswith("_order_")])
