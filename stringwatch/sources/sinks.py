"""Writers: partitioned tables, exports with reconciliation, reports, models."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stringwatch.config import Settings
from stringwatch.functions.timegrid import local_date, utc_bound
from stringwatch.schema import require_columns
from stringwatch.storage import remove

# the default length of an export, a parameter of it
MAXIMUM_EXPORT_DAYS = 31


def write_partitioned(frame: DataFrame, path: str, time: str = "event_time", timezone: str = "Asia/Shanghai") -> None:
    """Parquet by plant and local date; an existing target is an error.

    Rows are rebalanced by partition value first: one writer per partition
    usually, several where a plant-day is large.
    """
    require_columns(frame, ("plant_id", time), "table")
    dated = frame.withColumn("date", local_date(time, timezone))
    dated.hint("rebalance", "plant_id", "date").write.mode("errorifexists").partitionBy("plant_id", "date").parquet(path)


def local_date_range(start: dt.date, end: dt.date, maximum_days: int | None = MAXIMUM_EXPORT_DAYS) -> tuple[str, str]:
    """Half-open range of local dates as bounds, at most ``maximum_days``; None sets no limit."""
    if end <= start:
        raise ValueError("end must be later than start")
    if maximum_days is not None and (end - start).days > maximum_days:
        raise ValueError(f"an export covers at most {maximum_days} days")
    return f"{start.isoformat()}T00:00:00", f"{end.isoformat()}T00:00:00"


def export_dataset(
    frame: DataFrame,
    path: str,
    start: dt.date,
    end: dt.date,
    time: str,
    timezone: str = "Asia/Shanghai",
    plant_id: str | None = None,
    maximum_days: int | None = MAXIMUM_EXPORT_DAYS,
) -> dict[str, Any]:
    """Write a date range as date partitions and reconcile the row count.

    Rows are counted by the writing job itself and again in the written table.
    """
    first, last = local_date_range(start, end, maximum_days)
    chosen = frame.where((F.col(time) >= utc_bound(first, timezone)) & (F.col(time) < utc_bound(last, timezone)))
    target = path
    if plant_id is not None:
        if "plant_id" not in frame.columns:
            raise ValueError("the dataset does not declare plant_id")
        chosen = chosen.where(F.col("plant_id").cast("string") == plant_id)
        target = f"{path}/plant_id={plant_id}"
        chosen = chosen.drop("plant_id")
    seen = Observation("export")
    counted = chosen.withColumn("date", local_date(time, timezone)).observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("errorifexists").partitionBy("date").parquet(target)
    written = frame.sparkSession.read.parquet(target).count() if seen.get["rows"] else 0
    if written != seen.get["rows"]:
        raise RuntimeError(f"exported {written} rows, expected {seen.get['rows']}")
    return {"exported_rows": written, "output": target, "plant_id": plant_id}


def export_csv(
    frame: DataFrame, path: str, time: str, timezone: str = "Asia/Shanghai", plants: Sequence[str] | None = None
) -> DataFrame:
    """Raw rows as CSV by plant and local day; returns the manifest of what was written.

    A row without a valid time fails the job. The manifest is read back from the
    files, not taken from the input. Rows are rebalanced by plant and day first, so
    that the number of files follows the plant-days and not the tasks.
    """
    require_columns(frame, ("plant_id", time), "table")
    rows = frame if plants is None else frame.where(F.col("plant_id").cast("string").isin(*plants))
    checked = F.when(
        F.col(time).isNull(), F.raise_error(F.lit(f"a row has no valid {time}")).cast("date")
    ).otherwise(local_date(time, timezone))
    dated = rows.withColumn("date", checked)
    dated.hint("rebalance", "plant_id", "date").write.mode("errorifexists").option("header", "true").partitionBy(
        "plant_id", "date"
    ).csv(path)
    written = frame.sparkSession.read.schema(dated.schema).option("header", "true").csv(path)
    return export_manifest(written, time)


def check_same_schema(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Columns shared by all inputs in order; any drift is an error."""
    first: list[str] | None = None
    for path in paths:
        columns = spark.read.parquet(path).columns
        if first is not None and columns != first:
            raise ValueError(f"the columns of {path} are not those of the first input")
        first = columns
    return first or []


def export_manifest(dated: DataFrame, time: str) -> DataFrame:
    """Dates, rows and time range per plant."""
    return dated.groupBy("plant_id").agg(
        F.countDistinct("date").alias("dates"),
        F.count(F.lit(1)).alias("rows"),
        F.min(time).alias("minimum"),
        F.max(time).alias("maximum"),
    )


def write_report(path: str, tables: Mapping[str, DataFrame], metrics: Mapping[str, DataFrame] = {}) -> None:
    """Tables as Parquet and CSV, metrics as JSON lines, below one folder."""
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{path}/{name}.parquet")
        flat = [
            F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name)
            for f in table.schema.fields
        ]
        table.sparkSession.read.parquet(f"{path}/{name}.parquet").select(*flat).write.mode("errorifexists").option(
            "header", "true"
        ).csv(f"{path}/{name}.csv")
    for name, table in metrics.items():
        table.write.mode("errorifexists").json(f"{path}/{name}.json")


def save_model(spark: SparkSession, path: str, settings: Settings, tables: Mapping[str, DataFrame] = {}) -> None:
    """Settings as JSON text and fitted tables as Parquet."""
    spark.createDataFrame([(type(settings).__name__, settings.to_json())], "kind string, settings string").write.mode(
        "errorifexists"
    ).json(f"{path}/settings")
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{path}/{name}")


def load_settings(spark: SparkSession, path: str, kind: type[Settings]) -> Settings:
    row = spark.read.schema("kind string, settings string").json(f"{path}/settings").first()
    if row["kind"] != kind.__name__:
        raise ValueError(f"{path} holds {row['kind']}, not {kind.__name__}")
    return kind.from_json(row["settings"])


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def as_json(metrics: DataFrame) -> str:
    """A small metrics table as JSON text."""
    return json.dumps([row.asDict(recursive=True) for row in metrics.collect()], default=str, indent=2)


# --- exports that are kept up to date ----------------------------------------

MANIFEST = "dataset string, date string, rows bigint, digest string, export_no int, written boolean"


def _digests(dated: DataFrame) -> DataFrame:
    """Rows and an order-free digest of every date."""
    columns = [F.col(f"`{c}`") for c in sorted(dated.columns) if c != "date"]
    total = F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string")
    return dated.groupBy(F.col("date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("rows"), total.alias("digest"))


def manifest_log(spark: SparkSession, manifest: str) -> DataFrame:
    """Every export's entries, or none if there is no manifest yet."""
    target = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(manifest)


def export_days(
    frame: DataFrame,
    path: str,
    manifest: str,
    dataset: str,
    start: dt.date,
    end: dt.date,
    time: str,
    timezone: str = "Asia/Shanghai",
    maximum_days: int | None = MAXIMUM_EXPORT_DAYS,
) -> DataFrame:
    """Bring the date partitions of a dataset up to date; returns this export's manifest entries.

    Dates whose rows and digest are those of the last export are left as they
    are, so a repeated export writes nothing; others are replaced one by one,
    and dates that no longer have rows are removed. What was written is read
    back and has to give the same digests. The manifest is only ever added to:
    one file set may hold the exports of many datasets.
    """
    spark = frame.sparkSession
    first, last = local_date_range(start, end, maximum_days)
    chosen = frame.where((F.col(time) >= utc_bound(first, timezone)) & (F.col(time) < utc_bound(last, timezone)))
    dated = chosen.withColumn("date", local_date(time, timezone))
    log = manifest_log(spark, manifest)
    number = (log.agg(F.max("export_no")).first()[0] or 0) + 1
    known = current_manifest(log).where((F.col("dataset") == dataset) & F.col("date").between(str(start), str(end - dt.timedelta(1))))
    before = {r["date"]: (r["rows"], r["digest"]) for r in known.collect()}  # one row per date of the range
    now = {r["date"]: (r["rows"], r["digest"]) for r in _digests(dated).collect()}
    changed = sorted(d for d in now if before.get(d) != now[d])
    if changed:
        days = dated.where(F.col("date").isin(*[dt.date.fromisoformat(d) for d in changed]))
        days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
        written = spark.read.schema(dated.schema).parquet(path).where(F.col("date").isin(*[dt.date.fromisoformat(d) for d in changed]))
        found = {r["date"]: (r["rows"], r["digest"]) for r in _digests(written).collect()}
        if found != {d: now[d] for d in changed}:
            raise RuntimeError(f"the partitions of {path} do not hold what was exported")
    gone = sorted(d for d, (rows, _) in before.items() if rows and d not in now)
    for day in gone:
        remove(spark, f"{path}/date={day}")
    entries = [(dataset, d, *now[d], number, d in changed) for d in sorted(now)] + [(dataset, d, 0, "0", number, True) for d in gone]
    result = spark.createDataFrame(entries, MANIFEST)
    result.coalesce(1).write.mode("append").parquet(manifest)
    return result


def current_manifest(log: DataFrame) -> DataFrame:
    """The last entry of every dataset and date, how often it was exported and how often written."""
    last = F.max_by(F.struct("rows", "digest"), "export_no").alias("_last")
    return (
        log.groupBy("dataset", "date")
        .agg(last, F.count(F.lit(1)).alias("exports"), F.count_if("written").alias("writes"))
        .select("dataset", "date", "_last.*", "exports", "writes")
    )
