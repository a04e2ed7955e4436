"""Reading date-partitioned device, weather and point tables."""

from __future__ import annotations

import io
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stringwatch.functions.timegrid import utc_bound
from stringwatch.schema import META_COLUMNS, POINT_KEYS, SOURCE_PLANT, key_text, normalise_keys, require_columns
from stringwatch.storage import stage


def check_bounds(spark: SparkSession, start: str, end: str, timezone: str) -> None:
    """The end must be later than the start."""
    later = spark.range(1).select(utc_bound(end, timezone) > utc_bound(start, timezone)).first()[0]
    if not later:
        raise ValueError("end must be later than start")


def read_partitioned(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Sequence[str] | None = None,
    tolerate_corrupt: bool = False,
    schema: StructType | str | None = None,
    merge_schemas: bool = False,
) -> DataFrame:
    """Parquet under one or several roots with their partition columns.

    An explicit ``schema`` spares the look into footers; ``merge_schemas`` looks
    into all of them. ``tolerate_corrupt`` skips what cannot be read; ask
    :func:`file_status` what that is.
    """
    roots = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.option("mergeSchema", str(merge_schemas).lower()).option("recursiveFileLookup", "false")
    if schema is not None:
        reader = reader.schema(schema)
    if tolerate_corrupt:
        reader = reader.option("ignoreCorruptFiles", "true")
    frame = reader.parquet(*roots)
    if columns is not None:
        frame = frame.select(*[c for c in columns if c in frame.columns])
    return frame


def within(frame: DataFrame, start: str, end: str, timezone: str = "Asia/Shanghai", time: str = "event_time") -> DataFrame:
    """Half-open local time range.

    A ``date`` partition column is pruned too, one day wider than needed at
    either end, so an end with a time of day keeps its own day.
    """
    result = frame.where(
        (F.col(time) >= utc_bound(start, timezone)) & (F.col(time) < utc_bound(end, timezone))
    )
    if "date" in frame.columns:
        first, last = (F.to_date(F.lit(text[:10])) for text in (start, end))
        result = result.where(
            F.col("date").isNull()
            | F.to_date("date").between(F.date_sub(first, 1), F.date_add(last, 1))
        )
    return result


def keep_last(frame: DataFrame, keys: Sequence[str] = POINT_KEYS) -> DataFrame:
    """Remove repeated keys, keeping the last row in file and row order.

    ``frame`` must carry ``_file`` and ``_position`` from :func:`with_position`.
    """
    rest = [c for c in frame.columns if c not in keys and c not in ("_file", "_position")]
    return (
        frame.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct("_file", "_position")).alias("_row"))
        .select(*keys, "_row.*")
    )


def with_position(frame: DataFrame) -> DataFrame:
    """File and row position of a freshly read table."""
    return frame.withColumns({"_file": F.col("_metadata.file_path"), "_position": F.col("_metadata.row_index")})


def device_columns(names: Sequence[str]) -> list[str]:
    """Columns the detectors use: metadata, currents and statuses."""
    wanted = [c for c in META_COLUMNS if c in names]
    return wanted + [c for c in names if c.startswith(("string_current_", "string_status_"))]


def read_devices(
    spark: SparkSession,
    paths: str | Sequence[str],
    start: str,
    end: str,
    timezone: str = "Asia/Shanghai",
    tolerate_corrupt: bool = False,
    schema: StructType | str | None = None,
    merge_schemas: bool = False,
) -> DataFrame:
    """Wide device rows in a local time range, unique per device and time.

    A file that cannot be read fails the job unless ``tolerate_corrupt`` is set.
    """
    check_bounds(spark, start, end, timezone)
    frame = within(read_partitioned(spark, paths, None, tolerate_corrupt, schema, merge_schemas), start, end, timezone)
    columns = device_columns(frame.columns)
    positioned = with_position(frame).select(*columns, "_file", "_position")
    return keep_last(normalise_keys(positioned))


def read_report(
    spark: SparkSession, root: str, start: str, end: str, timezone: str = "Asia/Shanghai", examples: int = 5
) -> DataFrame:
    """One row: files selected, read and failed, rows read and in range, repeated rows, devices, examples of errors."""
    files = file_status(spark, root).agg(
        F.count(F.lit(1)).alias("files_selected"),
        F.count_if(F.col("status") != "damaged").alias("files_read"),
        F.count_if(F.col("status") == "damaged").alias("files_failed"),
        F.coalesce(F.sum("read_rows"), F.lit(0)).alias("rows_read"),
        F.slice(
            F.sort_array(F.collect_set(F.when(F.col("status") == "damaged", F.element_at(F.split("path", "/"), -1)))), 1, examples
        ).alias("error_examples"),
    )
    frame = within(read_partitioned(spark, root, None, True, None, True), start, end, timezone)
    totals = normalise_keys(frame.select(*POINT_KEYS)).groupBy(*POINT_KEYS).agg(F.count(F.lit(1)).alias("_copies")).agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows_in_range"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows_removed"),
        F.countDistinct("plant_id", "device_no").alias("devices"),
    )
    return files.join(totals)  # two single rows


def read_with_report(
    spark: SparkSession, root: str, start: str, end: str, timezone: str = "Asia/Shanghai", schema: StructType | str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Device rows as by :func:`read_devices`, and their report, from one read of the files.

    The rows are written once; while they pass, the read counts files with rows,
    rows, rows in range and unique rows. The report has one row: files_selected,
    files_with_rows, rows_read, rows_in_range, duplicate_rows_removed, devices.
    Only names are listed besides, and keys of the written rows counted. A file
    that cannot be read fails the job; :func:`file_status` finds it.
    """
    check_bounds(spark, start, end, timezone)
    read, unique = Observation("read"), Observation("unique")
    inside = (F.col("event_time") >= utc_bound(start, timezone)) & (F.col("event_time") < utc_bound(end, timezone))
    positioned = with_position(read_partitioned(spark, root, None, False, schema, schema is None))
    seen = positioned.observe(
        read,
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(F.col("_position") == 0).alias("files_with_rows"),
        F.count_if(inside).alias("rows_in_range"),
    )
    columns = device_columns(seen.columns)
    kept = keep_last(normalise_keys(within(seen, start, end, timezone).select(*columns, "_file", "_position")))
    rows = stage(kept.observe(unique, F.count(F.lit(1)).alias("rows")), "device-rows")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    numbers = read.get | {"unique": unique.get["rows"]}
    report = listed.agg(F.count(F.lit(1)).alias("files_selected")).select(
        "files_selected",
        *[F.lit(numbers[n]).cast("long").alias(n) for n in ("files_with_rows", "rows_read", "rows_in_range")],
        F.lit(numbers["rows_in_range"] - numbers["unique"]).cast("long").alias("duplicate_rows_removed"),
    )
    return rows, report.join(rows.agg(F.countDistinct("plant_id", "device_no").alias("devices")))  # two single rows


def file_status(spark: SparkSession, root: str, schema: StructType | str | None = None) -> DataFrame:
    """Every Parquet file below ``root``: path, length, footer_rows, read_rows and status.

    All data columns are read and the rows counted against the footer's number:
    a file is ``damaged`` if it has no usable footer or yields fewer rows than
    that says, ``empty`` if it is sound and has none, ``intact`` otherwise.
    Without a ``schema`` those of all sound files are merged.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(root)
    )
    read = read_partitioned(spark, root, None, True, schema, schema is None)
    path = F.col("_metadata.file_path").alias("_read_path")
    # a count alone comes from the footers, a hash needs every page
    by_footer = read.select(path).groupBy("_read_path").agg(F.count(F.lit(1)).alias("footer_rows"))
    by_pages = (
        read.select(path, F.xxhash64(*[F.col(f"`{c}`") for c in read.columns]).alias("_hash"))
        .groupBy("_read_path")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_hash").alias("_hash"))
        # the hash must be wanted, or no page would be read
        .select("_read_path", F.when(F.col("_hash").isNotNull(), F.col("_n")).alias("read_rows"))
    )
    counted = listed.select("path", "length").join(by_footer, F.col("path") == F.col("_read_path"), "left").drop("_read_path")
    counted = counted.join(by_pages, F.col("path") == F.col("_read_path"), "left").drop("_read_path")

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_silent": batch["path"], "_sound": [_sound(c) for c in batch["content"]]})

    # files that gave no row at all, empty ones and those without a footer; only their names reach the driver
    silent = [row["path"] for row in counted.where("footer_rows is null").select("path").collect()]
    judged = spark.createDataFrame([], "_silent string, _sound boolean")
    if silent:
        judged = spark.read.format("binaryFile").load(silent).select("path", "content").mapInPandas(footers, judged.schema)
    status = (
        F.when(F.col("footer_rows").isNull(), F.when(F.col("_sound"), "empty").otherwise("damaged"))
        .when(F.coalesce("read_rows", F.lit(0)) < F.col("footer_rows"), "damaged")
        .otherwise("intact")
    )
    return counted.join(judged, F.col("path") == F.col("_silent"), "left").select(
        "path", "length", F.coalesce("footer_rows", F.lit(0)).alias("footer_rows"), F.coalesce("read_rows", F.lit(0)).alias("read_rows"),
        status.alias("status"),
    )


def _sound(content: bytes) -> bool:
    """Whether a file has a readable footer."""
    try:
        pq.ParquetFile(io.BytesIO(content))
    except (pa.ArrowException, OSError):
        return False
    return True


def failed_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` that a tolerant read does not give whole."""
    return file_status(spark, root).where("status = 'damaged'").select("path", "length")


def plant_rows(frame: DataFrame, plant_id: str, dates: Sequence[str] = ()) -> DataFrame:
    """Rows of one plant, and of some local dates, by partition columns."""
    result = frame.where(key_text("plant_id") == plant_id)
    return result.where(F.to_date("date").isin(*[F.to_date(F.lit(d)) for d in dates])) if dates else result


def device_set(frame: DataFrame) -> DataFrame:
    """Distinct devices of every plant."""
    return frame.select(key_text("plant_id").alias("plant_id"), key_text("device_no").alias("device_no")).distinct()


def read_weather(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Weather of several roots; a repeated slot keeps its last row."""
    frame = with_position(read_partitioned(spark, list(roots)))
    columns = [c for c in ("time", "plant_id", "forecast_ghi", "sensor_ghi") if c in frame.columns]
    keyed = frame.select(*columns, "_file", "_position").withColumn("plant_id", key_text("plant_id"))
    return keep_last(keyed, ("plant_id", "time"))


def read_points(
    spark: SparkSession, path: str, manifest: DataFrame | None = None, stations: DataFrame | None = None
) -> DataFrame:
    """Scored points, with station names where a manifest is given.

    Device numbers repeat between plants: with ``stations`` (station_name,
    plant_id) a point gets the station of its own plant; without, a device that
    the manifest lists under several stations fails the job.
    """
    points = normalise_keys(read_partitioned(spark, path))
    if manifest is None:
        return points
    return with_stations(points, manifest, stations)


def with_stations(points: DataFrame, manifest: DataFrame, stations: DataFrame | None = None) -> DataFrame:
    """Points of listed devices with their station, see :func:`read_points`."""
    listed = manifest.select(F.trim("station_name").alias("station_name"), key_text("device_no").alias("device_no")).distinct()
    if stations is not None:
        plants = stations.select(F.trim("station_name").alias("station_name"), key_text("plant_id").alias("plant_id")).distinct()
        return points.join(listed.join(plants, "station_name"), ["plant_id", "device_no"])
    several = F.raise_error(F.concat(F.lit("several stations list device "), "device_no")).cast("string")
    single = listed.groupBy("device_no").agg(F.count(F.lit(1)).alias("_n"), F.min("station_name").alias("station_name"))
    return points.join(
        single.select("device_no", F.when(F.col("_n") > 1, several).otherwise(F.col("station_name")).alias("station_name")), "device_no"
    )


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """JSON, JSON lines or CSV by extension."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return spark.read.option("header", "true").csv(path)
    if suffix == "json":
        return spark.read.option("multiLine", "true").json(path)
    if suffix in ("jsonl", "ndjson"):
        return spark.read.json(path)
    raise ValueError(f"unsupported input: {path}")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Station and device list from JSON: {station: [devices]} or a list of rows."""
    frame = spark.read.option("multiLine", "true").json(path)
    if {"station_name", "device_no"} <= set(frame.columns):
        return frame.select("station_name", "device_no").distinct()
    parts = [
        frame.select(F.lit(c).alias("station_name"), F.explode(F.col(f"`{c}`")).alias("device_no"))
        for c in frame.columns
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.distinct()


def read_station_plants(spark: SparkSession, path: str) -> DataFrame:
    """Station to plant mapping from a JSON object."""
    frame = spark.read.option("multiLine", "true").json(path)
    prefix = ""
    if "station_to_plant_id" in frame.columns:
        prefix, frame = "station_to_plant_id.", frame.select("station_to_plant_id")
    names = frame.select(f"{prefix}*").columns if prefix else frame.columns
    pairs = [
        F.struct(F.lit(n.strip()).alias("station_name"), F.col(f"{prefix}`{n}`").cast("string").alias("plant_id"))
        for n in names
    ]
    if not pairs:
        raise ValueError("station mapping must be a non-empty object")
    return frame.select(F.inline(F.array(*pairs)))


def sample(frame: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """A bounded sample: the first rows by ``order``."""
    if not 1 <= size <= 1000:
        raise ValueError("size must be between 1 and 1000")
    return frame.orderBy(*order).limit(size)


# --- plant-id mapping ------------------------------------------------------


def parse_plant_mapping(items: Sequence[str]) -> dict[str, str]:
    """``A=B`` or ``A:B`` pairs; two targets for one plant are an error."""
    result: dict[str, str] = {}
    for item in items:
        source, separator, target = item.replace(":", "=", 1).partition("=")
        source, target = source.strip(), target.strip()
        if not separator or not source or not target:
            raise ValueError(f"Invalid mapping: {item}")
        if result.setdefault(source, target) != target:
            raise ValueError(f"Conflicting mappings for plant {source}")
    return result


def apply_plant_mapping(frame: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rewrite plants to their model plant and keep the source id."""
    plant = key_text("plant_id")
    if not mapping:
        return frame.withColumn("source_plant_id", plant).withColumn("plant_id", plant)
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return frame.withColumn("source_plant_id", plant).withColumn(
        "plant_id", F.coalesce(F.try_element_at(pairs, F.col("source_plant_id")), F.col("source_plant_id"))
    )


def plant_mapping_report(mapped: DataFrame) -> DataFrame:
    """Rows per source and model plant."""
    return mapped.groupBy("source_plant_id", "plant_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max((F.col("source_plant_id") != F.col("plant_id")).cast("int")).alias("mapped"),
    )


def restore_plants(scored: DataFrame) -> DataFrame:
    """Put source plants back on scored rows or events, keeping the model plant.

    The source plant is carried through scoring as part of the keys, since two
    plants that share a model plant may own devices of the same number.
    """
    require_columns(scored, ("plant_id", SOURCE_PLANT), "scored table")
    return scored.withColumn("model_plant_id", F.col("plant_id")).withColumn(
        "plant_id", F.coalesce(SOURCE_PLANT, "plant_id")
    )
