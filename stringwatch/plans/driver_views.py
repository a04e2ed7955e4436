"""Device, weather, alarm and residual views derived from the given tables.

No plant telemetry ships with the test data, so the detectors run on views over
the TPC-H-like tables. A supplier plays a device, ten suppliers a plant, a part
key modulo twelve a string; ship dates become slots of a five-minute grid, 13
slots per day. All arithmetic is on whole numbers, so that results do not depend
on the order in which a cluster adds them up. Work grows with the tables: the
number of devices is the number of suppliers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stringwatch.session import shuffle_finely

STRINGS = 12
SLOT_DAYS = 64
SLOTS_PER_DAY = 13
# fixed values: 2026-06-01 00:00 UTC, and 1995-01-01 as day number since 1970
EPOCH = 1_780_272_000
FIRST_DAY = 9_131


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    shuffle_finely(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_number(column: str) -> Column:
    return F.unix_date(F.to_date(column)) - FIRST_DAY


def slot_epoch(slot: Column) -> Column:
    """Epoch seconds of a slot: 13 five-minute slots per day."""
    return (
        F.lit(EPOCH)
        + F.floor(slot / SLOTS_PER_DAY).cast("long") * 86_400
        + F.pmod(slot, F.lit(SLOTS_PER_DAY)).cast("long") * 300
    )


def epoch(column: str, name: str) -> Column:
    """Times leave a query as whole seconds."""
    return F.unix_seconds(F.col(column)).alias(name)


def device_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide device rows in one aggregation straight from the scan."""
    source = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey as supplier",
        f"cast(floor((unix_date(to_date(l_shipdate)) - {FIRST_DAY}) / {SLOT_DAYS}) as int) as slot",
        f"cast(l_partkey % {STRINGS} + 1 as int) as s",
        "cast(l_quantity - 1 as bigint) as q",
        "cast(round(l_discount * 100) as bigint) as d",
        "l_returnflag = 'R' as returned",
    )
    strings = range(1, STRINGS + 1)
    aggregates = ["count(1) as n", "sum(d) as d"]
    for s in strings:
        aggregates += [
            f"sum(case when s = {s} then q end) as q{s}",
            f"count_if(s = {s}) as n{s}",
            f"count_if(s = {s} and returned) as r{s}",
        ]
    grouped = source.groupBy("supplier", "slot").agg(*[F.expr(text) for text in aggregates])
    return grouped.selectExpr(
        f"timestamp_seconds({EPOCH} + slot div {SLOTS_PER_DAY} * 86400 + slot % {SLOTS_PER_DAY} * 300) as event_time",
        "cast(supplier div 10 as string) as plant_id",
        "cast(supplier as string) as device_no",
        "d * 10.0D / n as active_power",
        "100.0D as rated_power",
        "case when n % 11 = 0 then 5 else 1 end as status_code",
        f"{STRINGS} as main_string_count",
        " + ".join(f"int(n{s} > 0)" for s in strings) + " as valid_current_string_count",
        *[f"try_divide(double(q{s}), n{s}) as string_current_{s:02d}" for s in strings],
        *[
            f"case when n{s} = 0 then null when q{s} = 0 then 4 when r{s} > 0 then 2 else 1 end as string_status_{s:02d}"
            for s in strings
        ],
    )


# The same view for the checking engine; ``epoch`` is the slot's time.
SQL_VIEWS = f"""
li as (
  select l_suppkey // 10 as plant, l_suppkey as dev,
         cast(floor((date_diff('day', date '1995-01-01', cast(l_shipdate as date))) / {SLOT_DAYS}.0) as bigint) as slot,
         l_partkey % {STRINGS} + 1 as s, cast(l_quantity - 1 as bigint) as q,
         cast(round(l_discount * 100) as bigint) as d, cast(round(l_tax * 100) as bigint) as x,
         l_returnflag = 'R' as returned
  from lineitem),
meta as (
  select plant, dev, slot,
         {EPOCH} + (slot // {SLOTS_PER_DAY}) * 86400 + (slot % {SLOTS_PER_DAY}) * 300 as epoch,
         count(*) as n, sum(d) * 10.0 / count(*) as active_power,
         case when count(*) % 11 = 0 then 5 else 1 end as status_code,
         count(distinct s) as valid_strings
  from li group by plant, dev, slot),
pts as (
  select plant, dev, slot, s, sum(q) * 1.0 / count(*) as c,
         case when sum(q) = 0 then 4 when bool_or(returned) then 2 else 1 end as st,
         {EPOCH} + (slot // {SLOTS_PER_DAY}) * 86400 + (slot % {SLOTS_PER_DAY}) * 300 as epoch
  from li group by plant, dev, slot, s)
"""

# --- other views -----------------------------------------------------------

DAY_OF_SLOT = f"({EPOCH} + (slot // {SLOTS_PER_DAY}) * 86400 + (slot % {SLOTS_PER_DAY}) * 300)"


def weather_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast and, with holes, measured irradiance per plant and 15 minutes."""
    source = table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_suppkey") / 10).alias("plant"),
        F.floor(day_number("l_shipdate") / SLOT_DAYS).cast("int").alias("slot"),
        F.round(F.col("l_discount") * 100).cast("long").alias("d"),
        F.round(F.col("l_tax") * 100).cast("long").alias("x"),
    )
    at = slot_epoch(F.col("slot"))
    grouped = source.groupBy("plant", (at - F.pmod(at, F.lit(900))).alias("at")).agg(
        F.sum("d").alias("d"), F.sum("x").alias("x"), F.count(F.lit(1)).alias("n")
    )
    return grouped.select(
        F.timestamp_seconds("at").alias("time"),
        F.col("plant").cast("string").alias("plant_id"),
        (F.col("d") * 100.0 / F.col("n")).alias("forecast_ghi"),
        F.when(F.col("x") % 3 != 0, F.col("x") * 100.0 / F.col("n")).alias("sensor_ghi"),
    )


SQL_WEATHER = f"""
wx as (
  select plant, {DAY_OF_SLOT} // 900 * 900 as wt, sum(d) * 100.0 / count(*) as forecast_ghi,
         case when sum(x) % 3 <> 0 then sum(x) * 100.0 / count(*) end as sensor_ghi
  from li group by plant, {DAY_OF_SLOT} // 900 * 900)
"""


def raw_alarm_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an alarm file: everything text, some rows malformed."""
    key = F.col("o_orderkey")
    start = slot_epoch(F.floor(day_number("o_orderdate") / SLOT_DAYS)) + key % 5 * 60
    # more devices than suppliers report; most alarms are short, so that history without alarms is left
    device = F.floor(F.col("o_custkey") / 13)
    length = F.when(key % 89 == 0, F.lit(-60)).when(key % 16 == 7, key % 40 * 60).otherwise(key % 4 * 60)
    return table(spark, sf_dir, "orders").select(
        key.cast("string").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "101001")
        .when(F.col("o_orderstatus") == "O", "101002")
        .otherwise("999")
        .alias("alarm_code"),
        F.when(key % 4 == 0, "")
        .when(key % 4 == 1, F.concat((key % 12 + 1).cast("string"), F.lit(", "), (key % 7 + 1).cast("string")))
        .otherwise((key % 12 + 1).cast("string"))
        .alias("alarm_string"),
        F.concat(F.lit(" "), device.cast("string"), F.lit(" ")).alias("device_no"),
        F.concat(F.lit("station-"), F.floor(device / 10).cast("string")).alias("station_name"),
        F.when(key % 97 == 0, "bad").otherwise((start * 1000).cast("string")).alias("raise_time"),
        ((start + length) * 1000).cast("string").alias("end_time"),
    )


def station_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations of the suppliers' plants; alarms also name stations of plants that no supplier has."""
    plant = F.floor(F.col("s_suppkey") / 10)
    return (
        table(spark, sf_dir, "supplier")
        .select(plant.alias("plant"))
        .distinct()
        .select(
            F.concat(F.lit("station-"), F.col("plant").cast("string")).alias("station_name"),
            F.col("plant").cast("string").alias("plant_id"),
        )
    )


SQL_ALARMS = f"""
od as (
  select *, cast(floor(date_diff('day', date '1995-01-01', cast(o_orderdate as date)) / {SLOT_DAYS}.0) as bigint) as slot,
         o_custkey // 13 as dev from orders),
al as (
  select o_orderkey as id, dev, dev // 10 as st_plant,
         case o_orderstatus when 'F' then '101001' when 'O' then '101002' else '999' end as code,
         case when o_orderkey % 4 = 0 then []
              when o_orderkey % 4 = 1 then [o_orderkey % 12 + 1, o_orderkey % 7 + 1]
              else [o_orderkey % 12 + 1] end as strings,
         {DAY_OF_SLOT} + o_orderkey % 5 * 60 as rt,
         {DAY_OF_SLOT} + o_orderkey % 5 * 60 + case when o_orderkey % 16 = 7 then o_orderkey % 40 else o_orderkey % 4 end * 60 as et
  from od where o_orderkey % 97 <> 0 and o_orderkey % 89 <> 0),
alc as (
  select *, case when st_plant in (select distinct s_suppkey // 10 from supplier) then st_plant end as plant
  from al where code in ('101001', '101002'))
"""

RATED = 100.0


def residual_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean event value per user against the day before as forecast."""
    daily = (
        table(spark, sf_dir, "events")
        .select(
            F.col("user_id").alias("user"),
            F.unix_date(F.to_date("ts")).alias("day"),
            F.round(F.col("value") * 100).cast("long").alias("cents"),
        )
        .groupBy("user", "day")
        .agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("n"))
        .withColumn("actual", F.col("cents") / 100.0 / F.col("n"))
    )
    previous = F.lag("actual").over(Window.partitionBy("user").orderBy("day"))
    return daily.select(
        F.timestamp_seconds(F.col("day").cast("long") * 86_400).alias("target_time"),
        F.floor(F.col("user") / 15).cast("string").alias("plant_id"),
        F.col("user").cast("string").alias("device_no"),
        F.lit(RATED).alias("rated_power"),
        F.col("actual").alias("actual_power"),
        F.coalesce(previous, F.lit(20.0)).alias("predicted_power"),
        (F.col("actual") / RATED).alias("actual_power_ratio"),
    )


SQL_RESIDUALS = """
dl as (
  select user_id // 15 as plant, user_id as dev, date_diff('day', date '1970-01-01', cast(ts as date)) as day,
         sum(cast(round(value * 100) as bigint)) / 100.0 / count(*) as actual
  from events group by all),
rs as (
  select *, coalesce(lag(actual) over (partition by plant, dev order by day), 20.0) as predicted, actual / 100.0 as ratio from dl),
res as (
  select *, (predicted - actual) / 100.0 as u, ratio between 0.1 and 1.1 as ok from rs)
"""
