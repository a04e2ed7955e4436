"""Column contracts of the wide device table and the checks on them."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CURRENT_COLUMN = re.compile(r"^string_current_(\d{2})$")
DEVICE_KEYS = ("plant_id", "device_no")
POINT_KEYS = ("plant_id", "device_no", "event_time")
STRING_KEYS = ("plant_id", "device_no", "string_no")
# where plants are mapped to model plants: the plant a row comes from
SOURCE_PLANT = "source_plant_id"
# fixed values: the metadata columns of a device table
META_COLUMNS = (
    "event_time",
    "plant_id",
    "device_no",
    "active_power",
    "rated_power",
    "status_code",
    "main_string_count",
    "valid_current_string_count",
    "string_overall_status",
)


def require_columns(frame: DataFrame, columns: Iterable[str], what: str) -> None:
    """Fail at plan time when a column is absent."""
    missing = sorted(set(columns) - set(frame.columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")


def channel_numbers(frame: DataFrame) -> list[int]:
    """Numbers of the string channels, found by column name."""
    numbers = sorted(int(m.group(1)) for m in map(CURRENT_COLUMN.match, frame.columns) if m)
    if not numbers:
        raise ValueError("no string_current_NN columns were found")
    return numbers


def number_text(column: str) -> str:
    """SQL for a double value, with anything unparsable, NaN or infinite as null."""
    value = f"try_cast(`{column}` as double)"
    return f"case when not isnan({value}) and abs({value}) <> double('inf') then {value} end"


def number(column: Column | str) -> Column:
    """The same as a column, of a named column or of an expression."""
    if isinstance(column, str):
        return F.expr(number_text(column))
    return F.when(~F.isnan(column) & (F.abs(column) != F.lit(float("inf"))), column)


def key_text(column: str) -> Column:
    """Keys are trimmed text everywhere."""
    return F.trim(F.col(column).cast("string"))


def normalise_keys(frame: DataFrame) -> DataFrame:
    """Plant and device as trimmed text, time as a timestamp."""
    require_columns(frame, POINT_KEYS, "frame")
    return frame.withColumns(
        {
            "plant_id": key_text("plant_id"),
            "device_no": key_text("device_no"),
            "event_time": F.col("event_time").cast("timestamp"),
        }
    )
