"""Expressions on arrays that hold one device-time's strings.

Such an array never outgrows the number of channels of an inverter (at most 99
by the two-digit column names), so everything here is row-local and bounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression.

    Catalyst inlines projected columns into lambdas, where they would be
    evaluated per element; binding through a one-element array prevents that.
    """
    return F.get(F.transform(F.array(value), body), 0)


def median_of_sorted(values: Column) -> Column:
    """Median of an ascending array without nulls; null if empty."""
    size = F.size(values)
    low = F.get(values, ((size - 1) / 2).cast("int"))
    high = F.get(values, (size / 2).cast("int"))
    return F.when(size > 0, (low + high) / 2)


def median(values: Column) -> Column:
    """Median of an array of doubles, nulls ignored."""
    return let(
        F.array_sort(F.filter(values, lambda v: v.isNotNull())),
        median_of_sorted,
    )


def finite_count(values: Column) -> Column:
    return F.size(F.filter(values, lambda v: v.isNotNull()))


def number_list(numbers: Column) -> Column:
    """``"03,07"`` from string numbers: distinct, ascending, two digits."""
    return F.array_join(
        F.transform(F.array_sort(F.array_distinct(numbers)), lambda n: F.lpad(n.cast("string"), 2, "0")),
        ",",
    )


def parse_number_list(text: Column) -> Column:
    """String numbers from ``"3, 10,11"``; an empty text gives an empty array."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.coalesce(
        F.transform(parts, lambda p: p.try_cast("double").cast("int")),
        F.array().cast("array<int>"),
    )
