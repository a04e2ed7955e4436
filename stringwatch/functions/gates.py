"""Physical effect of a drop and the gates on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_drop(residual: Column, reference: Column) -> Column:
    """1 - r / median(r)."""
    return F.when(reference > 0, 1 - residual / reference)


def absolute_drop(expected: Column, current: Column) -> Column:
    """Missing current in ampere."""
    return expected - current


def effect_gate(mode: str, relative: Column, absolute: Column, minimum_relative: float, minimum_absolute: float) -> Column:
    """Is the drop physically large enough?

    ``and`` wants both minima (a zero minimum is off), ``or`` wants one of them.
    """
    tests = []
    if minimum_relative > 0:
        tests.append(F.coalesce(relative >= minimum_relative, F.lit(False)))
    if minimum_absolute > 0:
        tests.append(F.coalesce(absolute >= minimum_absolute, F.lit(False)))
    if not tests:
        return F.lit(True)
    result = tests[0]
    for test in tests[1:]:
        result = (result | test) if mode == "or" else (result & test)
    return result
