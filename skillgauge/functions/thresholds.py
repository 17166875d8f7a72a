"""Threshold comparisons that are never null: missing or infinite means False."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Comparison operators by name.
OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "le": lambda v, t: v <= t,
    "lt": lambda v, t: v < t,
    "ge": lambda v, t: v >= t,
    "gt": lambda v, t: v > t,
    "eq": lambda v, t: v == t,
    "ne": lambda v, t: v != t,
}


def finite(value: Column) -> Column:
    value = value.cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def meets(value: Column, threshold: float, operator: str) -> Column:
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator!r}, expected one of {sorted(OPERATORS)}")
    return finite(value) & F.coalesce(OPERATORS[operator](value, F.lit(float(threshold))), F.lit(False))
