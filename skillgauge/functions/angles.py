"""Errors and means of plain and circular (degree) variables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def circular_error(forecast: Column, observed: Column) -> Column:
    """Shortest signed angle from observed to forecast, in [-180, 180)."""
    return F.pmod(forecast - observed + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def error_of(forecast: Column, observed: Column, circular: bool = False) -> Column:
    return circular_error(forecast, observed) if circular else forecast - observed


def weighted_mean(pairs: list[tuple[Column, Column]], circular: bool = False) -> Column:
    """Weighted mean of (weight, value) columns, renormalised over non-null values."""
    present = [(F.when(v.isNotNull(), w).otherwise(F.lit(0.0)), v) for w, v in pairs]
    total = sum((w for w, _ in present), F.lit(0.0))
    if circular:
        x = sum((w * F.coalesce(F.cos(F.radians(v)), F.lit(0.0)) for w, v in present), F.lit(0.0))
        y = sum((w * F.coalesce(F.sin(F.radians(v)), F.lit(0.0)) for w, v in present), F.lit(0.0))
        return F.when(total > 0, resultant_angle(x, y))
    parts = sum((w * F.coalesce(v, F.lit(0.0)) for w, v in present), F.lit(0.0))
    return F.when(total > 0, parts / total)


def weighted_mean_agg(weight: Column, value: Column, circular: bool = False, null_balanced: bool = False) -> Column:
    """Aggregate form of `weighted_mean`; rows without a value do not count.

    `null_balanced` makes opposed angles (zero resultant) null.
    """
    weight = F.when(value.isNotNull(), weight)
    if circular:
        x = F.sum(weight * F.cos(F.radians(value)))
        y = F.sum(weight * F.sin(F.radians(value)))
        angle = resultant_angle(x, y)
        if null_balanced:
            angle = F.when((F.abs(x) < 1e-12) & (F.abs(y) < 1e-12), F.lit(None)).otherwise(angle)
        return F.when(F.sum(weight) > 0, angle)
    return F.when(F.sum(weight) > 0, F.sum(weight * value) / F.sum(weight))


def resultant_angle(x: Column, y: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))
