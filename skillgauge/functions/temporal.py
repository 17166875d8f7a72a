"""Lead times, calendar dimensions and month chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import MONTH, SEASON, SEASON_MONTHS, TARGET


def hours_between(start, end) -> Column:
    """Fractional hours from `start` to `end`."""
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3.6e9)


def lead_hours(issue, target) -> Column:
    """Whole lead hours, truncated toward zero."""
    return hours_between(issue, target).cast("int")


def season_of_month(month: Column) -> Column:
    out = F.lit("UNKNOWN")
    for name, months in SEASON_MONTHS.items():
        out = F.when(month.isin(*months), F.lit(name)).otherwise(out)
    return out


def season_of(timestamp) -> Column:
    timestamp = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    return season_of_month(F.month(timestamp))


def with_calendar(df: DataFrame, dims=(MONTH, SEASON)) -> DataFrame:
    """Add month / season of the target time where the table lacks them."""
    new = {}
    if MONTH in dims and MONTH not in df.columns:
        new[MONTH] = F.month(TARGET)
    if SEASON in dims and SEASON not in df.columns:
        new[SEASON] = season_of(TARGET)
    return df.withColumns(new) if new else df


def month_chunks(start, end, months: int = 1) -> Column:
    """Array of (chunk_start, chunk_end) dates covering [start, end] by calendar month."""
    if months < 1:
        raise ValueError("months must be >= 1")
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    firsts = F.sequence(F.trunc(start, "MM"), end, F.make_interval(months=F.lit(months)))
    return F.transform(
        firsts,
        lambda first: F.struct(
            F.greatest(first, start).alias("chunk_start"),
            F.least(F.date_sub(F.add_months(first, months), 1), end).alias("chunk_end"),
        ),
    )
