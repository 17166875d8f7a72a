"""Largest errors, misses beyond a threshold, error quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import error_var
from .quantiles import exact_quantiles

# Percentiles of the overall and of the per-lead error tables.
ERROR_PERCENTILES = (5, 10, 25, 50, 75, 90, 95)
LEAD_PERCENTILES = (10, 25, 50, 75, 90)


def _errors(df: DataFrame, variable: str, model: str | None, lead_hours: int | None = None) -> DataFrame:
    rows = df if model is None else df.where(F.col("model") == model)
    return rows if lead_hours is None else rows.where(F.col("lead_hours") == lead_hours)


def top_errors(df, variable, n: int = 50, model=None, lead_hours=None, tiebreak=()) -> DataFrame:
    """The `n` largest absolute errors; `tiebreak` columns make equal errors ordered.

    Runs as a per-partition top-n followed by one merge of n rows each.
    """
    e = error_var(variable)
    needed = [c for c in (e, "lead_hours", "model") if c in df.columns]
    rows = _errors(df, variable, model, lead_hours).dropna(subset=needed)
    rows = rows.select(*needed, *[c for c in tiebreak if c not in needed], F.abs(e).alias("abs_error"))
    return rows.orderBy(F.desc("abs_error"), *[F.asc(c) for c in tiebreak]).limit(n)


def extreme_misses(df, variable, threshold: float, direction: str = "both", model=None) -> DataFrame:
    """Rows whose error is >= threshold (over), <= -threshold (under) or either (both)."""
    e = F.col(error_var(variable))
    rules = {"over": e >= threshold, "under": e <= -threshold, "both": F.abs(e) >= threshold}
    if direction not in rules:
        raise ValueError(f"unknown direction {direction!r}, expected one of {sorted(rules)}")
    needed = [c for c in (error_var(variable), "lead_hours", "model") if c in df.columns]
    rows = _errors(df, variable, model).dropna(subset=needed).where(rules[direction])
    return rows.select(*needed, F.abs(e).alias("abs_error"))


def error_quantiles(df, variable, percentiles=ERROR_PERCENTILES, model=None, lead_hours=None, by=()) -> DataFrame:
    return exact_quantiles(_errors(df, variable, model, lead_hours), error_var(variable), percentiles, by)


def lead_time_quantiles(df, variable, percentiles=LEAD_PERCENTILES, model=None) -> DataFrame:
    return error_quantiles(df, variable, percentiles, model, by=["lead_hours"])


def extreme_frequency(df, variable, threshold: float, model=None, by=()) -> DataFrame:
    """Count, share and mean absolute error of errors at or beyond the threshold."""
    e = F.abs(error_var(variable))
    rows = _errors(df, variable, model).where(e.isNotNull())
    total, extreme = F.count(F.lit(1)), F.count_if(e >= threshold)
    return rows.groupBy(*by).agg(
        total.alias("total"),
        extreme.alias("extreme_count"),
        F.coalesce(F.try_divide(extreme.cast("double"), total.cast("double")), F.lit(0.0)).alias("frequency"),
        F.avg(F.when(e >= threshold, e)).alias("mean_error_when_extreme"),
    )


def first_leads(df: DataFrame, n: int = 5) -> DataFrame:
    """The `n` shortest distinct lead times."""
    return df.select("lead_hours").where(F.col("lead_hours").isNotNull()).distinct().orderBy("lead_hours").limit(n)


def analysis_quantiles(long_errors: DataFrame, percentiles=ERROR_PERCENTILES) -> DataFrame:
    """Error quantiles of every variable of a long error table in one job."""
    return exact_quantiles(long_errors, "error", percentiles, ["variable"])
