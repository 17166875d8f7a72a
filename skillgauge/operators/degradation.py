"""How skill decays with lead time, over the long metric table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("variable", "metric_name", "model")


def _slope(y: Column, x: Column) -> Column:
    """Least-squares slope, null below three complete points."""
    n = F.count_if(y.isNotNull() & x.isNotNull())
    return F.when(n >= 3, F.regr_slope(y, x))


def degradation_rate(metrics: DataFrame, by=SERIES, lead_range: tuple[int, int] | None = None) -> DataFrame:
    """Slope of the metric per lead hour for every series."""
    rows = metrics if lead_range is None else metrics.where(F.col("lead_hours").between(*lead_range))
    y, x = F.col("metric_value"), F.col("lead_hours").cast("double")
    return rows.groupBy(*by).agg(
        _slope(y, x).alias("degradation_rate"), F.count_if(y.isNotNull() & x.isNotNull()).alias("n_points")
    )


def seasonal_degradation(metrics: DataFrame, by=("variable",)) -> DataFrame:
    """Slope of MAE vs lead per season."""
    return degradation_rate(metrics.where(F.col("metric_name") == "mae"), [*by, "season"])


def half_skill_lead(metrics: DataFrame, by=SERIES) -> DataFrame:
    """Smallest lead at which the error is at least twice the series' smallest error.

    Null when the smallest error is not positive, the level is never reached or
    the series has fewer than two rows.
    """
    floor = metrics.groupBy(*by).agg(F.min("metric_value").alias("min_error"), F.count(F.lit(1)).alias("_n"))
    reached = (F.col("min_error") > 0) & (F.col("_n") >= 2) & (F.col("metric_value") >= 2 * F.col("min_error"))
    return (
        metrics.join(floor, list(by))
        .groupBy(*by, "min_error")
        .agg(F.min(F.when(reached, F.col("lead_hours"))).alias("half_skill_lead_hours"))
    )


def skill_against(metrics: DataFrame, reference: str, lead_hours: int | None = None) -> DataFrame:
    """1 - mean error / mean error of the reference model, for every other model."""
    rows = metrics if lead_hours is None else metrics.where(F.col("lead_hours") == lead_hours)
    means = rows.groupBy("variable", "metric_name", "model").agg(F.avg("metric_value").alias("mean_error"))
    base = means.where(F.col("model") == reference).select(
        "variable", "metric_name", F.col("mean_error").alias("reference_error")
    )
    joined = means.where(F.col("model") != reference).join(base, ["variable", "metric_name"])
    ratio = F.try_divide(F.col("mean_error"), F.col("reference_error"))
    return joined.select("variable", "metric_name", "model", (F.lit(1.0) - ratio).alias("skill_score"))


def lead_series(metrics: DataFrame, variables=None, names=None, models=None) -> DataFrame:
    """Chart series: one value per variable, metric, model and lead, with its change per hour."""
    for column, wanted in (("variable", variables), ("metric_name", names), ("model", models)):
        if wanted is not None:
            metrics = metrics.where(F.col(column).isin(*wanted))
    return metrics.select("variable", "metric_name", "model", "lead_hours", "metric_value", "sample_size")


def degradation_profile(metrics: DataFrame, by=SERIES) -> DataFrame:
    """Per series: whether the error never falls, and the leads where it does.

    A series has one row per lead, so its window is bounded by the lead count.
    """
    order = Window.partitionBy(*by).orderBy("lead_hours")
    previous = F.lag("metric_value").over(order)
    points = metrics.where(F.col("metric_value").isNotNull()).withColumn("_falls", F.col("metric_value") < previous)
    drops = F.sort_array(F.collect_list(F.when(F.col("_falls"), F.col("lead_hours"))))
    return points.groupBy(*by).agg(
        (F.count_if(F.col("_falls")) == 0).alias("is_monotonic"),
        drops.alias("instability_points"),
        F.count(F.lit(1)).alias("n_points"),
    )


def degradation_points(metrics: DataFrame, by=SERIES) -> DataFrame:
    """Every point with the monotonic-with-previous flag (false for the first)."""
    order = Window.partitionBy(*by).orderBy("lead_hours")
    rises = F.coalesce(F.col("metric_value") >= F.lag("metric_value").over(order), F.lit(False))
    return metrics.select(*by, "lead_hours", "metric_value", rises.alias("is_monotonic_with_prev"))
