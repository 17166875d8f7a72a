"""Groups and rows that stand out in the long metric table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import quantile_columns

KEYS = ("variable", "metric_name")


def high_error_groups(metrics: DataFrame, groupby=("lead_hours",), n_sigma: float = 2.0) -> DataFrame:
    """Groups whose mean metric is more than `n_sigma` from the overall mean.

    Overall mean and sample std are over rows, per variable and metric; nothing
    is reported where the std is zero or undefined.
    """
    rows = metrics
    for g in groupby:
        rows = rows.where(F.col(g).isNotNull())
    overall = metrics.groupBy(*KEYS).agg(F.avg("metric_value").alias("_mean"), F.stddev_samp("metric_value").alias("_std"))
    groups = rows.groupBy(*KEYS, *groupby).agg(F.avg("metric_value").alias("group_mean"))
    scored = groups.join(overall.where(F.col("_std") > 0), list(KEYS))
    z = (F.col("group_mean") - F.col("_mean")) / F.col("_std")
    out = scored.select(*KEYS, *groupby, "group_mean", z.alias("z_score"))
    return out.where(F.abs("z_score") > n_sigma)


def seasonal_bias_anomalies(metrics: DataFrame, n_sigma: float = 2.0) -> DataFrame:
    """Seasons whose mean bias stands out among the season means of a variable."""
    rows = metrics.where((F.col("metric_name") == "bias") & F.col("season").isNotNull())
    seasons = rows.groupBy("variable", "season").agg(F.avg("metric_value").alias("bias"))
    overall = seasons.groupBy("variable").agg(F.avg("bias").alias("_mean"), F.stddev_samp("bias").alias("_std"))
    z = (F.col("bias") - F.col("_mean")) / F.col("_std")
    out = seasons.join(overall.where(F.col("_std") > 0), "variable").select("variable", "season", "bias", z.alias("z_score"))
    return out.where(F.abs("z_score") > n_sigma)


def iqr_outliers(metrics: DataFrame, reach: float = 1.5) -> DataFrame:
    """Rows outside [Q1 - reach*IQR, Q3 + reach*IQR] of their variable and metric."""
    box = quantile_columns(metrics, "metric_value", {"_q1": 25, "_q3": 75}, KEYS)
    iqr = F.col("_q3") - F.col("_q1")
    v = F.col("metric_value")
    joined = metrics.join(box, list(KEYS))
    outside = (v < F.col("_q1") - reach * iqr) | (v > F.col("_q3") + reach * iqr)
    return joined.where(outside).drop("_q1", "_q3")
