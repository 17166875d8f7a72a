"""Season and month summaries of the long metric table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SEASONS


def _mean_and_size() -> list[Column]:
    return [F.avg("metric_value").alias("metric_value"), F.sum("sample_size").alias("sample_size")]


def _complete(summary: DataFrame, by: list[str], expected: Column, keys: list[str]) -> DataFrame:
    """Re-index every `by` group to all expected keys; absent ones get null values."""
    fields = [c for c in summary.columns if c not in (*by, *keys)]
    packed = summary.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct(*keys).alias("k"), F.struct(*fields).alias("v")))).alias("_m")
    )
    rows = packed.select(*by, "_m", F.explode(expected).alias("_k"))
    return rows.select(
        *by,
        *[F.col(f"_k.{k}").alias(k) for k in keys],
        *[F.try_element_at("_m", F.col("_k"))[f].alias(f) for f in fields],
    )


def _season_keys(metrics=None) -> Column:
    if metrics is None:
        return F.array(*[F.struct(F.lit(s).alias("season")) for s in SEASONS])
    pairs = [(s, m) for s in SEASONS for m in metrics]
    return F.array(*[F.struct(F.lit(s).alias("season"), F.lit(m).alias("metric_name")) for s, m in pairs])


def seasonal_bias(metrics: DataFrame, by=("variable",)) -> DataFrame:
    """Mean bias and summed sample size for all four seasons."""
    by = list(by)
    rows = metrics.where((F.col("metric_name") == "bias") & F.col("season").isNotNull())
    summary = rows.groupBy(*by, "season").agg(*_mean_and_size())
    return _complete(summary, by, _season_keys(), ["season"]).withColumnRenamed("metric_value", "bias")


def seasonal_skill(metrics: DataFrame, names=("mae", "rmse", "bias"), by=("variable",)) -> DataFrame:
    """Mean metric and summed sample size for every season and requested metric."""
    by = list(by)
    rows = metrics.where(F.col("metric_name").isin(*names) & F.col("season").isNotNull())
    summary = rows.groupBy(*by, "season", "metric_name").agg(*_mean_and_size())
    return _complete(summary, by, _season_keys(names), ["season", "metric_name"])


def monthly_skill(metrics: DataFrame, names=("mae", "rmse", "bias"), by=("variable",)) -> DataFrame:
    rows = metrics.where(F.col("metric_name").isin(*names) & F.col("month").isNotNull())
    return rows.groupBy(*by, "month", "metric_name").agg(*_mean_and_size())


def monthly_chart(metrics: DataFrame, name: str, by=("variable",)) -> DataFrame:
    """One metric for all twelve months, null where a month has no data."""
    by = list(by)
    rows = metrics.where((F.col("metric_name") == name) & F.col("month").isNotNull())
    summary = rows.groupBy(*by, F.col("month").cast("int").alias("month")).agg(*_mean_and_size())
    months = F.array(*[F.struct(F.lit(m).alias("month")) for m in range(1, 13)])
    return _complete(summary, by, months, ["month"])


def season_lead_series(metrics: DataFrame, name: str = "mae", by=("variable",)) -> DataFrame:
    """Per-season metric by lead (the seasonal degradation chart)."""
    rows = metrics.where((F.col("metric_name") == name) & F.col("season").isNotNull())
    return rows.groupBy(*by, "season", "lead_hours").agg(*_mean_and_size())
