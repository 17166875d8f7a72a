"""Metrics that are kept up to date: moments and quantile sketches by partition, renewed only where rows changed.

Both tables lie in the folders of the verification table (`model=/year=/month=`).
After an upsert the partitions that it touched are read and reduced again; every
other partition keeps what it has. Metrics and quantiles of any grouping come from
these small tables, without the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.temporal import season_of_month
from ..operators.metrics import error_moments, merged_moments
from ..operators.sketches import error_sketches, merged_sketches
from ..schemas import ISSUE, LEAD, METRICS, MODEL, MONTH, SEASON, TARGET
from .datasets import METRIC_GROUPS
from .upsert import FORECAST_PARTITIONS, existing, upsert_rows

# Groups that moments and sketches are kept for, whatever the folders.
FINEST = (MODEL, "year", MONTH, LEAD)


def append_verification(rows: DataFrame, root: str, key=(), order_by=(), partitions=FORECAST_PARTITIONS) -> DataFrame:
    """Merge verification rows into their partitions (of model, year and month); returns those partitions.

    Rows are the same if issue, target, model, location and the columns of `key` agree; the newest wins.
    """
    dated = rows.withColumns({"year": F.year(TARGET), MONTH: F.month(TARGET)})
    upsert_rows(dated, root, [ISSUE, TARGET, MODEL, *key], partitions, order_by, keep_old_columns=True)
    return dated.select(*partitions).distinct()


def touched_rows(spark: SparkSession, root: str, touched: DataFrame) -> DataFrame:
    """Rows of the touched partitions; no other folder is opened."""
    rows = existing(spark, root, touched, touched.columns)
    if rows is None:
        raise FileNotFoundError(f"no verification table under {root}")
    return rows


def _renew(table: DataFrame, store: str, partitions) -> None:
    out = table.hint("rebalance", *partitions)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(store)


def refresh_moments(spark: SparkSession, root: str, store: str, touched: DataFrame, variables, partitions=FORECAST_PARTITIONS) -> None:
    """Moments of the touched partitions anew, by model, month and lead time."""
    _renew(error_moments(touched_rows(spark, root, touched), FINEST, variables), store, partitions)


def refresh_sketches(spark: SparkSession, root: str, store: str, touched: DataFrame, variables, partitions=FORECAST_PARTITIONS) -> None:
    """Quantile sketches of the touched partitions anew, by model, month, lead time and variable."""
    _renew(error_sketches(touched_rows(spark, root, touched), FINEST, variables), store, partitions)


def _with_season(stored: DataFrame) -> DataFrame:
    return stored.withColumn(SEASON, F.when(F.col(MONTH).isNotNull(), season_of_month(F.col(MONTH))))


def stored_metrics(spark: SparkSession, store: str, variables, sets=METRIC_GROUPS, metrics=METRICS) -> DataFrame:
    """Metrics of several groupings from the stored moments."""
    return merged_moments(_with_season(spark.read.parquet(store)), sets, variables, metrics)


def stored_sketches(spark: SparkSession, store: str, by=()) -> DataFrame:
    """Sketches of a coarser grouping, merged from the stored ones."""
    return merged_sketches(_with_season(spark.read.parquet(store)), by)
