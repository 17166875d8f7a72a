"""Readers of the partitioned forecast / observation / verification / metric tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import LEAD, MODEL, OBS_TIME, TARGET, forecast_schema, observation_schema
from ..session import materialize, settings


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing values are NULL everywhere downstream, so floating NaN becomes NULL on read."""
    fixed = {
        f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(fixed) if fixed else df


def calendar_predicate(start: str, end: str, year: str = "year", month: str = "month") -> Column:
    """Year/month partitions that overlap [start, end], so pruning never opens other folders."""
    first, last = (int(d[:4]) * 12 + int(d[5:7]) for d in (start, end))
    return (F.col(year) * 12 + F.col(month)).between(first, last)


def _within(time_col: str, start: str, end: str) -> Column:
    """Inclusive whole days: the last instant kept is 23:59:59 of the end date."""
    return F.col(time_col).between(
        F.lit(f"{start} 00:00:00").cast("timestamp"), F.lit(f"{end} 23:59:59").cast("timestamp")
    )


def load_forecasts(spark: SparkSession, root: str, model: str, start: str, end: str, variables) -> DataFrame:
    """One model's forecasts with target time inside the date range.

    `root` holds `model=/year=/month=` folders. Raises when the model has no partition.
    """
    table = spark.read.schema(forecast_schema(variables)).parquet(root).where(F.col(MODEL) == model)
    if table.limit(1).isEmpty():
        raise FileNotFoundError(f"no forecast partition for model {model!r} under {root}")
    rows = table.where(calendar_predicate(start, end) & _within(TARGET, start, end))
    return nan_to_null(rows.drop("year", "month")).withColumn(LEAD, F.col(LEAD).cast("int"))


def load_observations(spark: SparkSession, root: str, start: str, end: str, variables) -> DataFrame:
    """Observations with observation time inside the date range (`year=/month=` folders)."""
    rows = spark.read.schema(observation_schema(variables)).parquet(root)
    rows = rows.where(calendar_predicate(start, end) & _within(OBS_TIME, start, end))
    return nan_to_null(rows.drop("year", "month"))


def read_tables(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A file, folder, glob or list of them, with differing columns merged.

    Reading does not sort: order belongs to the sink.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise FileNotFoundError("no input paths given")
    return nan_to_null(spark.read.option("mergeSchema", True).parquet(*paths))


def union_null_filled(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns a frame lacks become null."""
    if not frames:
        raise ValueError("nothing to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def at_coordinates(df: DataFrame, latitude: float, longitude: float) -> DataFrame:
    """Rows of exactly one grid point or station."""
    return df.where((F.col("latitude") == latitude) & (F.col("longitude") == longitude))


def partition_inventory(df: DataFrame, partition_cols=(MODEL, "year", "month"), model: str | None = None) -> DataFrame:
    """Row count of every stored partition; only partition columns are read."""
    rows = df if model is None else df.where(F.col(MODEL) == model)
    return rows.groupBy(*partition_cols).agg(F.count(F.lit(1)).alias("row_count"))


# Settings under which a count by partition is answered from Parquet footers.
FOOTERS = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}


def footer_inventory(spark: SparkSession, root: str, partition_cols=(MODEL, "year", "month"), model: str | None = None) -> DataFrame:
    """`partition_inventory` of a stored table from the row counts in its files' footers; no column is read.

    The result, a row for each partition, is made here and now, as the settings that allow it hold for this read only.
    """
    with settings(spark, FOOTERS):
        return materialize(partition_inventory(spark.read.parquet(root), partition_cols, model), "inventory")


def filter_metrics(df: DataFrame, variables=None, metrics=None, models=None) -> DataFrame:
    """AND of optional membership filters; a filter on an absent column is ignored."""
    for column, wanted in (("variable", variables), ("metric_name", metrics), (MODEL, models)):
        if wanted is not None and column in df.columns:
            df = df.where(F.col(column).isin(*wanted))
    return df


def pivot_metrics(df: DataFrame, index: list[str], columns: list[str], values: list[str], value_col: str = "metric_value") -> DataFrame:
    """Long metrics to one column per entry of `values` (joined by `_` for several columns).

    The entries are given, so no extra job discovers them; a table without the
    named columns comes back unchanged.
    """
    if not {*index, *columns, value_col} <= set(df.columns):
        return df
    key = F.concat_ws("_", *columns)
    picked = [F.min(F.when(key == v, F.col(value_col))).alias(v) for v in values]
    return df.groupBy(*index).agg(*picked)
