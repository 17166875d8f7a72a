"""Append-with-dedup into Hive-partitioned tables."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ISSUE, LAT, LOCATION, LON, MODEL, OBS_TIME, TARGET
from ..session import materialize

FORECAST_PARTITIONS = (MODEL, "year", "month")
OBSERVATION_PARTITIONS = ("year", "month")


def location_identity(df: DataFrame) -> Column:
    """Location id of a row, or its coordinates where the row has none."""
    point = F.concat_ws(",", F.col(LAT).cast("string"), F.col(LON).cast("string"))
    return F.coalesce(LOCATION, point) if LOCATION in df.columns else point


def keep_last(df: DataFrame, key: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The last row of every key by `order`, then by all values.

    An aggregate, not a window: copies of one key are reduced before the
    shuffle, however many there are.
    """
    columns = df.columns
    named = [F.col(k).alias(f"_k{i}") if isinstance(k, str) else k.alias(f"_k{i}") for i, k in enumerate(key)]
    whole = F.struct(*columns)
    last = F.max_by(whole, F.struct(*order, whole.alias("_row"))).alias("_last")
    return df.groupBy(*named).agg(last).select("_last.*")


# More partitions than this in one batch are joined instead of listed.
MAX_LISTED = 2000


def _stored_schema(spark: SparkSession, root: str) -> T.StructType | None:
    """The schema that the last upsert left beside the data; null where there is no table yet."""
    try:
        rows = spark.read.text(f"{root}/_schema", wholetext=True).collect()
    except AnalysisException as error:
        # Only a table that is not there yet is fine; anything else is a real problem.
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return T.StructType.fromJson(json.loads("".join(r[0] for r in rows)))


def _inferred_schema(spark: SparkSession, root: str, partitions: T.StructType) -> T.StructType | None:
    """The schema of a table that another writer left there, with the batch's types of partition columns; null without a table."""
    try:
        found = spark.read.option("mergeSchema", True).parquet(root).schema
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return T.StructType([partitions[f.name] if f.name in partitions.names else f for f in found])


def _store_schema(spark: SparkSession, root: str, schema: T.StructType) -> None:
    spark.range(1).select(F.lit(schema.json()).alias("value")).coalesce(1).write.mode("overwrite").text(f"{root}/_schema")


def existing(spark: SparkSession, root: str, touched: DataFrame, partitions) -> DataFrame | None:
    """Rows of the partitions in `touched`, or null where there is no table.

    The partition values of a batch are few; as literals in the filter they prune
    the folders that are listed and read. The schema is the stored one, so no
    footer is opened for it.
    """
    schema = _stored_schema(spark, root) or _inferred_schema(spark, root, touched.schema)
    if schema is None:
        return None
    old = spark.read.schema(schema).parquet(root)
    values = touched.limit(MAX_LISTED + 1).collect()
    if len(values) > MAX_LISTED:
        return old.join(touched, list(partitions), "left_semi")
    wanted = F.lit(False)
    for row in values:
        same = F.lit(True)
        for p in partitions:
            same = same & (F.col(p).isNull() if row[p] is None else F.col(p) == F.lit(row[p]))
        wanted = wanted | same
    return old.where(wanted)


def upsert_rows(new: DataFrame, root: str, key: list[str], partitions, order_by, keep_old_columns: bool) -> int:
    """Merge rows by key and location identity into Hive partitions; returns the rows of the partitions written."""
    spark = new.sparkSession
    touched = new.select(*partitions).distinct()
    batch = new.withColumn("_seq", F.lit(1))
    old = existing(spark, root, touched, partitions)
    union = new.schema
    if old is not None:
        union = T.StructType([*new.schema, *[f for f in old.schema if f.name not in new.columns]])
        old = old.withColumn("_seq", F.lit(0))
        if not keep_old_columns:
            old = old.select(*[c for c in batch.columns if c in old.columns])
        batch = old.unionByName(batch, allowMissingColumns=True)
    order = ["_seq", *[c for c in order_by if c in batch.columns]]
    merged = keep_last(batch, [*key, location_identity(batch)], order).drop("_seq")
    # Written aside first: the target's own partitions are among the inputs.
    staged = materialize(merged, "upsert")
    # One hot partition is split over several writers, small ones share one.
    out = staged.hint("rebalance", *partitions)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(root)
    _store_schema(spark, root, union)
    return staged.count()


def upsert_forecasts(new: DataFrame, root: str, order_by=()) -> int:
    """Merge forecast rows into `model=/year=/month=`; returns the rows written.

    Key: issue, target, model, location identity. The newest batch wins; within
    a batch the row that is last by `order_by`. Columns the new batch lacks are
    dropped from the partitions it touches.
    """
    rows = new.withColumns({"year": F.year(TARGET), "month": F.month(TARGET)})
    return upsert_rows(rows, root, [ISSUE, TARGET, MODEL], FORECAST_PARTITIONS, order_by, keep_old_columns=False)


def upsert_observations(new: DataFrame, root: str, order_by=()) -> int:
    """Merge observation rows into `year=/month=`; old and new columns are united."""
    rows = new.withColumns({"year": F.year(OBS_TIME), "month": F.month(OBS_TIME)})
    return upsert_rows(rows, root, [OBS_TIME], OBSERVATION_PARTITIONS, order_by, keep_old_columns=True)
