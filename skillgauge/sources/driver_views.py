"""Forecast-shaped views over the order / shipment / event tables, in Spark and in SQL.

An order is a forecast run and its shipments are the valid times; the part's
size and price are the truth. An event type is a model and a six-hour slot the
target. Both spellings of every view give the same rows, so a query on the
Spark view can be checked against SQL on the raw tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.temporal import season_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lattice(suppkey):
    # The place of a supplier repeats every 20 keys.
    lat = F.lit(55.0) + (suppkey % 4) * F.lit(0.25)
    lon = F.lit(12.0) + (F.floor(suppkey / 4).cast("bigint") % 5) * F.lit(0.25)
    return lat.alias("latitude"), lon.alias("longitude")


def shipments(spark: SparkSession, sf_dir: str, parts_first: bool = False) -> DataFrame:
    """Every shipment as a forecast row, also those before their order (negative lead).

    With `parts_first` the parts are joined before the orders: the same rows, and
    their key need not go on to the second join where nothing else of a part is read.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        # All that is read of a supplier and of the flags: rows are narrow before they are shuffled.
        (F.col("l_suppkey") % 20).cast("int").alias("place"),
        F.concat("l_returnflag", "l_linestatus").alias("model"),
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        "l_shipdate",
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    observed = F.when(F.col("p_size") % 10 != 0, F.col("p_size").cast("double"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    target = F.col("l_shipdate").cast("timestamp")
    of_order, of_part = (orders, lines.l_orderkey == orders.o_orderkey), (parts, lines.l_partkey == parts.p_partkey)
    first, second = (of_part, of_order) if parts_first else (of_order, of_part)
    joined = lines.join(*first).join(*second)
    return joined.select(
        F.col("o_orderdate").cast("timestamp").alias("forecast_issue_time"),
        target.alias("forecast_target_time"),
        F.when(observed.isNotNull(), target).alias("observation_time"),
        (F.datediff("l_shipdate", "o_orderdate") * 24).cast("int").alias("lead_hours"),
        "model",
        *_lattice(F.col("place")),
        F.concat(F.lit("loc"), F.col("place").cast("string")).alias("location_id"),
        F.month("l_shipdate").alias("month"),
        season_of(F.col("l_shipdate")).alias("season"),
        F.col("l_quantity").alias("forecast_qty"),
        observed.alias("observed_qty"),
        (F.col("l_quantity") - observed).alias("qty_error"),
        price.alias("forecast_price"),
        F.col("p_retailprice").alias("observed_price"),
        (price - F.col("p_retailprice")).alias("price_error"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_id"),
    )


def verification(spark: SparkSession, sf_dir: str, parts_first: bool = False) -> DataFrame:
    """Shipments on or after the day of their order, which are forecasts: the canonical verification table."""
    return shipments(spark, sf_dir, parts_first).where(F.col("lead_hours") >= 0)


SHIPMENTS_CTE = """
obs_v AS (
  SELECT p_partkey AS partkey, p_retailprice AS price_obs,
         CASE WHEN p_size % 10 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS qty_obs
  FROM part),
shipments AS (
  SELECT o_orderdate AS forecast_issue_time, l_shipdate AS forecast_target_time,
         CASE WHEN qty_obs IS NOT NULL THEN l_shipdate END AS observation_time,
         CAST(datediff('day', o_orderdate, l_shipdate) * 24 AS INT) AS lead_hours,
         concat(l_returnflag, l_linestatus) AS model,
         CAST(55.0 AS DOUBLE) + (l_suppkey % 4) * CAST(0.25 AS DOUBLE) AS latitude,
         CAST(12.0 AS DOUBLE) + (CAST(floor(l_suppkey / 4) AS BIGINT) % 5) * CAST(0.25 AS DOUBLE) AS longitude,
         concat('loc', CAST(l_suppkey % 20 AS VARCHAR)) AS location_id,
         CAST(month(l_shipdate) AS INT) AS month,
         CASE WHEN month(l_shipdate) IN (12,1,2) THEN 'DJF' WHEN month(l_shipdate) IN (3,4,5) THEN 'MAM'
              WHEN month(l_shipdate) IN (6,7,8) THEN 'JJA' ELSE 'SON' END AS season,
         l_quantity AS forecast_qty, qty_obs AS observed_qty, l_quantity - qty_obs AS qty_error,
         l_extendedprice / l_quantity AS forecast_price, price_obs AS observed_price,
         l_extendedprice / l_quantity - price_obs AS price_error,
         l_orderkey AS order_id, l_linenumber AS line_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN obs_v ON l_partkey = partkey)"""

VERIFICATION_CTE = SHIPMENTS_CTE + """,
verification AS (SELECT * FROM shipments WHERE lead_hours >= 0)"""


def _slot(ts):
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(1e6) / F.lit(21600.0)).cast("bigint")


def _slot_time(slot):
    return F.timestamp_seconds(slot * F.lit(21600))


def ensemble_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value per (slot, location, event type): one row per model and target."""
    events = table(spark, sf_dir, "events")
    keyed = events.select(
        _slot(F.col("ts")).alias("slot"),
        F.concat(F.lit("loc"), (F.col("user_id") % 10).cast("string")).alias("location_id"),
        F.col("event_type").alias("model"),
        "value",
    )
    means = keyed.groupBy("slot", "location_id", "model").agg(F.avg("value").alias("value"))
    lead = (F.lit(1) + F.col("slot") % 7).cast("int")
    return means.select(
        _slot_time(F.col("slot") - 4 * lead).alias("forecast_issue_time"),
        _slot_time(F.col("slot")).alias("forecast_target_time"),
        (lead * 24).cast("int").alias("lead_hours"),
        "model",
        "location_id",
        *_location_point(),
        F.lit("load").alias("variable"),
        "value",
    )


def _location_point():
    number = F.substring("location_id", 4, 3).cast("int")
    return (F.lit(50.0) + number * F.lit(0.5)).alias("latitude"), (F.lit(8.0) + number * F.lit(0.25)).alias("longitude")


def ensemble_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value per (slot, location) over all events."""
    events = table(spark, sf_dir, "events")
    keyed = events.select(
        _slot(F.col("ts")).alias("slot"),
        F.concat(F.lit("loc"), (F.col("user_id") % 10).cast("string")).alias("location_id"),
        "value",
    )
    means = keyed.groupBy("slot", "location_id").agg(F.avg("value").alias("value"))
    return means.select(
        _slot_time(F.col("slot")).alias("observation_time"),
        "location_id",
        *_location_point(),
        F.lit("load").alias("variable"),
        "value",
    )


ENSEMBLE_CTE = """
ens_f0 AS (
  SELECT slot, location_id, model, avg(value) AS value FROM
    (SELECT CAST(floor(epoch(ts) / 21600) AS BIGINT) AS slot,
            concat('loc', CAST(user_id % 10 AS VARCHAR)) AS location_id, event_type AS model, value FROM events)
  GROUP BY slot, location_id, model),
ens_forecasts AS (
  SELECT make_timestamp(CAST((slot - 4 * (1 + slot % 7)) * 21600 * 1000000 AS BIGINT)) AS forecast_issue_time,
         make_timestamp(CAST(slot * 21600 * 1000000 AS BIGINT)) AS forecast_target_time,
         CAST((1 + slot % 7) * 24 AS INT) AS lead_hours, model, location_id,
         CAST(50.0 AS DOUBLE) + CAST(substr(location_id, 4, 3) AS INT) * CAST(0.5 AS DOUBLE) AS latitude,
         CAST(8.0 AS DOUBLE) + CAST(substr(location_id, 4, 3) AS INT) * CAST(0.25 AS DOUBLE) AS longitude,
         'load' AS variable, value
  FROM ens_f0),
ens_o0 AS (
  SELECT slot, location_id, avg(value) AS value FROM
    (SELECT CAST(floor(epoch(ts) / 21600) AS BIGINT) AS slot,
            concat('loc', CAST(user_id % 10 AS VARCHAR)) AS location_id, value FROM events)
  GROUP BY slot, location_id),
ens_observations AS (
  SELECT make_timestamp(CAST(slot * 21600 * 1000000 AS BIGINT)) AS observation_time, location_id,
         CAST(50.0 AS DOUBLE) + CAST(substr(location_id, 4, 3) AS INT) * CAST(0.5 AS DOUBLE) AS latitude,
         CAST(8.0 AS DOUBLE) + CAST(substr(location_id, 4, 3) AS INT) * CAST(0.25 AS DOUBLE) AS longitude,
         'load' AS variable, value
  FROM ens_o0)"""
