"""Previous-row logic along time that stays parallel inside a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import where_present
from ..functions.temporal import hours_between
from ..schemas import LAT, LON, OBS_TIME, TARGET


def with_previous(df: DataFrame, keys, time: str, values: dict[str, str]) -> DataFrame:
    """Add the previous row's columns (`values`: new name -> source) per key along time.

    A key is ordered month by month, each month in its own task; a small table
    of each month's last row supplies the first row of the next month. Times
    must be distinct within a key. Rows with a null key or time have no order
    and are left out.
    """
    keys = list(keys)
    month = F.coalesce(F.year(time) * 12 + F.month(time), F.lit(0))
    rows = where_present(df, [*keys, time]).withColumn("_bucket", month)
    last = [F.max_by(c, time).alias(f"_last_{n}") for n, c in values.items()]
    months = rows.groupBy(*keys, "_bucket").agg(*last)
    along_months = Window.partitionBy(*keys).orderBy("_bucket")
    carried = months.select(
        *keys, "_bucket", *[F.lag(f"_last_{n}").over(along_months).alias(f"_carried_{n}") for n in values]
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy(time)
    local = rows.withColumns({"_first": F.lag(time).over(within).isNull(), **{n: F.lag(c).over(within) for n, c in values.items()}})
    joined = local.join(carried, [*keys, "_bucket"], "left")
    out = joined.withColumns({n: F.when(F.col("_first"), F.col(f"_carried_{n}")).otherwise(F.col(n)) for n in values})
    return out.drop("_bucket", "_first", *[f"_carried_{n}" for n in values])


def time_gaps(df: DataFrame, keys=(LAT, LON), time: str = OBS_TIME, max_hours: float = 1.5) -> DataFrame:
    """Consecutive distinct times of a key that lie more than `max_hours` apart."""
    points = where_present(df, [*keys, time]).select(*keys, time).distinct()
    paired = with_previous(points, keys, time, {"previous_time": time})
    gaps = paired.withColumn("gap_hours", hours_between("previous_time", time))
    return gaps.where(F.col("gap_hours") > max_hours)


def gap_summary(df: DataFrame, keys=(LAT, LON), time: str = OBS_TIME, max_hours: float = 1.5) -> DataFrame:
    """One row: number of gaps, keys with gaps, longest gap."""
    per_key = time_gaps(df, keys, time, max_hours).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.max("gap_hours").alias("_longest")
    )
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("gaps"),
        F.count(F.lit(1)).alias("keys_with_gaps"),
        F.max("_longest").alias("longest_gap_hours"),
    )


def persistence(observations: DataFrame, keys, value: str, time: str = OBS_TIME) -> DataFrame:
    """Baseline forecast: the previous observed value of the same key."""
    known = where_present(observations, [*keys, time, value])
    states = known.groupBy(*keys, time).agg(F.avg(value).alias("observed_value"))
    paired = with_previous(states, keys, time, {"persistence_forecast": "observed_value", "previous_time": time})
    error = F.col("persistence_forecast") - F.col("observed_value")
    return paired.withColumnRenamed(time, TARGET).withColumn("error", error)
