"""Forecast and observation tables stored by site and time, so that joining them moves no row.

Both tables have the same number of buckets by site and time and are sorted by them in each.
The join then reads bucket beside bucket: no exchange, however often the
verification table is built. Time is part of the key, so a site with most of
the rows fills all buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import with_calendar
from ..operators.errors import add_errors, canonical
from ..schemas import LOCATION, OBS_TIME, TARGET, forecast_var, observed_var
from ..session import scratch_path

SITE = "_site"
# Stands for a null location id, which matches a null one; equality on a non-null column keeps the buckets usable.
NO_SITE = "\0"


def store_bucketed(df: DataFrame, table: str, time: str, buckets: int, path: str | None = None) -> DataFrame:
    """`df` as the table `table`, bucketed and sorted by site and `time`; rows are dealt first, so a bucket is one file."""
    rows = df.withColumn(SITE, F.coalesce(F.col(LOCATION).cast("string"), F.lit(NO_SITE))).repartition(buckets, SITE, time)
    rows.write.bucketBy(buckets, SITE, time).sortBy(SITE, time).mode("overwrite").option("path", path or scratch_path(df.sparkSession, table)).saveAsTable(table)
    return df.sparkSession.table(table)


def build_from_bucketed(forecasts: DataFrame, observations: DataFrame, variables) -> DataFrame:
    """The verification table of two bucketed tables, as `align.build_verification` gives it with location ids on both sides."""
    kept = [c for c in forecasts.columns if c not in variables and c != SITE]
    f = forecasts.select(SITE, *kept, *[F.col(v).alias(forecast_var(v)) for v in variables if v in forecasts.columns])
    o = observations.select(SITE, OBS_TIME, *[F.col(v).alias(observed_var(v)) for v in variables if v in observations.columns])
    joined = f.join(o, (f[SITE] == o[SITE]) & (f[TARGET] == o[OBS_TIME]), "left").drop(SITE)
    return with_calendar(canonical(add_errors(joined, variables), variables))
