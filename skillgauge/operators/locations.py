"""Location compatibility of forecasts and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import AUDIT_RADIUS_KM
from ..schemas import LAT, LOCATION, LON
from .nearest import nearest_point

MAX_DISTANCE_KM = 50.0


def unique_locations(df: DataFrame) -> DataFrame:
    """Distinct non-null coordinates."""
    return df.select(LAT, LON).dropna().distinct()


def unmatched_location_ids(forecasts: DataFrame, observations: DataFrame) -> DataFrame:
    """Forecast location ids that no observation carries."""
    wanted = forecasts.select(LOCATION).where(F.col(LOCATION).isNotNull()).distinct()
    return wanted.join(observations.select(LOCATION).distinct(), LOCATION, "left_anti")


def nearest_observation_distance(forecasts: DataFrame, observations: DataFrame, by=None) -> DataFrame:
    """Each forecast point with its nearest observation point, inside equal location ids if shared."""
    if by is None:
        by = [LOCATION] if LOCATION in forecasts.columns and LOCATION in observations.columns else []
    sites = forecasts.where(F.col(LOCATION).isNotNull()) if by == [LOCATION] else forecasts
    return nearest_point(sites, observations, by, AUDIT_RADIUS_KM)


def too_far(forecasts: DataFrame, observations: DataFrame, max_km: float = MAX_DISTANCE_KM) -> DataFrame:
    return nearest_observation_distance(forecasts, observations).where(F.col("distance_km") > max_km)


def location_audit(forecasts: DataFrame, observations: DataFrame) -> DataFrame:
    """One row: location counts of both sides, largest nearest distance, shared id or not."""
    shared = LOCATION in forecasts.columns and LOCATION in observations.columns
    row = nearest_observation_distance(forecasts, observations).agg(
        F.coalesce(F.max("distance_km"), F.lit(0.0)).alias("max_nearest_distance_km")
    )
    count = lambda df: unique_locations(df).agg(F.count(F.lit(1))).scalar()
    return row.select(
        count(forecasts).alias("forecast_locations"),
        count(observations).alias("observation_locations"),
        "max_nearest_distance_km",
        F.lit(shared).alias("has_location_id"),
    )


def require_compatible(
    forecasts: DataFrame, observations: DataFrame, max_km: float = MAX_DISTANCE_KM, allow_many_without_id: bool = False
) -> DataFrame:
    """The audit row, or an error: fails closed on ambiguous, unknown or distant locations.

    Only counts and a short preview of offenders reach the driver.
    """
    has_f, has_o = LOCATION in forecasts.columns, LOCATION in observations.columns
    if has_f != has_o:
        raise ValueError("location_id must be present on both forecasts and observations")
    audit = location_audit(forecasts, observations)
    row = audit.first()
    for side in ("forecast", "observation"):
        if row[f"{side}_locations"] == 0:
            raise ValueError(f"{side} data has no non-null coordinates")
    if has_f:
        unknown = [r[0] for r in unmatched_location_ids(forecasts, observations).orderBy(LOCATION).limit(5).collect()]
        if unknown:
            raise ValueError(f"forecast location ids without observations, first: {unknown}")
    elif not allow_many_without_id and (row["forecast_locations"] > 1 or row["observation_locations"] > 1):
        raise ValueError("several locations but no shared location_id: the join would be ambiguous")
    if row["max_nearest_distance_km"] > max_km:
        far = [r.asDict() for r in too_far(forecasts, observations, max_km).orderBy(F.desc("distance_km")).limit(5).collect()]
        raise ValueError(f"forecast points more than {max_km} km from any observation, first: {far}")
    return audit
