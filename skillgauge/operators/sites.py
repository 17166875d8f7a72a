"""Native against interpolated forecasts at many sites that share one grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.angles import error_of
from ..functions.geo import GRID_RADIUS_KM
from ..schemas import CIRCULAR_ERROR_VARIABLES, ISSUE, LAT, LEAD, LON, MODEL, OBS_TIME, TARGET
from ..session import materialize, settings
from .interpolate import HASHED_JOINS, grid_nodes, grid_points, interpolate_to_sites
from .nearest import nearest_point


def site_error_table(forecasts: DataFrame, observations: DataFrame, variables, by=()) -> DataFrame:
    """Errors of the nearest grid point and of the bilinear value, per site, model, issue and target.

    `by` columns (if any) name the grid a site belongs to; without them every
    site uses the one grid. Inner joins: all three values must have the time.
    """
    grid_key = list(by)
    if not grid_key:
        grid_key = ["_grid"]
        forecasts, observations = forecasts.withColumn("_grid", F.lit(0)), observations.withColumn("_grid", F.lit(0))
    # Both inputs are read once: nodes and daily means are far fewer rows, and all else derives from them.
    nodes = grid_nodes(forecasts, variables, grid_key)
    observed = observations.groupBy(
        *grid_key, F.col(LAT).alias("site_lat"), F.col(LON).alias("site_lon"), F.col(OBS_TIME).alias(TARGET)
    ).agg(*[F.avg(v).alias(f"_{v}_obs") for v in variables])
    return _site_errors(nodes, observed, variables, grid_key, by)


def paired_site_error_table(rows: DataFrame, variables, by=()) -> DataFrame:
    """`site_error_table` of rows that hold a forecast of a node and, as `site_lat`, `site_lon`, OBS_TIME and `{v}_obs`, a truth of a site.

    The rows are read once and not stored: the least forecasts and the sums of the truths
    by node, site and time are, from which nodes and means derive.
    """
    grid_key = list(by)
    if not grid_key:
        grid_key = ["_grid"]
        rows = rows.withColumn("_grid", F.lit(0))
    sums = [part for v in variables for part in (F.min(v).alias(v), F.sum(f"{v}_obs").alias(f"_{v}_sum"), F.count(f"{v}_obs").alias(f"_{v}_n"))]
    with settings(rows.sparkSession, HASHED_JOINS):
        held = materialize(rows.groupBy(*grid_key, MODEL, ISSUE, TARGET, LEAD, LAT, LON, "site_lat", "site_lon", OBS_TIME).agg(*sums), "site-rows")
    nodes = grid_nodes(held, variables, grid_key)
    observed = held.groupBy(*grid_key, "site_lat", "site_lon", F.col(OBS_TIME).alias("_time")).agg(
        *[F.try_divide(F.sum(f"_{v}_sum"), F.sum(f"_{v}_n")).alias(f"_{v}_obs") for v in variables]
    )
    return _site_errors(nodes, observed.withColumnRenamed("_time", TARGET), variables, grid_key, by)


def _site_errors(nodes: DataFrame, observed: DataFrame, variables, grid_key, by) -> DataFrame:
    """Errors from stored nodes and from the mean truth per site and time (as TARGET)."""
    observed = materialize(observed, "site-observations")
    sites = observed.select(*grid_key, F.col("site_lat").alias(LAT), F.col("site_lon").alias(LON)).dropna().distinct()
    points = grid_points(nodes, grid_key)
    nearest = nearest_point(sites, points, grid_key, GRID_RADIUS_KM)
    place = [F.col(c).alias(n) for n, c in (("site_latitude", LAT), ("site_longitude", LON), ("site_lat", LAT), ("site_lon", LON))]
    named = nearest.select(*grid_key, *place, "distance_km", "point_latitude", "point_longitude")
    point = named.withColumnsRenamed({"point_latitude": LAT, "point_longitude": LON})
    # Native and interpolated values come from one pass over the nodes.
    sampled = interpolate_to_sites(
        nodes, named.drop("point_latitude", "point_longitude"), variables, "bilinear", grid_key, keep_native=False, beside=point, points=points
    ).drop(LAT, LON)
    sampled = sampled.withColumnsRenamed({v: f"{v}_interp" for v in variables})
    joined = sampled.join(observed, [*grid_key, "site_lat", "site_lon", TARGET])
    errors = [
        error_of(F.col(f"{v}_{kind}"), F.col(f"_{v}_obs"), v in CIRCULAR_ERROR_VARIABLES).alias(f"{v}_{kind}_error")
        for v in variables
        for kind in ("native", "interp")
    ]
    return joined.select(
        *by,
        "site_lat",
        "site_lon",
        F.col("distance_km").alias("site_distance_km"),
        MODEL,
        ISSUE,
        TARGET,
        LEAD,
        F.month(TARGET).alias("month"),
        *errors,
    )


def site_gain(errors: DataFrame, variable: str, by=()) -> DataFrame:
    """Per site: native and interpolated MAE, gain, distance."""
    rows = errors.groupBy(*by, "site_lat", "site_lon").agg(
        F.avg(F.abs(f"{variable}_native_error")).alias("native_mae"),
        F.avg(F.abs(f"{variable}_interp_error")).alias("interp_mae"),
        F.min("site_distance_km").alias("distance_km"),
    )
    return rows.withColumn("improvement", F.col("native_mae") - F.col("interp_mae"))


def gain_overview(gains: DataFrame, elevations: DataFrame) -> DataFrame:
    """One row: correlation of the gain with distance and elevation, sea-level and inland means, improved sites.

    `elevations` has site_lat, site_lon, elevation.
    """
    joined = gains.join(elevations, ["site_lat", "site_lon"])
    gain, sea = F.col("improvement"), F.col("elevation") <= 0
    return joined.agg(
        F.count(F.lit(1)).alias("sites"),
        F.corr("distance_km", "improvement").alias("distance_correlation"),
        F.corr("elevation", "improvement").alias("elevation_correlation"),
        F.avg(F.when(sea, gain)).alias("sea_level_gain"),
        F.avg(F.when(~sea, gain)).alias("inland_gain"),
        F.count_if(gain > 0).alias("improved_sites"),
    )


# Right-closed distance bands in kilometres.
DISTANCE_BANDS = ((0, 3), (3, 6), (6, 10), (10, 20))


def distance_band(distance: Column, bands=DISTANCE_BANDS) -> Column:
    out = F.lit(None).cast("int")
    for i, (low, high) in enumerate(bands):
        out = F.when((distance > low) & (distance <= high), F.lit(i)).otherwise(out)
    return out


def reduction_by_distance(gains: DataFrame, bands=DISTANCE_BANDS) -> DataFrame:
    """Sites, mean distance and mean % reduction per distance band."""
    reduction = F.try_divide(F.col("improvement") * 100.0, F.col("native_mae"))
    rows = gains.withColumns({"reduction_pct": reduction, "band": distance_band(F.col("distance_km"), bands)})
    return rows.where(F.col("band").isNotNull()).groupBy("band").agg(
        F.count(F.lit(1)).alias("sites"),
        F.avg("distance_km").alias("mean_distance_km"),
        F.avg("reduction_pct").alias("mean_reduction_pct"),
    )
