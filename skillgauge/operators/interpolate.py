"""Gridded forecasts at observation sites: nearest, inverse distance, bilinear.

The grid's geometry is tiny next to its rows. Lines, corners and weights are
worked out once per (site, model) from distinct coordinates. The forecasts are
read once, for the values of their nodes, which keep only the corner points and
are combined by a plain weighted aggregate per (issue, target). No cube and no per-site loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.angles import resultant_angle, weighted_mean, weighted_mean_agg
from ..functions.geo import GRID_RADIUS_KM, haversine_km
from ..functions.names import site_of_corner
from ..schemas import CIRCULAR_GRID_VARIABLES, ISSUE, LAT, LEAD, LOCATION, LON, MODEL, TARGET
from ..session import materialize, settings
from .lattice import grid_lines, grid_spacing, line_index
from .nearest import k_nearest

METHODS = ("bilinear", "idw", "nearest")
# Joins below the grouping of nodes whose parts are small are hashed: buffers of sorted rows would take the
# grouping's memory and spill. Larger parts are sorted and merged as ever.
HASHED_JOINS = {"spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m"}
NEIGHBOURS = 4


def collapse_corners(df: DataFrame) -> DataFrame:
    """Give grid-corner locations the id of the site they surround."""
    return df.withColumn(LOCATION, site_of_corner(F.col(LOCATION)))


def sites_of(observations: DataFrame, by=(LOCATION,)) -> DataFrame:
    """The single observation point of each site; sites with several points have none."""
    points = observations.select(*by, LAT, LON).distinct().groupBy(*by)
    one = points.agg(
        F.count(F.lit(1)).alias("_n"), F.min(LAT).alias("site_latitude"), F.min(LON).alias("site_longitude")
    )
    return one.where(F.col("_n") == 1).drop("_n")


def grid_points(forecasts: DataFrame, by=(LOCATION,)) -> DataFrame:
    """Distinct (by, model, latitude, longitude), stored once: all geometry derives from it."""
    points = forecasts.select(*by, MODEL, LAT, LON).dropna(subset=[LAT, LON]).distinct()
    return materialize(points, "grid-points")


def grid_nodes(forecasts: DataFrame, variables, by=(LOCATION,)) -> DataFrame:
    """The smallest value of every variable per node and time, stored once: points and values derive from it."""
    key = [*by, MODEL, ISSUE, TARGET, LEAD, LAT, LON]
    nodes = forecasts.groupBy(*key).agg(*[F.min(v).alias(v) for v in variables])
    with settings(forecasts.sparkSession, HASHED_JOINS):
        return materialize(nodes, "grid-nodes")


def corner_weights(forecasts: DataFrame, sites: DataFrame, method: str = "bilinear", by=(LOCATION,)) -> DataFrame:
    """Weight of every usable grid point per site and model, from forecast rows or just their points.

    Columns: by, the remaining site columns, model, latitude, longitude (as found
    in the forecasts), corner (0..3), weight. Rows exist only for points that
    carry weight; several jittered points may share a corner.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, expected one of {METHODS}")
    by = list(by)
    points = forecasts if set(forecasts.columns) == {*by, MODEL, LAT, LON} else grid_points(forecasts, by)
    lines = grid_lines(points, [*by, MODEL])
    snapped = points.join(lines, [*by, MODEL]).select(
        *by,
        MODEL,
        LAT,
        LON,
        line_index(F.col(LAT), F.col("lat_lines")).alias("_i"),
        line_index(F.col(LON), F.col("lon_lines")).alias("_j"),
    )
    site_cols = [c for c in sites.columns if c not in by]
    framed = sites.join(lines, by)
    corners = framed.select(*by, *site_cols, MODEL, F.explode(_corners(method)).alias("_w"))
    corners = corners.select(*by, *site_cols, MODEL, "_w.*")
    return corners.join(snapped, [*by, MODEL, "_i", "_j"]).drop("_i", "_j")


def _corners(method: str) -> Column:
    """Array of (corner, weight, _i, _j) for site_latitude / site_longitude over the line arrays."""
    lats, lons = F.col("lat_lines"), F.col("lon_lines")
    lat, lon = F.col("site_latitude"), F.col("site_longitude")
    i, j = line_index(lat, lats), line_index(lon, lons)
    single = F.array(_corner(F.lit(0), F.lit(1.0), i, j))
    if method == "nearest":
        return single
    # A grid with one line on an axis spans no cell: take its nearest node.
    flat = (F.size(lats) < 2) | (F.size(lons) < 2)
    several = _idw_corners(lats, lons, lat, lon) if method == "idw" else _bilinear_corners(lats, lons, lat, lon)
    return F.when(flat, single).otherwise(several)


def _corner(k: Column, w: Column, i: Column, j: Column) -> Column:
    return F.struct(
        k.cast("int").alias("corner"), w.alias("weight"), i.cast("int").alias("_i"), j.cast("int").alias("_j")
    )


def _bilinear_corners(lats: Column, lons: Column, lat: Column, lon: Column) -> Column:
    """The enclosing cell, clamped to the edge cell outside the grid."""
    i0, v = _cell(lats, lat)
    j0, u = _cell(lons, lon)
    one = F.lit(1.0)
    return F.array(
        _corner(F.lit(0), (one - v) * (one - u), i0, j0),
        _corner(F.lit(1), (one - v) * u, i0, j0 + 1),
        _corner(F.lit(2), v * (one - u), i0 + 1, j0),
        _corner(F.lit(3), v * u, i0 + 1, j0 + 1),
    )


def _cell(lines: Column, target: Column) -> tuple[Column, Column]:
    below = F.size(F.filter(lines, lambda line: line < target))
    start = F.least(F.greatest(below - 1, F.lit(0)), F.size(lines) - 2)
    low, high = F.get(lines, start), F.get(lines, start + 1)
    share = F.try_divide(target - low, high - low)
    return start, F.coalesce(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def _idw_corners(lats: Column, lons: Column, lat: Column, lon: Column) -> Column:
    """The four nearest lattice nodes, weighted by inverse squared distance.

    The four nearest nodes lie among the four lines on either side of the site
    on each axis, so at most 8 x 8 nodes are compared.
    """

    def window(lines: Column, target: Column) -> Column:
        below = F.size(F.filter(lines, lambda line: line < target))
        first = F.greatest(below - NEIGHBOURS, F.lit(0))
        last = F.least(below + NEIGHBOURS - 1, F.size(lines) - 1)
        return F.sequence(first, last)

    nodes = F.flatten(
        F.transform(
            window(lats, lat),
            lambda i: F.transform(
                window(lons, lon),
                lambda j: F.struct(
                    haversine_km(lat, lon, F.get(lats, i), F.get(lons, j), GRID_RADIUS_KM).alias("d"),
                    i.alias("i"),
                    j.alias("j"),
                ),
            ),
        )
    )
    best = F.slice(F.array_sort(nodes), 1, NEIGHBOURS)
    return F.transform(
        best,
        lambda node, k: _corner(k, F.lit(1.0) / F.greatest(node["d"] * node["d"], F.lit(1e-12)), node["i"], node["j"]),
    )


def interpolate_to_sites(
    forecasts: DataFrame,
    sites: DataFrame,
    variables,
    method: str = "bilinear",
    by=(LOCATION,),
    circular=CIRCULAR_GRID_VARIABLES,
    keep_native: bool = True,
    beside: DataFrame | None = None,
    points: DataFrame | None = None,
) -> DataFrame:
    """One row per (site, model, issue, target) with every variable at the site.

    Missing corners drop out and the other weights are renormalised; a value is
    null when no corner has one. Of several values on one node the smallest
    counts, whatever the read order. Groups without a site, and bilinear groups
    with fewer than four grid points, keep their native rows (`keep_native`).

    `beside` names one grid point per site (the columns of `sites` plus latitude
    and longitude). Its values come along as `{variable}_native`, from the same
    pass, and only targets that have both kinds are kept. `points` are the
    stored `grid_points` of the forecasts, if the caller has them already; the
    forecasts are then its stored `grid_nodes`.
    """
    by = list(by)
    by_node = forecasts if points is not None else grid_nodes(forecasts, variables, by)
    points = grid_points(by_node, by) if points is None else points
    eligible = sites
    if method == "bilinear":
        counts = points.select(*by, LAT, LON).distinct().groupBy(*by).count()
        eligible = sites.join(counts.where(F.col("count") >= 4), by, "left_semi")
    weights = corner_weights(points, eligible, method, by)
    site_cols = [c for c in sites.columns if c not in by]
    slots = NEIGHBOURS
    if beside is not None:
        extra_point = beside.join(points, [*by, LAT, LON])
        marked = extra_point.withColumns({"corner": F.lit(NEIGHBOURS), "weight": F.lit(0.0)})
        weights = weights.unionByName(marked.select(weights.columns))
        slots += 1
    needed = [*by, MODEL, ISSUE, TARGET, LEAD, LAT, LON, *variables]
    rows = by_node.select(*needed).join(weights, [*by, MODEL, LAT, LON])
    picks = [F.count_if(F.col("corner") < NEIGHBOURS).alias("_sampled"), F.count_if(F.col("corner") == NEIGHBOURS).alias("_beside")]
    for k in range(slots):
        at = F.col("corner") == k
        picks.append(F.max(F.when(at, F.col("weight"))).alias(f"_w{k}"))
        picks += [F.min(F.when(at, F.col(v))).alias(f"_{v}_{k}") for v in variables]
    nodes = rows.groupBy(*by, *site_cols, MODEL, ISSUE, TARGET, LEAD).agg(*picks)
    native_values = []
    if beside is not None:
        nodes = nodes.where((F.col("_sampled") > 0) & (F.col("_beside") > 0))
        native_values = [F.col(f"_{v}_{NEIGHBOURS}").alias(f"{v}_native") for v in variables]
    values = [
        weighted_mean(
            [(F.coalesce(F.col(f"_w{k}"), F.lit(0.0)), F.col(f"_{v}_{k}")) for k in range(NEIGHBOURS)], v in circular
        ).alias(v)
        for v in variables
    ]
    extra = [c for c in site_cols if c not in ("site_latitude", "site_longitude")]
    out = nodes.select(
        *by,
        *extra,
        MODEL,
        ISSUE,
        TARGET,
        LEAD,
        F.col("site_latitude").alias(LAT),
        F.col("site_longitude").alias(LON),
        *values,
        *native_values,
    )
    if not keep_native:
        return out
    native = forecasts.join(eligible.select(*by).distinct(), by, "left_anti")
    return out.unionByName(native.select([c for c in out.columns if c in native.columns]), allowMissingColumns=True)


def interpolation_report(forecasts: DataFrame, sites: DataFrame, by=(LOCATION,)) -> DataFrame:
    """One row: grid points, targets, mean of the sites' mean offsets, largest offset."""
    by = list(by)
    grid = forecasts.select(*by, LAT, LON).dropna(subset=[LAT, LON]).distinct()
    offsets = grid.join(sites, by).withColumn("_d", haversine_km("site_latitude", "site_longitude", LAT, LON, GRID_RADIUS_KM))
    per_site = offsets.groupBy(*[c for c in sites.columns]).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_d").alias("_mean"), F.max("_d").alias("_max")
    )
    return per_site.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("grid_points"),
        F.count(F.lit(1)).alias("target_points"),
        F.coalesce(F.avg("_mean"), F.lit(0.0)).alias("mean_offset_km"),
        F.coalesce(F.max("_max"), F.lit(0.0)).alias("max_offset_km"),
    )


def interpolate_points(
    grid: DataFrame,
    targets: DataFrame,
    method: str = "bilinear",
    by=(),
    value: str = "value",
    circular: bool = False,
    power: float = 2.0,
    k: int = 4,
) -> DataFrame:
    """Point semantics: null grid values are dropped first; irregular or incomplete cells fall back to IDW.

    `grid` has by, latitude, longitude and the value, `targets` by, latitude and
    longitude. One row per target that has any grid value in its group.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, expected one of {METHODS}")
    by = list(by)
    known = grid.select(*by, LAT, LON, F.col(value).alias("_value")).where(F.col("_value").isNotNull())
    # Several values at one point: the smallest counts, whatever the read order.
    known = materialize(known.groupBy(*by, LAT, LON).agg(F.min("_value").alias("_value")), "grid-values")
    targets = materialize(targets.select(*by, LAT, LON).distinct(), "targets")
    key = [*by, LAT, LON]
    if method == "nearest":
        hits = k_nearest(targets, known, 1, by, ["_value"], stored=True)
        return hits.select(*key, F.col("_value").alias("value"))
    cell = None
    if method == "bilinear":
        # Only targets without a complete cell, in a regular grid next to none, need their neighbours.
        found = _regular_cell(known, targets, by, circular).where("_complete").select(*key, F.col("_cell").alias("value"))
        cell = materialize(found, "cells")
        targets = materialize(targets.join(cell, key, "left_anti"), "targets")
    neighbours = k_nearest(targets, known, max(1, k), by, ["_value"], stored=True)
    inverse = F.lit(1.0) / F.pow("distance_km", F.lit(float(power)))
    exact = F.max(F.when((F.col("rank") == 1) & (F.col("distance_km") < 1e-9), F.col("_value")))
    mean = weighted_mean_agg(F.when(F.col("distance_km") >= 1e-9, inverse), F.col("_value"), circular, null_balanced=True)
    idw = neighbours.groupBy(*key).agg(F.coalesce(exact, mean).alias("_idw"))
    rest = idw.withColumnRenamed("_idw", "value")
    return rest if cell is None else rest.unionByName(cell)


def _regular_cell(known: DataFrame, targets: DataFrame, by: list[str], circular: bool) -> DataFrame:
    """Bilinear value of targets whose four corners exist on the inferred lattice."""
    k = [*by, "_k"]
    keyed, wanted = known.withColumn("_k", F.lit(0)), targets.withColumn("_k", F.lit(0))
    lat_step = grid_spacing(keyed, LAT, k).select(*k, F.col("spacing").alias("_sa"))
    lon_step = grid_spacing(keyed, LON, k).select(*k, F.col("spacing").alias("_so"))
    steps = lat_step.join(lon_step, k).where(F.col("_sa").isNotNull() & F.col("_so").isNotNull())
    nodes = keyed.join(steps, k).select(
        *k,
        F.bround(F.col(LAT) / F.col("_sa")).cast("bigint").alias("_i"),
        F.bround(F.col(LON) / F.col("_so")).cast("bigint").alias("_j"),
        F.struct(LAT, LON, "_value").alias("_node"),
    )
    nodes = nodes.groupBy(*k, "_i", "_j").agg(F.min("_node")["_value"].alias("_value"))
    sites = wanted.select(*k, LAT, LON).distinct().join(steps, k)
    i0, j0 = F.floor(F.col(LAT) / F.col("_sa")), F.floor(F.col(LON) / F.col("_so"))
    v = F.col(LAT) / F.col("_sa") - i0
    u = F.col(LON) / F.col("_so") - j0
    one = F.lit(1.0)
    corners = F.array(
        *[
            F.struct((i0 + di).alias("_i"), (j0 + dj).alias("_j"), (wa * wo).alias("_w"))
            for di, wa in ((0, one - v), (1, v))
            for dj, wo in ((0, one - u), (1, u))
        ]
    )
    found = sites.select(*k, LAT, LON, F.inline(corners)).join(nodes, [*k, "_i", "_j"])
    w, value = F.col("_w"), F.col("_value")
    if circular:
        x, y = F.sum(w * F.cos(F.radians(value))), F.sum(w * F.sin(F.radians(value)))
        mean = F.when((F.abs(x) >= 1e-12) | (F.abs(y) >= 1e-12), resultant_angle(x, y))
    else:
        mean = F.sum(w * value)
    return found.groupBy(*by, LAT, LON).agg(mean.alias("_cell"), (F.count(F.lit(1)) == 4).alias("_complete"))
