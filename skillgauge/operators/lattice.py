"""Grid lines from jittered coordinates, spacing, enclosing corners, lattice points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import AUDIT_RADIUS_KM, degree_half_widths, haversine_km
from ..schemas import LAT, LON
from ..session import materialize

SNAP_TOLERANCE_DEG = 0.02
# The regular lattice and the models that share it.
LATTICE_SPACING_DEG, LATTICE_LAT0, LATTICE_LON0 = 0.25, -90.0, -180.0
LATTICE_MODELS = ("ifs", "era5")


def coordinate_clusters(df: DataFrame, coordinate: str, by=(), tolerance: float = SNAP_TOLERANCE_DEG) -> DataFrame:
    """Chains of distinct coordinates with steps <= tolerance, as (by, centre, members).

    Coordinates are first summed up per small cell, inside which every step is
    below the tolerance. The window then runs over cells, whose number is
    bounded by the axis however many jittered coordinates there are.
    """
    by = list(by)
    distinct = df.select(*by, F.col(coordinate).alias("_x")).where(F.col("_x").isNotNull()).distinct()
    cells = distinct.groupBy(*by, F.floor(F.col("_x") / (tolerance / 8)).alias("_cell")).agg(
        F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.sum("_x").alias("_sum"), F.count("_x").alias("_n")
    )
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_cell")
    step = F.col("_low") - F.lag("_high").over(order)
    starts = cells.withColumn("_new", F.when(step <= tolerance, 0).otherwise(1))
    islands = starts.withColumn("_island", F.sum("_new").over(order))
    grouped = islands.groupBy(*by, "_island").agg(
        (F.sum("_sum") / F.sum("_n")).alias("centre"), F.sum("_n").alias("members")
    )
    return grouped.drop("_island")


def grid_spacing(df: DataFrame, coordinate: str, by=(), tolerance: float = SNAP_TOLERANCE_DEG) -> DataFrame:
    """Smallest gap between cluster centres, null unless all gaps are near-integer multiples of it."""
    by = list(by)
    centres = coordinate_clusters(df, coordinate, by, tolerance)
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("centre")
    gaps = centres.withColumn("_gap", F.col("centre") - F.lag("centre").over(order))
    wide = F.col("_gap") > tolerance
    stats = gaps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("lines"),
        F.min(F.when(wide, F.col("_gap"))).alias("_s"),
        F.collect_list(F.when(wide, F.col("_gap"))).alias("_gaps"),
    )
    multiple = lambda g: g / F.col("_s")
    # The relative part of the closeness test grows with the multiple.
    regular = F.forall(
        "_gaps", lambda g: F.abs(multiple(g) - F.rint(multiple(g))) <= F.lit(0.1) + F.lit(1e-5) * F.rint(multiple(g))
    )
    return stats.select(*by, "lines", F.when(regular, F.col("_s")).alias("spacing"))


def grid_lines(points: DataFrame, by=(), tolerance: float = SNAP_TOLERANCE_DEG) -> DataFrame:
    """One row per group with sorted arrays lat_lines and lon_lines.

    Both axes go through one clustering pass; the arrays hold one value per grid line.
    """
    by = list(by)
    axes = F.array(
        F.struct(F.lit(LAT).alias("_axis"), F.col(LAT).alias("_value")),
        F.struct(F.lit(LON).alias("_axis"), F.col(LON).alias("_value")),
    )
    long = points.select(*by, F.inline(axes))
    centres = coordinate_clusters(long, "_value", [*by, "_axis"], tolerance)
    lines = lambda axis: F.array_sort(F.collect_list(F.when(F.col("_axis") == axis, F.col("centre"))))
    return centres.groupBy(*by).agg(lines(LAT).alias("lat_lines"), lines(LON).alias("lon_lines"))


def line_index(value: Column, lines: Column) -> Column:
    """Zero-based position of the nearest line (the lower one on ties)."""
    ranked = F.transform(lines, lambda line, i: F.struct(F.abs(value - line).alias("gap"), i.alias("i")))
    return F.array_min(ranked)["i"]


def enclosing_corners(targets: DataFrame, cells: DataFrame, by=()) -> DataFrame:
    """The 4 (2 or 1 on a line) grid cells bracketing each target, none if any is missing.

    Per axis the greatest line <= target and the least line >= target are taken.
    """
    by = list(by)
    known = materialize(cells.select(*by, LAT, LON).distinct(), "cells")
    lines = known.groupBy(*by).agg(
        F.array_sort(F.collect_set(LAT)).alias("_lats"), F.array_sort(F.collect_set(LON)).alias("_lons")
    )
    sites = targets.select(*by, F.col(LAT).alias("target_latitude"), F.col(LON).alias("target_longitude")).distinct()
    if by:
        joined = sites.join(lines, by)
    else:
        joined = sites.withColumns({c: lines.select(c).scalar() for c in ("_lats", "_lons")})

    def bracket(lines_col: str, target: str) -> Column:
        below = F.array_max(F.filter(lines_col, lambda v: v <= F.col(target)))
        above = F.array_min(F.filter(lines_col, lambda v: v >= F.col(target)))
        return F.when(below.isNotNull() & above.isNotNull(), F.array_distinct(F.array(below, above)))

    framed = joined.withColumns(
        {"_la": bracket("_lats", "target_latitude"), "_lo": bracket("_lons", "target_longitude")}
    ).where(F.col("_la").isNotNull() & F.col("_lo").isNotNull())
    key = [*by, "target_latitude", "target_longitude"]
    wanted = framed.withColumn("_need", F.size("_la") * F.size("_lo"))
    wanted = wanted.select(*key, "_need", "_lo", F.explode("_la").alias(LAT)).select(
        *key, "_need", LAT, F.explode("_lo").alias(LON)
    )
    found = wanted.join(known, [*by, LAT, LON], "left_semi")
    packed = found.groupBy(*key, "_need").agg(F.collect_list(F.struct(LAT, LON)).alias("_corners"))
    complete = packed.where(F.size("_corners") == F.col("_need"))
    return complete.select(*key, F.inline("_corners"))


def lattice_points(centres: DataFrame, radius_km: float = 50.0, models=LATTICE_MODELS) -> DataFrame:
    """Lattice points in the square of half-width `radius_km` around every centre.

    `centres` has centre_latitude and centre_longitude; each point comes once per
    model with its distance. Points past a pole are clamped, longitudes wrap.
    """
    unknown = set(models) - set(LATTICE_MODELS)
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}, expected {LATTICE_MODELS}")
    if radius_km <= 0:
        raise ValueError("radius_km must be positive")
    lat, lon = F.col("centre_latitude"), F.col("centre_longitude")
    half_lat, half_lon = degree_half_widths(lat, radius_km, radius_km)

    def indices(centre: Column, half: Column, origin: float) -> Column:
        first = F.ceil((centre - half - origin) / LATTICE_SPACING_DEG)
        last = F.floor((centre + half - origin) / LATTICE_SPACING_DEG)
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    valid = centres.where(lat.between(-90, 90) & lon.between(-180, 180))
    rows = valid.withColumn("_i", F.explode(indices(lat, half_lat, LATTICE_LAT0)))
    rows = rows.withColumn("_j", F.explode(indices(lon, half_lon, LATTICE_LON0)))
    point_lat = F.least(F.greatest(F.col("_i") * LATTICE_SPACING_DEG + LATTICE_LAT0, F.lit(-90.0)), F.lit(90.0))
    point_lon = F.pmod(F.col("_j") * LATTICE_SPACING_DEG + LATTICE_LON0 + 180.0, F.lit(360.0)) - 180.0
    rows = rows.withColumns({"_plat": point_lat, "_plon": point_lon})
    distance = haversine_km(lat, lon, "_plat", "_plon", AUDIT_RADIUS_KM)
    return rows.select(
        *centres.columns,
        F.round("_plat", 3).alias(LAT),
        F.round("_plon", 3).alias(LON),
        F.round(distance, 1).alias("distance_km"),
        F.explode(F.array(*[F.lit(m) for m in models])).alias("model"),
    )


def lattice_summary(points: DataFrame, by=("centre_latitude", "centre_longitude")) -> DataFrame:
    """Counts per model, unique positions, distance and coordinate ranges per centre."""
    return points.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_points"),
        *[F.count_if(F.col("model") == m).alias(f"{m}_points") for m in LATTICE_MODELS],
        F.count_distinct(LAT, LON).alias("unique_positions"),
        F.min("distance_km").alias("min_distance_km"),
        F.max("distance_km").alias("max_distance_km"),
        F.min(LAT).alias("min_latitude"),
        F.max(LAT).alias("max_latitude"),
        F.min(LON).alias("min_longitude"),
        F.max(LON).alias("max_longitude"),
    )
