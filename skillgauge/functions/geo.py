"""Great-circle geometry and grid snapping as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius used for location audits and for interpolation.
AUDIT_RADIUS_KM = 6371.0088
GRID_RADIUS_KM = 6371.0


def _col(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(float(x)))


def haversine_km(lat1, lon1, lat2, lon2, radius: float = AUDIT_RADIUS_KM) -> Column:
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * radius) * F.asin(F.sqrt(chord))


def degree_half_widths(lat, km_lat, km_lon, radius: float = AUDIT_RADIUS_KM) -> tuple[Column, Column]:
    """Half-widths in degrees of a box of the given kilometres around `lat`."""
    per_degree = radius * math.pi / 180.0
    shrink = F.abs(F.cos(F.radians(_col(lat))))
    lat_deg = _col(km_lat) / F.lit(per_degree)
    lon_deg = F.when(shrink < 1e-6, F.lit(180.0)).otherwise(_col(km_lon) / (F.lit(per_degree) * shrink))
    return lat_deg, lon_deg


def snap_to_grid(value, spacing) -> Column:
    """Nearest multiple of `spacing`; ties go to the even multiple."""
    return F.bround(_col(value) / _col(spacing)) * _col(spacing)


def snap_to_lines(value, lines) -> Column:
    """Nearest entry of a sorted array of line coordinates (lower on ties)."""
    value = _col(value)
    ranked = F.transform(_col(lines), lambda line: F.struct(F.abs(value - line).alias("gap"), line.alias("line")))
    return F.array_min(ranked)["line"]


def meridian_distance_km(lat, delta_lon, radius: float = GRID_RADIUS_KM) -> Column:
    """Shortest distance from latitude `lat` to a meridian `delta_lon` degrees away."""
    bounded = F.least(_col(delta_lon), F.lit(90.0))
    return F.lit(radius) * F.asin(F.abs(F.cos(F.radians(_col(lat)))) * F.sin(F.radians(bounded)))
