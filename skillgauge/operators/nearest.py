"""Exact nearest-point search by descent through cells, never by a cross product.

Points are counted in cells of three sizes, 15 degrees, 1 degree and a fifteenth
of a degree (about 7 km). A target compares itself with the at most 288 largest
cells, then with the at most 225 cells inside each of those that can still hold a
neighbour, and so on, and finally with the points of the few smallest cells left.
A cell is dropped when its closest possible point is farther than the distance
within which k points are certain.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import GRID_RADIUS_KM, haversine_km, meridian_distance_km
from ..schemas import LAT, LON
from ..session import materialize

# Cell sizes in degrees; each divides the one before, and all divide 180.
LEVELS = (15.0, 1.0, 1.0 / 15.0)
# Slack in kilometres for rounding in the bounds.
SLACK_KM = 1e-6


def _row(lat: Column, size: float) -> Column:
    """Cell row; the pole belongs to the last one."""
    return F.least(F.floor((lat + 90.0) / size), F.lit(round(180 / size) - 1)).cast("int")


def _column(lon: Column, size: float) -> Column:
    return F.pmod(F.floor((lon + 180.0) / size), F.lit(round(360 / size))).cast("int")


def _bounds(row: Column, column: Column, size: float, radius: float) -> tuple[Column, Column]:
    """Least and greatest possible distance from the target to any point of a cell."""
    lat, lon = F.col(LAT), F.col(LON)
    south, west = row * size - 90.0, column * size - 180.0
    mid_lat, mid_lon = south + size / 2, west + size / 2
    past_lat = F.greatest(F.lit(0.0), F.abs(lat - mid_lat) - size / 2)
    apart = F.abs(F.pmod(lon - mid_lon + 180.0, F.lit(360.0)) - 180.0)
    past_lon = F.greatest(F.lit(0.0), apart - size / 2)
    nearest = F.greatest(F.radians(past_lat) * radius, meridian_distance_km(lat, past_lon, radius)) - SLACK_KM
    reach = radius * math.radians(size) * math.sqrt(0.5)
    farthest = haversine_km(lat, lon, mid_lat, mid_lon, radius) + reach + SLACK_KM
    return nearest, farthest


def _bounded(cells: str, size: float, radius: float) -> Column:
    """Cells (r, c, n) with their distance bounds."""

    def bound(cell: Column) -> Column:
        near, far = _bounds(cell["r"], cell["c"], size, radius)
        return F.struct(far.alias("far"), near.alias("near"), cell["n"].alias("n"), cell["r"].alias("r"), cell["c"].alias("c"))

    return F.transform(cells, bound)


def _certain(bounded: str, k: int) -> Column:
    """Distance within which the cells certainly hold k points; infinite if they hold fewer."""

    def step(acc: Column, cell: Column) -> Column:
        reached = (acc["seen"] < k) & (acc["seen"] + cell["n"] >= k)
        return F.struct(
            (acc["seen"] + cell["n"]).alias("seen"), F.when(reached, cell["far"]).otherwise(acc["limit"]).alias("limit")
        )

    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(float("inf")).alias("limit"))
    return F.aggregate(F.array_sort(bounded), start, step)["limit"]


def _possible(bounded: str) -> Column:
    return F.filter(bounded, lambda cell: cell["near"] <= F.col("_limit"))


def k_nearest(
    targets: DataFrame, points: DataFrame, k: int = 1, by=(), payload=(), radius: float = GRID_RADIUS_KM, stored: bool = False
) -> DataFrame:
    """The k nearest points of every distinct target, within equal `by` keys.

    `targets` has `by`, latitude, longitude; `points` the same plus `payload`.
    Result: by, latitude, longitude of the target, rank (1 = nearest),
    point_latitude, point_longitude, payload, distance_km. Ties go to the lower
    latitude, then longitude, then payload. A target with fewer than k points in
    its group gets all of them; one without any gets no row. With `stored` both
    inputs are tables already, otherwise they are stored first.
    """
    by, payload = list(by), list(payload)
    key = [*by, LAT, LON]
    # The points serve the cell counts and the last join, so they are stored, not derived twice.
    keep = (lambda df, name: df) if stored else materialize
    wanted = keep(targets.select(*key).dropna(subset=[LAT, LON]).distinct(), "targets")
    placed = points.dropna(subset=[LAT, LON]).select(
        *by, F.col(LAT).alias("point_latitude"), F.col(LON).alias("point_longitude"), *payload
    )
    placed = keep(placed, "points")
    lat, lon = F.col("point_latitude"), F.col("point_longitude")
    cell = lambda level: [f"_row{level}", f"_col{level}"]
    placed = placed.withColumns({n: e for level, size in enumerate(LEVELS) for n, e in zip(cell(level), (_row(lat, size), _column(lon, size)), strict=True)})
    last = len(LEVELS) - 1
    counts = placed.groupBy(*by, *[c for level in range(last + 1) for c in cell(level)]).agg(F.count(F.lit(1)).alias("_n"))

    def inside(level: int, parent: list[str]) -> DataFrame:
        """Cells of a level as one list per cell of the level above (225 at most)."""
        sums = counts.groupBy(*by, *parent, *cell(level)).agg(F.sum("_n").alias("_n"))
        row, column = cell(level)
        return sums.groupBy(*by, *parent).agg(F.collect_list(F.struct(F.col(row).alias("r"), F.col(column).alias("c"), F.col("_n").alias("n"))).alias("_cells"))

    top = inside(0, [])
    frontier = wanted.join(top, by) if by else wanted.withColumn("_cells", top.scalar())
    frontier = frontier.withColumn("_limit", F.lit(float("inf")))
    for level, size in enumerate(LEVELS):
        if level:
            frontier = frontier.join(inside(level, cell(level - 1)), [*by, *cell(level - 1)])
        frontier = frontier.withColumn("_b", _bounded("_cells", size, radius))
        certain = _certain("_b", k)
        if level:
            # The cells of a target that are left, at most 225 of each cell before, bound its window.
            certain = F.min(certain).over(Window.partitionBy(*key))
        frontier = frontier.withColumn("_limit", F.least("_limit", certain))
        frontier = frontier.select(*key, "_limit", F.explode(_possible("_b")).alias("_k"))
        row, column = cell(level)
        frontier = frontier.select(*key, "_limit", F.col("_k.r").alias(row), F.col("_k.c").alias(column))
    upper = [c for level in range(last) for c in cell(level)]
    pairs = frontier.join(placed.drop(*upper), [*by, *cell(last)]).withColumn(
        "distance_km", haversine_km(LAT, LON, "point_latitude", "point_longitude", radius)
    )
    order = Window.partitionBy(*key).orderBy("distance_km", "point_latitude", "point_longitude", *payload)
    best = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(*key, "rank", "point_latitude", "point_longitude", *payload, "distance_km")


def nearest_point(targets: DataFrame, points: DataFrame, by=(), radius: float = GRID_RADIUS_KM) -> DataFrame:
    """Nearest distinct point of every distinct target, with its distance."""
    distinct = points.select(*by, LAT, LON).distinct()
    return k_nearest(targets, distinct, 1, by, radius=radius).drop("rank")
