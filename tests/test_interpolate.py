from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillgauge.functions.geo import degree_half_widths, snap_to_grid, snap_to_lines
from skillgauge.operators import interpolate, lattice, sites

CELL = [(55.50, 12.50, 10.0), (55.50, 12.75, 20.0), (55.75, 12.50, 30.0), (55.75, 12.75, 40.0)]
SCHEMA = "location_id string, model string, latitude double, longitude double, t int, x double"


def forecasts(spark, rows, variable="x"):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select(
        "location_id", "model", "latitude", "longitude",
        F.timestamp_seconds(F.col("t") * 3600).alias("forecast_issue_time"), F.timestamp_seconds(F.col("t") * 3600).alias("forecast_target_time"),
        F.lit(0).alias("lead_hours"), F.col("x").alias(variable),
    )


def cell(spark, values=(10.0, 20.0, 30.0, 40.0), times=(0,), variable="x"):
    rows = [("s", "m", la, lo, t, v) for t in times for (la, lo, _), v in zip(CELL, values, strict=True)]
    return forecasts(spark, rows, variable)


def site(spark, lat, lon, name="s"):
    return spark.createDataFrame([(name, lat, lon)], "location_id string, site_latitude double, site_longitude double")


def value(spark, grid, lat, lon, method="bilinear", variable="x"):
    return [r[variable] for r in interpolate.interpolate_to_sites(grid, site(spark, lat, lon), [variable], method).orderBy("forecast_target_time").collect()]


def test_centre_nodes_and_edges(spark):
    grid = cell(spark)
    assert value(spark, grid, 55.625, 12.625) == pytest.approx([25.0])
    for la, lo, v in CELL:
        assert value(spark, grid, la, lo) == pytest.approx([v])
    # Outside the grid the value is clamped to the edge cell.
    assert value(spark, grid, 50.0, 12.625) == pytest.approx([15.0])


@pytest.mark.parametrize("method", interpolate.METHODS)
def test_uniform_field_and_bounds(spark, method):
    assert value(spark, cell(spark, (7.0,) * 4), 55.6, 12.7, method) == pytest.approx([7.0])
    got = value(spark, cell(spark), 55.6, 12.7, method)[0]
    assert 10.0 <= got <= 40.0


def test_missing_corner_renormalises_and_empty_is_null(spark):
    assert value(spark, cell(spark, (10.0, None, 30.0, None)), 55.625, 12.625) == pytest.approx([20.0])
    assert value(spark, cell(spark, (None,) * 4), 55.625, 12.625) == [None]


def test_directions_average_over_north(spark):
    grid = cell(spark, (350.0, 10.0, 350.0, 10.0), variable="wind_direction_10m")
    got = value(spark, grid, 55.625, 12.625, variable="wind_direction_10m")[0]
    assert min(got, 360 - got) == pytest.approx(0.0, abs=1e-9)
    assert value(spark, grid.withColumnRenamed("wind_direction_10m", "x"), 55.625, 12.625) == pytest.approx([180.0])


def test_jitter_collapses_to_lines_and_times_stay_apart(spark):
    rows = [("s", "m", la + j, lo - j, t, v + t) for t in (0, 1, 2) for la, lo, v in CELL for j in (0.001 * t,)]
    got = value(spark, forecasts(spark, rows), 55.625, 12.625)
    assert got == pytest.approx([25.0, 26.0, 27.0], abs=0.2)


def test_idw_equals_formula(spark):
    d = [6371.0 * 2 * np.arcsin(np.sqrt(np.sin(np.radians(la - 55.55) / 2) ** 2 + np.cos(np.radians(55.55)) * np.cos(np.radians(la)) * np.sin(np.radians(lo - 12.6) / 2) ** 2)) for la, lo, _ in CELL]
    w = 1 / np.square(d)
    assert value(spark, cell(spark), 55.55, 12.6, "idw") == pytest.approx([float(np.dot(w, [10, 20, 30, 40]) / w.sum())])
    assert value(spark, cell(spark), 55.55, 12.6, "nearest") == pytest.approx([10.0])


def test_sparse_or_siteless_groups_keep_native_rows(spark):
    grid = cell(spark).unionByName(forecasts(spark, [("other", "m", 1.0, 1.0, 0, 5.0), ("thin", "m", 1.0, 1.0, 0, 6.0), ("thin", "m", 2.0, 1.0, 0, 7.0)]))
    places = site(spark, 55.625, 12.625).unionByName(site(spark, 1.5, 1.0, "thin"))
    out = interpolate.interpolate_to_sites(grid, places, ["x"])
    assert sorted((r.location_id, round(r.x, 6)) for r in out.collect()) == [("other", 5.0), ("s", 25.0), ("thin", 6.0), ("thin", 7.0)]
    report = interpolate.interpolation_report(grid, places).first()
    assert (report.grid_points, report.target_points) == (6, 2) and report.max_offset_km > report.mean_offset_km > 0


def test_two_models_use_their_own_grids(spark):
    other = forecasts(spark, [("s", "coarse", la, lo, 0, 100.0) for la in (55.0, 56.0) for lo in (12.0, 13.0)])
    out = interpolate.interpolate_to_sites(cell(spark).unionByName(other), site(spark, 55.625, 12.625), ["x"])
    assert {r.model: round(r.x, 6) for r in out.collect()} == {"m": 25.0, "coarse": 100.0}


def test_corner_ids_collapse(spark):
    df = spark.createDataFrame([("berlin__gfs__c1",), ("oslo",)], "location_id string")
    assert [r[0] for r in interpolate.collapse_corners(df).collect()] == ["berlin", "oslo"]


def point(spark, rows, lat, lon, method="bilinear", **kw):
    grid = spark.createDataFrame(rows, "latitude double, longitude double, value double")
    target = spark.createDataFrame([(lat, lon)], "latitude double, longitude double")
    return [r.value for r in interpolate.interpolate_points(grid, target, method, **kw).collect()]


def test_point_semantics(spark):
    assert point(spark, CELL, 55.625, 12.625) == pytest.approx([25.0])
    assert point(spark, CELL, 55.5, 12.5, "idw") == [10.0]
    assert point(spark, CELL, 55.51, 12.74, "nearest") == [20.0]
    # A missing corner and an irregular grid fall back to inverse distance.
    fallback = point(spark, CELL[:3] + [(55.75, 12.75, None)], 55.625, 12.625)
    assert fallback == pytest.approx(point(spark, CELL[:3], 55.625, 12.625, "idw"))
    assert point(spark, CELL, 55.9, 12.9) == pytest.approx(point(spark, CELL, 55.9, 12.9, "idw"))
    assert point(spark, [(55.5, 12.5, 350.0), (55.5, 12.75, 10.0), (55.75, 12.5, 350.0), (55.75, 12.75, 10.0)], 55.625, 12.625, circular=True)[0] % 360 == pytest.approx(0.0, abs=1e-9)
    assert point(spark, [(55.5, 12.5, None)], 55.5, 12.5) == []
    with pytest.raises(ValueError):
        point(spark, CELL, 0.0, 0.0, "cubic")


def test_clusters_and_spacing(spark):
    lats = [base + 0.004 * j for base in (55.0, 55.25, 55.5, 56.0) for j in range(5)]
    df = spark.createDataFrame([(v,) for v in lats], "latitude double")
    centres = sorted(r.centre for r in lattice.coordinate_clusters(df, "latitude").collect())
    assert centres == pytest.approx([55.008, 55.258, 55.508, 56.008])
    assert lattice.grid_spacing(df, "latitude").first().spacing == pytest.approx(0.25)
    odd = spark.createDataFrame([(0.0,), (1.0,), (2.4,)], "latitude double")
    assert lattice.grid_spacing(odd, "latitude").first().spacing is None


def test_enclosing_corners(spark):
    cells = spark.createDataFrame([(la, lo) for la in (0.0, 1.0) for lo in (0.0, 1.0)], "latitude double, longitude double")
    target = lambda la, lo: spark.createDataFrame([(la, lo)], "latitude double, longitude double")
    assert lattice.enclosing_corners(target(0.5, 0.5), cells).count() == 4
    assert lattice.enclosing_corners(target(1.0, 0.5), cells).count() == 2
    assert lattice.enclosing_corners(target(1.0, 0.0), cells).count() == 1
    assert lattice.enclosing_corners(target(1.5, 0.5), cells).count() == 0
    assert lattice.enclosing_corners(target(0.5, 0.5), cells.where("latitude + longitude < 2")).count() == 0


def test_lattice_points(spark):
    centre = spark.createDataFrame([(55.68, 12.57), (89.9, 0.0), (0.0, 180.0)], "centre_latitude double, centre_longitude double")
    points = lattice.lattice_points(centre, 30.0).cache()
    assert points.where("latitude > 90 OR longitude < -180 OR longitude >= 180").count() == 0
    summary = {r.centre_latitude: r for r in lattice.lattice_summary(points).collect()}
    assert summary[55.68].ifs_points == summary[55.68].era5_points and summary[55.68].total_points == 2 * summary[55.68].unique_positions
    with pytest.raises(ValueError):
        lattice.lattice_points(centre, 30.0, ["gfs"])
    with pytest.raises(ValueError):
        lattice.lattice_points(centre, 0.0)


def test_scalar_geometry(spark):
    df = spark.createDataFrame([(0.0,), (60.0,), (90.0,)], "lat double")
    lat_w, lon_w = degree_half_widths("lat", 111.195, 111.195)
    rows = df.select(lat_w.alias("a"), lon_w.alias("o")).collect()
    assert rows[0].a == pytest.approx(1.0, abs=1e-3) and rows[1].o == pytest.approx(2.0, abs=1e-3) and rows[2].o == 180.0
    snapped = spark.createDataFrame([(0.125,), (0.375,), (0.13,)], "v double").select(snap_to_grid("v", 0.25)).collect()
    assert [r[0] for r in snapped] == [0.0, 0.5, 0.25]
    lines = F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0))
    got = spark.createDataFrame([(0.5,), (1.6,), (9.0,)], "v double").select(snap_to_lines("v", lines)).collect()
    assert [r[0] for r in got] == [0.0, 2.0, 2.0]


def test_site_error_table(spark):
    grid = cell(spark, times=(0, 1)).drop("location_id")
    obs = spark.createDataFrame([(55.625, 12.625, 0, 24.0), (55.625, 12.625, 5, 1.0)], "latitude double, longitude double, t int, x double")
    obs = obs.withColumn("observation_time", F.timestamp_seconds(F.col("t") * 3600)).drop("t")
    row = sites.site_error_table(grid, obs, ["x"]).collect()
    # Meridians converge, so the northern corners are nearer; of the two the western one counts.
    assert len(row) == 1 and row[0].x_interp_error == pytest.approx(1.0) and row[0].x_native_error == pytest.approx(6.0)
    gain = sites.site_gain(sites.site_error_table(grid, obs, ["x"]), "x").first()
    assert gain.improvement == pytest.approx(5.0)
