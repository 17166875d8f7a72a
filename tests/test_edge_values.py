"""Nulls in keys, infinities, large means, chunks of several months, and partitions read by an upsert."""

from __future__ import annotations

import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from skillgauge.operators import align, metrics, planning, quantiles, regime
from skillgauge.sinks import upsert


def test_null_elevations_match(spark):
    schema = "latitude double, longitude double, elevation double, t string"
    f = spark.createDataFrame([(1.0, 2.0, None, "2024-01-01"), (3.0, 4.0, 5.0, "2024-01-01"), (3.0, 4.0, None, "2024-01-01")], schema)
    forecasts = f.select("latitude", "longitude", "elevation", F.col("t").cast("timestamp").alias("forecast_target_time"), F.lit(1.0).alias("x"))
    observations = f.where("t IS NOT NULL").limit(2).select("latitude", "longitude", "elevation", F.col("t").cast("timestamp").alias("observation_time"), F.lit(2.0).alias("x"))
    out = {(r.latitude, r.elevation): r.observed_x for r in align.align(forecasts, observations, ["x"], point_keys=True).collect()}
    assert out == {(1.0, None): 2.0, (3.0, 5.0): 2.0, (3.0, None): None}


def test_quantiles_with_infinities(spark):
    values = [-math.inf, -1.0, 0.0, 2.0, math.inf]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.percentile: r.value for r in quantiles.exact_quantiles(df, "v", [0, 25, 50, 75, 100]).collect()}
    assert got == {0: -math.inf, 25: -1.0, 50: 0.0, 75: 2.0, 100: math.inf}
    nan = spark.createDataFrame([(1.0,), (2.0,), (math.nan,)], "v double")
    assert {r.percentile: r.value for r in quantiles.exact_quantiles(nan, "v", [0, 50]).collect()} == {0: 1.0, 50: 2.0}


def test_std_at_a_large_mean(spark):
    rows = [("a" if i % 2 else "b", i % 3, 1e8 + i % 7) for i in range(84)]
    df = spark.createDataFrame(rows, "model string, lead_hours int, x_error double")
    out = metrics.metrics_by_grouping_sets(df, [["model"], ["lead_hours"], []], ["x"], ["std"]).collect()
    got = {(r.model, r.lead_hours): r.metric_value for r in out}
    for model, lead in (("a", None), ("b", None), (None, 0), (None, 2), (None, None)):
        mine = [e for m, n, e in rows if model in (None, m) and lead in (None, n)]
        assert got[model, lead] == pytest.approx(statistics.stdev(mine), rel=1e-9)


def test_chunks_report_each_missing_month(spark):
    places = spark.createDataFrame([("Here", 1.0, 2.0)], "name string, latitude double, longitude double")
    plan = planning.coverage_plan(places, ["m"], "2024-01-01", "2024-04-30", kinds=["historical_forecast", "observations"], months=2)
    stock = spark.createDataFrame([("here", "m", 2024, 1), ("here", "m", 2024, 3), ("here", "m", 2024, 4), ("here", None, 2024, 2)], "location_id string, model string, year int, month int")
    got = {(r.kind, str(r.chunk_start)): r.missing_months for r in planning.uncovered(plan, stock).collect()}
    assert got == {
        ("historical_forecast", "2024-01-01"): [dt.date(2024, 2, 1)],
        ("observations", "2024-01-01"): [dt.date(2024, 1, 1)],
        ("observations", "2024-03-01"): [dt.date(2024, 3, 1), dt.date(2024, 4, 1)],
    }


def test_rules_for_null_contexts(spark):
    rules = regime.rule_table(spark, [regime.rule("season", "DJF", "t", ["a"])])
    contexts = spark.createDataFrame([(1, "t", "DJF", None), (2, "t", None, None)], "context_id int, variable string, season string, region string")
    entries = spark.createDataFrame(
        [("b", "t", 24, "DJF", "", "mae", 1.0, 1.0, True)],
        "model string, variable string, lead_hours int, season string, region string, metric_type string, value double, coverage_fraction double, is_stable boolean",
    )
    out = {r.context_id: [m.model for m in r.selected_models] for r in regime.select_models(contexts, rules, ["a", "b"], entries).collect()}
    assert out == {1: ["a"], 2: ["b"]}


def test_upsert_reads_touched_partitions_only(spark, tmp_path):
    root = str(tmp_path / "obs")

    def rows(month):
        time = F.lit(f"2024-{month:02d}-03").cast("timestamp").alias("observation_time")
        return spark.range(1).select(time, F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), F.lit(float(month)).alias("x"))

    for month in (1, 2, 3):
        upsert.upsert_observations(rows(month), root)
    batch = rows(2).select(F.year("observation_time").alias("year"), F.month("observation_time").alias("month"))
    old = upsert.existing(spark, root, batch, ("year", "month"))
    plan = old._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "month#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert [r.x for r in old.collect()] == [2.0] and len(old.inputFiles()) >= 1
    assert upsert.upsert_observations(rows(2), root) == 1 and spark.read.parquet(root).count() == 3


def grid_and_site(spark):
    t = F.lit("2024-01-01").cast("timestamp")
    corners = [("s__m__c0", 0.0, 0.0, 1.0), ("s__m__c1", 0.0, 1.0, 3.0), ("s__m__c2", 1.0, 0.0, 5.0), ("s__m__c3", 1.0, 1.0, 7.0), ("far", 9.0, 9.0, 4.0)]
    grid = spark.createDataFrame(corners, "location_id string, latitude double, longitude double, x double")
    forecasts = grid.select("*", t.alias("forecast_issue_time"), t.alias("forecast_target_time"), F.lit(0).alias("lead_hours"), F.lit("m").alias("model"))
    sites = spark.createDataFrame([("s", 0.5, 0.5, 4.5), ("far", 9.0, 9.0, 4.0)], "location_id string, latitude double, longitude double, x double")
    return forecasts, sites.withColumn("observation_time", t)


def test_builder_interpolates_and_refuses_distant_places(spark):
    forecasts, observations = grid_and_site(spark)
    ids = [r.location_id for r in forecasts.select(F.col("location_id")).collect()]
    assert len(ids) == 5
    out = {r.location_id: r for r in align.build_verification(forecasts, observations, ["x"], interpolate="bilinear", max_km=50).collect()}
    assert (out["s"].forecast_x, out["s"].observed_x, out["s"].x_error) == (4.0, 4.5, -0.5)
    assert out["far"].forecast_x == 4.0  # one grid point: native value
    moved = observations.withColumn("latitude", F.col("latitude") + F.when(F.col("location_id") == "far", 20).otherwise(0))
    with pytest.raises(ValueError, match="km from any observation"):
        align.build_verification(forecasts, moved, ["x"], interpolate="bilinear", max_km=50)
    with pytest.raises(ValueError, match="location_id"):
        align.build_verification(forecasts, observations.drop("location_id"), ["x"], max_km=50)
    with pytest.raises(ValueError, match="without observations"):
        align.build_verification(forecasts, observations, ["x"], max_km=50)


def test_strict_alignment_refuses_empty_inputs(spark):
    f = spark.createDataFrame([], "latitude double, longitude double, valid_time timestamp, variable string, lead_hours int, run_time timestamp, model string, value double")
    assert align.align_records(f, f).count() == 0
    with pytest.raises(ValueError, match="nothing to align"):
        align.align_records(f, f, strict=True)
