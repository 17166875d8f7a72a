from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skillgauge.operators import align, locations, planning, quality, sequence

T0 = "2024-01-01 {:02d}:00:00"


def stamp(df, *columns):
    return df.withColumns({c: F.to_timestamp(c) for c in columns})


@pytest.fixture(scope="module")
def pair(spark):
    f = [(T0.format(i), T0.format(t), t - i, "m", 55.7, 12.6, 5.0, float(t)) for i in (0, 6, 12) for t in (6, 12, 18) if t > i]
    o = [(T0.format(t), 55.7, 12.6, 5.0, t + 0.5) for t in (6, 12)]
    forecasts = spark.createDataFrame(f, "forecast_issue_time string, forecast_target_time string, lead_hours int, model string, latitude double, longitude double, elevation double, temperature_2m double")
    observations = spark.createDataFrame(o, "observation_time string, latitude double, longitude double, elevation double, temperature_2m double")
    return stamp(forecasts, "forecast_issue_time", "forecast_target_time"), stamp(observations, "observation_time")


def test_every_forecast_survives(pair):
    out = align.build_verification(*pair, ["temperature_2m"])
    assert out.count() == 6
    assert out.where("observation_time IS NULL").count() == 3
    assert {r[0] for r in out.where("temperature_2m_error IS NOT NULL").select("temperature_2m_error").collect()} == {-0.5}
    assert out.columns[:9] == ["forecast_issue_time", "forecast_target_time", "observation_time", "lead_hours", "model", "latitude", "longitude", "elevation", "location_id"]


def test_location_keys(spark, pair):
    f, o = pair
    named = (f.withColumn("location_id", F.lit("a")), o.withColumn("location_id", F.lit("b")))
    assert align.align(*named, ["temperature_2m"]).where("observation_time IS NOT NULL").count() == 0
    unnamed = tuple(df.withColumn("location_id", F.lit(None).cast("string")) for df in pair)
    assert align.align(*unnamed, ["temperature_2m"]).where("observation_time IS NOT NULL").count() == 3
    moved = o.unionByName(o.withColumn("latitude", F.lit(60.0)))
    assert align.align(f, moved, ["temperature_2m"]).count() == 6


def test_full_outer_statuses(spark):
    cols = "latitude double, longitude double, valid_time string, variable string, value double"
    f = stamp(spark.createDataFrame([(1.0, 2.0, T0.format(0), "t", 1.0), (1.0, 2.0, T0.format(1), "t", 2.0), (1.0, 2.0, T0.format(1), "t", 3.0)], cols), "valid_time")
    f = f.withColumns({"lead_hours": F.lit(6), "run_time": F.col("valid_time") - F.expr("interval 6 hours"), "model": F.lit("m")})
    o = stamp(spark.createDataFrame([(1.0, 2.0, T0.format(1), "t", 5.0), (1.0, 2.0, T0.format(2), "t", 5.0)], cols), "valid_time")
    out = align.align_records(f, o)
    assert {r.match_status: r["count"] for r in out.groupBy("match_status").count().collect()} == {"matched": 2, "forecast_only": 1, "observation_only": 1}
    assert sorted(r.error for r in align.fully_matched(out).collect()) == [-3.0, -2.0]
    overlap = align.run_overlap(f.unionByName(f.withColumn("run_time", F.col("run_time") - F.expr("interval 6 hours"))))
    assert overlap.where("num_runs = 2").count() == 2


def test_gaps_across_months_in_a_hot_location(spark):
    # Hourly for 100 days with three holes, one of them over a month's end, plus copies.
    hours = [h for h in range(24 * 100) if h not in (50, 51) and not 24 * 31 - 3 <= h < 24 * 31 + 2 and h != 2000]
    df = spark.createDataFrame([(h,) for h in hours + hours[:500]], "h int")
    df = df.select(F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), F.timestamp_seconds(F.lit(1704067200) + F.col("h") * 3600).alias("observation_time"))
    lone = df.limit(1).withColumn("latitude", F.lit(9.0))
    gaps = sorted(r.gap_hours for r in sequence.time_gaps(df.unionByName(lone)).collect())
    assert gaps == [2.0, 3.0, 6.0]
    summary = sequence.gap_summary(df).first()
    assert (summary.gaps, summary.keys_with_gaps, summary.longest_gap_hours) == (3, 1, 6.0)


def test_persistence_carries_over_months(spark):
    df = spark.createDataFrame([("s", d, float(i)) for i, d in enumerate(["2024-01-30", "2024-01-31", "2024-02-01", "2024-04-01"])], "location_id string, d string, v double")
    out = sequence.persistence(df.withColumn("observation_time", F.to_timestamp("d")), ["location_id"], "v")
    assert [r.persistence_forecast for r in out.orderBy("forecast_target_time").collect()] == [None, 0.0, 1.0, 2.0]


@pytest.fixture(scope="module")
def ten(spark):
    rows = [(T0.format(0), T0.format(h), T0.format(h), h, "m", 1.0, 2.0, 15.0, 16.0) for h in range(10)]
    df = spark.createDataFrame(rows, "forecast_issue_time string, forecast_target_time string, observation_time string, lead_hours int, model string, latitude double, longitude double, forecast_temperature_2m double, observed_temperature_2m double")
    return stamp(df, "forecast_issue_time", "forecast_target_time", "observation_time")


def issues(df):
    return {r.check: (r.severity, r["count"]) for r in df.collect()}


def test_clean_table_has_only_infos(ten):
    assert {s for s, _ in issues(quality.validate_verification(ten, ["temperature_2m"])).values()} == {"info"}
    assert quality.require_provenance(ten) is ten


def test_seeded_violations_are_counted(ten):
    bad = ten.unionByName(ten.limit(2)).unionByName(ten.limit(1).withColumns({"lead_hours": F.lit(-5), "observed_temperature_2m": F.lit(-999.0), "forecast_temperature_2m": F.lit(288.0)}))
    found = issues(quality.validate_verification(bad, ["temperature_2m"]))
    assert found["provenance_uniqueness"] == ("error", 3)
    assert found["duplicate_observations"][0] == "error" and found["duplicate_observations"][1] == 4
    assert found["lead_times"] == ("error", 1)
    assert found["value_ranges"] == ("error", 2)
    with pytest.raises(ValueError):
        quality.require_provenance(bad)


def test_missing_observation_levels(ten):
    for missing, level in ((1, "info"), (2, "warning"), (6, "error")):
        part = ten.withColumn("observation_time", F.when(F.col("lead_hours") >= missing, F.col("observation_time")))
        assert issues(quality.check_missing_observations(part))["missing_observations"] == (level, missing)


def test_row_rules_split(ten):
    bad = ten.withColumn("latitude", F.when(F.col("lead_hours") == 3, 91.0).otherwise(F.col("latitude")))
    good, quarantined = quality.split_rows(bad)
    assert good.count() == 9 and [r.violated_rule for r in quarantined.collect()] == ["latitude_range"]


def test_locations_fail_closed(spark):
    at = lambda lat, lon, *i: spark.createDataFrame([(lat, lon, *i)], "latitude double, longitude double" + (", location_id string" if i else ""))
    near = locations.require_compatible(at(55.7, 12.6), at(55.75, 12.65)).first()
    assert near.max_nearest_distance_km < 10
    with pytest.raises(ValueError):
        locations.require_compatible(at(55.7, 12.6), at(52.5, 13.4))
    two = at(55.7, 12.6).unionByName(at(55.8, 12.6))
    with pytest.raises(ValueError):
        locations.require_compatible(two, at(55.7, 12.6))
    assert locations.require_compatible(two, at(55.7, 12.6), allow_many_without_id=True).first().forecast_locations == 2
    with pytest.raises(ValueError):
        locations.require_compatible(at(55.7, 12.6, "a"), at(55.7, 12.6))
    with pytest.raises(ValueError):
        locations.require_compatible(at(55.7, 12.6, "a"), at(55.7, 12.6, "b"))
    with pytest.raises(ValueError):
        locations.require_compatible(at(55.7, 12.6, "a"), at(52.5, 13.4, "a"))


def test_plans_and_missing_runs(spark):
    places = spark.createDataFrame([("Köln Süd", 50.9, 6.9)], "name string, latitude double, longitude double")
    plan = planning.coverage_plan(places, ["gfs", "icon"], "2024-01-15", "2024-03-10")
    assert plan.count() == 3 * 3
    ids = {r.task_id for r in plan.collect()}
    assert "obs:köln_süd:2024-01-15:2024-01-31" in ids and "prev:köln_süd:gfs:2024-03-01:2024-03-10:1,2,3,4,5,6,7" in ids
    log = plan.where("kind = 'observations'").select("task_id", F.lit("success").alias("status"))
    assert planning.remaining_tasks(plan, log).count() == 6
    models = spark.createDataFrame([("icon_eu",), ("other",)], "model string")
    expected = planning.expected_runs(models, "2024-01-01", "2024-01-02")
    assert {r.model: r["count"] for r in expected.groupBy("model").count().collect()} == {"icon_eu": 16, "other": 2}
    assert planning.missing_runs(expected, expected.where("hour(forecast_issue_time) > 0")).count() == 4
    assert planning.single_run_plan(places, ["gfs"], "2024-01-01", "2024-01-03", (0, 12), 2).count() == 4
