from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from skillgauge.functions.temporal import lead_hours
from skillgauge.operators import degradation, errors, metrics, seasonal


def rows_of(df, *key):
    return {tuple(r[k] for k in key): r for r in df.collect()}


@pytest.fixture(scope="module")
def ver(spark):
    r = random.Random(3)
    rows = []
    for i in range(600):
        model = "hot" if i % 3 else r.choice(["a", "b"])
        error = None if r.random() < 0.1 else r.gauss(0.5, 2)
        rows.append((model, r.choice([1, 6, 24]), f"2024-{i % 12 + 1:02d}-03 06:00:00", error))
    df = spark.createDataFrame(rows, "model string, lead_hours int, t string, temperature_2m_error double")
    return df.withColumn("forecast_target_time", F.to_timestamp("t")).drop("t").cache()


def test_known_values(spark):
    df = spark.createDataFrame([("m", 2.0), ("m", -2.0), ("m", 0.0), ("m", None)], "model string, x_error double")
    got = rows_of(metrics.grouped_metrics(df, ["model"], ["x"]), "metric_name")
    assert got[("mae",)].metric_value == pytest.approx(4 / 3)
    assert got[("bias",)].metric_value == pytest.approx(0)
    assert got[("rmse",)].metric_value == pytest.approx(math.sqrt(8 / 3))
    assert got[("std",)].metric_value == pytest.approx(2.0)
    assert (got[("mae",)].sample_size, got[("mae",)].total_rows, got[("mae",)].missing_count) == (3, 4, 1)


def test_std_of_one_value_and_empty_group_are_null(spark):
    df = spark.createDataFrame([("one", 2.0), ("none", None)], "model string, x_error double")
    got = rows_of(metrics.grouped_metrics(df, ["model"], ["x"]), "model", "metric_name")
    assert got[("one", "std")].metric_value is None
    assert got[("none", "mae")].metric_value is None and got[("none", "mae")].sample_size == 0


def test_grouping_matches_python(ver):
    got = rows_of(metrics.grouped_metrics(ver, ["model", "lead_hours"], ["temperature_2m"]), "model", "lead_hours", "metric_name")
    groups = {}
    for r in ver.collect():
        groups.setdefault((r.model, r.lead_hours), []).append(r.temperature_2m_error)
    for key, values in groups.items():
        known = [v for v in values if v is not None]
        assert got[(*key, "mae")].metric_value == pytest.approx(statistics.fmean(map(abs, known)))
        assert got[(*key, "std")].metric_value == pytest.approx(statistics.stdev(known))
        assert got[(*key, "mae")].missing_count == len(values) - len(known)
        assert abs(got[(*key, "bias")].metric_value) <= got[(*key, "mae")].metric_value + 1e-12
        assert got[(*key, "mae")].metric_value <= got[(*key, "rmse")].metric_value + 1e-12


def test_grouping_sets_equal_single_groupings(ver):
    sets = metrics.metrics_by_grouping_sets(ver, [["lead_hours"], ["season"], ["month"], ["model"]], ["temperature_2m"])
    for dim in ("lead_hours", "season", "month", "model"):
        one = rows_of(metrics.grouped_metrics(ver, [dim], ["temperature_2m"]), dim, "metric_name")
        many = rows_of(sets.where(F.col("grouping") == dim), dim, "metric_name")
        assert set(one) == set(many)
        for key, row in one.items():
            assert many[key].metric_value == pytest.approx(row.metric_value)
            assert many[key].sample_size == row.sample_size and many[key].total_rows == row.total_rows


def test_null_keys_are_dropped(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 5.0)], "model string, x_error double")
    assert metrics.grouped_metrics(df, ["model"], ["x"], ["mae"]).count() == 1


@pytest.mark.parametrize(
    ("dims", "names", "variables"),
    [(["planet"], ["mae"], ["temperature_2m"]), (["model"], ["best"], ["temperature_2m"]), (["model"], ["mae"], ["wind"]), (["model", "model"], ["mae"], ["temperature_2m"]), (["model"], [], ["temperature_2m"])],
)
def test_bad_arguments(ver, dims, names, variables):
    with pytest.raises(ValueError):
        metrics.grouped_metrics(ver, dims, variables, names)


def test_lead_hours_truncate_and_repair(spark):
    df = spark.sql(
        "SELECT timestamp'2024-01-01 00:00:00' AS forecast_issue_time, timestamp'2024-01-01 06:50:00' AS forecast_target_time, 6 AS lead_hours "
        "UNION ALL SELECT timestamp'2024-01-01 00:00:00', timestamp'2024-01-02 00:00:00', 1"
    )
    assert sorted(r[0] for r in errors.repair_lead_hours(df).select("lead_hours").collect()) == [6, 24]
    back = df.select(lead_hours("forecast_target_time", "forecast_issue_time").alias("h"))
    assert sorted(r.h for r in back.collect()) == [-24, -6]


def test_circular_errors_wrap(spark):
    df = spark.createDataFrame([(350.0, 10.0), (10.0, 350.0), (180.0, 0.0), (None, 3.0)], "forecast_wind_direction_10m double, observed_wind_direction_10m double")
    wrapped = [r[0] for r in errors.add_errors(df, ["wind_direction_10m"], circular=True).select("wind_direction_10m_error").collect()]
    assert wrapped == [-20.0, 20.0, -180.0, None]
    plain = [r[0] for r in errors.add_errors(df, ["wind_direction_10m"]).select("wind_direction_10m_error").collect()]
    assert plain[:2] == [340.0, -340.0]


@pytest.fixture(scope="module")
def decay(spark):
    points = [(1, 0.5), (6, 1.0), (12, 1.5), (24, 2.0), (48, 2.5), (72, 3.0)]
    rows = [("t", "mae", "m", h, v, 100, "DJF", 1) for h, v in points] + [("t", "mae", "short", 1, 1.0, 5, "DJF", 1), ("t", "mae", "zero", 1, 0.0, 5, "DJF", 1), ("t", "mae", "zero", 2, 0.0, 5, "DJF", 1)]
    return spark.createDataFrame(rows, "variable string, metric_name string, model string, lead_hours int, metric_value double, sample_size bigint, season string, month int")


def test_degradation(decay):
    rate = rows_of(degradation.degradation_rate(decay), "model")
    assert rate[("m",)].degradation_rate == pytest.approx(0.0324, abs=2e-3) and rate[("m",)].n_points == 6
    assert rate[("short",)].degradation_rate is None
    half = rows_of(degradation.half_skill_lead(decay), "model")
    assert half[("m",)].half_skill_lead_hours == 6
    assert half[("short",)].half_skill_lead_hours is None and half[("zero",)].half_skill_lead_hours is None
    profile = rows_of(degradation.degradation_profile(decay), "model")
    assert profile[("m",)].is_monotonic and profile[("m",)].instability_points == []
    skill = rows_of(degradation.skill_against(decay, "m"), "model")
    assert skill[("short",)].skill_score == pytest.approx(1 - 1.0 / 1.75)


def test_seasons_are_reindexed(decay):
    out = rows_of(seasonal.seasonal_skill(decay, ("mae",)), "season")
    assert set(out) == {("DJF",), ("MAM",), ("JJA",), ("SON",)}
    assert out[("JJA",)].metric_value is None and out[("DJF",)].sample_size == 615
    months = rows_of(seasonal.monthly_chart(decay, "mae"), "month")
    assert len(months) == 12 and months[(2,)].metric_value is None
