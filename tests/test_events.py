from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skillgauge.functions.thresholds import meets
from skillgauge.operators import events


@pytest.fixture(scope="module")
def frost(spark):
    rows = [(-1.0, -2.0, 1, "a"), (1.0, -1.0, 1, "a"), (-1.0, 2.0, 6, "a"), (5.0, 6.0, 6, "b"), (None, -3.0, 6, "b"), (-2.0, None, 24, "b")]
    return spark.createDataFrame(rows, "forecast_temperature_2m double, observed_temperature_2m double, lead_hours int, model string")


def test_contingency_counts_and_exclusions(frost):
    row = events.contingency(frost, "frost").first()
    assert (row.hits, row.misses, row.false_alarms, row.correct_negatives, row.excluded_nan) == (1, 1, 1, 1, 2)
    assert (row.sample_size, row.total_rows) == (4, 6)
    for r in events.contingency(frost, ["frost", "cold", "hot_day"], ["lead_hours"]).collect():
        assert r.hits + r.misses + r.false_alarms + r.correct_negatives + r.excluded_nan == r.total_rows


def test_flags_are_never_null(spark, frost):
    flagged = events.event_flags(frost, "frost")
    assert flagged.where("event_forecast_frost IS NULL OR event_observed_frost IS NULL").count() == 0
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (0.0,)], "v double")
    for op in ("le", "lt", "ge", "gt", "ne"):
        flags = [r[0] for r in odd.select(meets(F.col("v"), 1.0, op)).collect()]
        assert flags[:4] == [False] * 4
        assert flags[4] == (op in ("le", "lt", "ne"))


def test_custom_and_unknown_events(frost):
    custom = events.event_flags(frost, "mild", "temperature_2m", 4.0, "gt")
    assert custom.where("event_forecast_mild").count() == 1
    with pytest.raises(ValueError):
        events.event_flags(frost, "frost", "temperature_2m", 1.0, "le")
    with pytest.raises(ValueError):
        events.event_flags(frost, "mild", "temperature_2m")
    with pytest.raises(ValueError):
        events.event_definition("mild")
    with pytest.raises(ValueError):
        events.contingency(frost, "frost", ["planet"])
    with pytest.raises(ValueError):
        meets(F.col("x"), 1.0, "about")


def test_scores_and_zero_denominators(spark, frost):
    table = events.contingency(frost, "frost")
    scores = {r.metric_name: r for r in events.skill_scores(table).collect()}
    assert scores["hit_rate"].metric_value == 0.5 and scores["csi"].metric_value == pytest.approx(1 / 3)
    assert scores["accuracy"].metric_value == 0.5 and scores["odds_ratio"].metric_value == 1.0
    assert scores["csi"].missing_count == 2 and scores["csi"].model is None and scores["csi"].lead_hours is None
    dry = spark.createDataFrame([(9.0, 9.0)], "forecast_temperature_2m double, observed_temperature_2m double")
    empty = {r.metric_name: r.metric_value for r in events.skill_scores(events.contingency(dry, "frost")).collect()}
    assert empty["hit_rate"] is None and empty["csi"] is None and empty["odds_ratio"] is None and empty["accuracy"] == 1.0


def test_climatology_parity_and_observed_only(frost):
    assert events.climatology(frost, "frost").first().climatology_prob == pytest.approx(3 / 6)
    assert events.climatology(frost, "frost", exclude_missing=True).first().climatology_prob == pytest.approx(3 / 5)


def test_climatology_skill_signs(spark):
    table = spark.createDataFrame([("frost", 6, 2, 1, 1)], "event_name string, hits bigint, misses bigint, false_alarms bigint, correct_negatives bigint")
    base = spark.createDataFrame([("frost", 0.8, 10, 10)], "event_name string, climatology_prob double, sample_size int, total_rows int")
    row = events.climatology_skill(table, base).first()
    # int(8 * 0.8) = 6 hits, 2 misses, int(2 * 0.8) = 1 false alarm.
    assert row.climatology_csi == pytest.approx(6 / 9) and row.forecast_csi == pytest.approx(6 / 9)
    assert row.relative_skill == pytest.approx(1.0) and row.csi_skill == pytest.approx(0.0)


def test_sweep_equals_contingency(frost):
    sweep = {r.threshold: r for r in events.threshold_sweep(frost, "temperature_2m", (0.0, 4.0)).collect()}
    one = events.event_contingency(frost, "temperature_2m", 4.0).first()
    assert (sweep[4.0].hits, sweep[4.0].misses, sweep[4.0].false_alarms) == (one.hits, one.misses, one.false_alarms)
    assert sweep[0.0].observed_pct == 50.0


def test_event_rows_keep_all_or_only_events(frost):
    df = frost.withColumn("forecast_target_time", F.lit("2024-01-02 03:00:00").cast("timestamp"))
    catalog = {"frost": ("temperature_2m", 0.0, "le")}
    assert events.event_rows(df, catalog).count() == 10
    assert events.event_rows(df, catalog, only_events=True).count() == 6
    assert events.combined_events(df, "frost").count() == 5
