from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skillgauge.operators import agreement, blend, regime, skillstore, weighting
from skillgauge.session import literal_table

ENTRY = "model string, variable string, lead_hours int, season string, region string, metric_type string, value double, sample_size bigint, coverage_fraction double, is_stable boolean, updated_at string"
CONTEXT = "variable string, lead_hours int, season string, region string"


def entries(spark, rows):
    full = [(*r, "2024-01-01 00:00:00") if len(r) == 10 else r for r in rows]
    return spark.createDataFrame(full, ENTRY).withColumn("updated_at", F.to_timestamp("updated_at"))


def entry(model, value, lead=None, season="", region="", metric="mae", coverage=1.0, stable=True):
    return (model, "temperature_2m", lead, season, region, metric, value, 10, coverage, stable)


def ask(spark, lead=None, season="", region="", variable="temperature_2m"):
    return literal_table(spark, [(variable, lead, season, region)], CONTEXT)


def weights_of(df):
    return {r.model: r.weight for r in df.collect()}


def test_upsert_keeps_newest_and_separates_metrics(spark):
    old = entries(spark, [entry("a", 1.0), entry("a", 3.0, metric="rmse")])
    new = entries(spark, [(*entry("a", 2.0), "2024-02-01 00:00:00"), entry("b", 5.0)])
    rows = {(r.model, r.metric_type): r.value for r in skillstore.upsert(old, new).collect()}
    assert rows == {("a", "mae"): 2.0, ("a", "rmse"): 3.0, ("b", "mae"): 5.0}
    stale = entries(spark, [(*entry("a", 9.0), "2023-01-01 00:00:00")])
    assert {r.value for r in skillstore.upsert(old, stale).where("metric_type = 'mae'").collect()} == {1.0}


@pytest.mark.parametrize(
    ("context", "level", "value"),
    [
        ((24, "DJF", "north"), 1, 1.0),
        ((24, "DJF", "south"), 2, 1.0),
        ((24, "JJA", "north"), 3, 1.0),
        ((24, "JJA", "south"), 4, 1.0),
        ((99, "DJF", "north"), 5, 1.0),
        ((99, "MAM", "south"), 8, 0.5),
        ((None, "", ""), 1, 0.5),
        ((None, "MAM", ""), 7, 0.5),
        ((48, "", ""), 1, 2.0),
    ],
)
def test_fallback_levels(spark, context, level, value):
    store = entries(spark, [entry("a", 1.0, 24, "DJF", "north"), entry("a", 2.0, 48, "SON"), entry("a", 0.5), entry("a", 0.1, stable=False)])
    row = skillstore.skill_by_context(store, ask(spark, *context)).first()
    # Levels with the same effective key collapse onto the first of them.
    assert row.best_value == value and row.level <= level


def test_ranking_and_best(spark):
    store = entries(spark, [entry("a", 2.0), entry("b", 1.0), entry("c", 0.5, stable=False), entry("d", None)])
    skill = skillstore.skill_by_context(store, ask(spark))
    assert [(r.rank, r.model) for r in skillstore.ranking(skill).orderBy("rank").collect()] == [(1, "b"), (2, "a")]
    assert skillstore.best_model(skill).first().model == "b"
    assert skillstore.skill_by_context(store, ask(spark, variable="wind")).count() == 0


def test_weights_sum_to_one_and_worst_gets_nothing(spark):
    store = entries(spark, [entry("a", 1.0), entry("b", 2.0), entry("c", 4.0)])
    w = weights_of(weighting.model_weights(store, ask(spark)))
    assert sum(w.values()) == pytest.approx(1.0) and w["c"] == 0.0 and w["a"] > w["b"] > 0
    # Scaled skill: a = 1, b = (0.5 - 0.25) / 0.75.
    assert w["a"] == pytest.approx(1 / (1 + 1 / 3))


def test_equal_models_share_and_minimum_weight(spark):
    same = entries(spark, [entry("a", 1.0), entry("b", 1.0)])
    assert weights_of(weighting.model_weights(same, ask(spark))) == {"a": 0.5, "b": 0.5}
    store = entries(spark, [entry("a", 1.0), entry("b", 4.0)])
    w = weights_of(weighting.model_weights(store, ask(spark), min_weight=0.25))
    assert w == pytest.approx({"a": 0.8, "b": 0.2})
    with pytest.raises(ValueError):
        weighting.model_weights(store, ask(spark), models=["a", "b", "c"], min_weight=0.5)
    with pytest.raises(ValueError):
        weighting.checked_coefficients(coverage=0.9)


def test_models_without_entries_and_recent_skill(spark):
    store = entries(spark, [entry("a", 1.0)])
    w = weights_of(weighting.model_weights(store, ask(spark), models=["a", "new"]))
    assert w == {"a": 1.0, "new": 0.0}
    recent = spark.createDataFrame([("new", "mae", 1.0), ("a", "mae", 4.0), ("a", "mae", 2.0)], "model string, metric_type string, value double")
    rows = {r.model: r for r in weighting.model_weights(store, ask(spark), models=["a", "new"], recent=recent).collect()}
    assert rows["new"].recent_skill_contribution == pytest.approx(0.25) and rows["a"].recent_skill_contribution == pytest.approx(0.25 / 3)
    assert rows["new"].grades.historical_skill is None and rows["new"].grades.recent_skill == "high"


def members(spark, rows):
    df = spark.createDataFrame(rows, "model string, lead_hours int, value double")
    return df.select("model", "lead_hours", "value", F.lit("temperature_2m").alias("variable"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), F.lit("2024-01-01").cast("timestamp").alias("valid_time"))


def test_blend_of_targets(spark):
    f = members(spark, [("a", 24, 1.0), ("b", 24, 3.0), ("a", 48, 5.0), ("b", 48, None), ("c", 72, 7.0), ("b", 96, None)])
    w = spark.createDataFrame([("a", 0.75), ("b", 0.25), ("c", 0.0)], "model string, weight double")
    out = {r.lead_hours: r for r in blend.blend(f, w).collect()}
    assert set(out) == {24, 48, 72}
    assert out[24].value == pytest.approx(1.5) and out[24].inter_model_std == pytest.approx(2**0.5) and out[24].coverage_fraction == pytest.approx(2 / 3)
    assert out[48].value == 5.0 and out[48].model_agreement == "insufficient" and out[48].inter_model_std is None
    assert out[72].value == 7.0
    assert 1.0 <= out[24].value <= 3.0 and 0 <= out[24].confidence_score <= 1


def test_many_copies_of_one_target_stay_one_member(spark):
    f = members(spark, [("a", 24, float(i % 2)) for i in range(500)] + [("b", 24, 4.0)])
    w = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "model string, weight double")
    row = blend.blend(f, w).first()
    assert len(row.contributors) == 2 and row.value == pytest.approx((250 + 4) / 501)
    import statistics

    assert row.inter_model_std == pytest.approx(statistics.stdev([float(i % 2) for i in range(500)] + [4.0]))


def test_agreement_levels(spark):
    f = members(spark, [("a", 24, 10.0), ("b", 24, 10.5), ("a", 96, 10.0), ("b", 96, 13.0), ("a", 120, 0.0), ("b", 120, 30.0), ("a", 48, 1.0), ("a", 72, -4.0), ("b", 72, 4.0)])
    out = {r.lead_hours: r for r in agreement.ensemble_agreement(f).collect()}
    assert [out[h].agreement_level for h in (24, 96, 120, 48)] == ["high", "medium", "low", "insufficient"]
    assert out[120].disagreement_score == 1.0 and out[72].disagreement_score == pytest.approx(0.8) and out[48].consensus_score is None
    assert out[96].is_long_lead and not out[24].is_long_lead and not out[48].is_long_lead


def test_confidence_score(spark):
    df = spark.createDataFrame([("temperature_2m", 24, 0.4, 1.0), ("precipitation", 240, None, 0.3)], "variable string, lead_hours int, inter_model_std double, coverage_fraction double")
    out = {r.variable: r for r in agreement.with_confidence(df).collect()}
    assert out["temperature_2m"].confidence_score == pytest.approx(0.3 * 0.7 + 0.25 * 0.95 + 0.15 + 0.15 * 0.9 + 0.1 * 0.5 + 0.05 * 0.8)
    assert out["precipitation"].confidence_score == pytest.approx(0.3 * 0.4 + 0.25 * 0.5 + 0.15 * 0.4 + 0.15 * 0.1 + 0.1 * 0.5 + 0.05 * 0.3)
    assert len(out["precipitation"].confidence_factors) == 6
    with pytest.raises(ValueError):
        agreement.with_confidence(df, weights={"coverage": 0.9})


def verification(spark, jitter=0.0, n=400):
    r = random.Random(1)
    rows = []
    for h in range(n):
        truth = r.gauss(10, 5)
        for model, noise in (("good", 0.5), ("fair", 1.0), ("bad", 4.0)):
            rows.append((h, model, truth + r.gauss(0, noise), truth + r.gauss(0, jitter)))
    df = spark.createDataFrame(rows, "h int, model string, forecast_temperature_2m double, observed_temperature_2m double")
    issue = F.timestamp_seconds(F.lit(1704067200) + F.floor(F.col("h") / 4) * 21600)
    return df.withColumns({"forecast_issue_time": issue, "forecast_target_time": F.timestamp_seconds(F.lit(1704067200) + F.col("h") * 3600), "lead_hours": (F.col("h") % 4).cast("int"), "location_id": F.lit("s")}).drop("h")


def test_holdout_learns_on_the_past_only(spark):
    df = verification(spark)
    shared = blend.with_split(blend.shared_targets(df, "temperature_2m"), 0.5)
    edges = shared.groupBy("is_train").agg(F.min("forecast_issue_time").alias("lo"), F.max("forecast_issue_time").alias("hi")).collect()
    by = {r.is_train: r for r in edges}
    assert by[True].hi < by[False].lo
    row = blend.blend_holdout(df, "temperature_2m").first()
    assert row.best_single_model == "good" and row.train_rows + row.sample_size == 400
    assert row.blended_mae < 1.2 * row.best_single_mae
    # Ruining the held-out observations changes the score, not the weights.
    ruined = df.withColumn("observed_temperature_2m", F.when(F.col("forecast_issue_time") > by[True].hi, 99.0).otherwise(F.col("observed_temperature_2m")))
    weights = [weights_of(blend.train_weights(blend.with_split(blend.shared_targets(d, "temperature_2m"), 0.5), "temperature_2m")) for d in (df, ruined)]
    assert weights[0] == pytest.approx(weights[1]) and weights[0]["bad"] == 0.0


def test_jittered_observations_still_align_and_positional_split(spark):
    assert blend.shared_targets(verification(spark, jitter=0.2, n=60), "temperature_2m").count() == 60
    row = blend.blend_holdout(verification(spark, n=60), "temperature_2m", train_fraction=0.25, split="positional").first()
    assert (row.train_rows, row.sample_size) == (15, 45)


def test_regime_rules_and_fallback(spark):
    rules = regime.rule_table(spark, [regime.rule("season", "DJF", "temperature_2m", ["a", "gone"], ["b"]), regime.rule("storm", "any", "temperature_2m", ["c"])])
    asks = spark.createDataFrame([(1, "temperature_2m", "DJF", ""), (2, "temperature_2m", "JJA", ""), (3, "wind", "DJF", "")], "context_id int, variable string, season string, region string")
    store = entries(spark, [entry("b", 1.0), entry("a", 2.0)])
    out = {r.context_id: r for r in regime.select_models(asks, rules, ["a", "b", "c"], store).collect()}
    assert [s.model for s in out[1].selected_models] == ["a"] and out[1].excluded_models == ["b"]
    assert [s.model for s in out[2].selected_models] == ["b"] and out[2].rules_applied == 0
    assert out[3].selected_models == []
    assert regime.without_rules(rules, "season").count() == 1
