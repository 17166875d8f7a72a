"""Spread, agreement and confidence of several models for one target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET_KEY = ("variable", "lead_hours", "latitude", "longitude", "valid_time")


def per_target(forecasts: DataFrame, key=TARGET_KEY, carried=()) -> DataFrame:
    """Model values of every target: members (one per model), record count, mean, sample std, range.

    Records are first reduced per (target, model), so a target's member list is
    as long as the model list even when one target has countless records. The
    `carried` columns are constant per model.
    """
    key, v = list(key), F.col("value")
    known = forecasts.where(v.isNotNull())
    per_model = known.groupBy(*key, "model", *carried).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("value"),
        (F.var_pop(v) * F.count(v)).alias("ss"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
    )
    member = F.struct("model", *carried, "value", "n", "ss")
    grouped = per_model.groupBy(*key).agg(
        F.array_sort(F.collect_list(member)).alias("members"),
        F.sum("n").alias("records"),
        (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"),
        (F.max("high") - F.min("low")).alias("value_range"),
    )
    # Within-model plus between-model squares, around the exact mean.
    squares = F.aggregate(
        "members",
        F.lit(0.0),
        lambda acc, m: acc + m["ss"] + m["n"] * (m["value"] - F.col("mean")) * (m["value"] - F.col("mean")),
    )
    std = F.when(F.col("records") >= 2, F.sqrt(squares / (F.col("records") - 1)))
    return grouped.withColumn("std", std)


def spread_level(n: Column, mean: Column, std: Column) -> Column:
    """Agreement of a blend: bands of std/|mean|, or of the std itself when the mean is 0."""
    cv = F.coalesce(std, F.lit(0.0)) / F.abs(mean)
    relative = F.when(cv < 0.05, "high").when(cv < 0.2, "medium").otherwise("low")
    absolute = F.when(std > 10.0, "low").when(std > 1.0, "medium").otherwise("high")
    return F.when(n < 2, "insufficient").when(mean == 0, absolute).otherwise(relative)


# Largest std of the high and medium agreement levels.
HIGH_STD, MEDIUM_STD = 1.0, 3.0
# Hours beyond which less agreement is to be expected.
LONG_LEAD = 72


def ensemble_agreement(forecasts: DataFrame, total_models: int | None = None, key=TARGET_KEY) -> DataFrame:
    """Std, range, disagreement, consensus and level per target; one value alone is insufficient."""
    targets = per_target(forecasts, key)
    total = F.lit(total_models) if total_models else forecasts.agg(F.count_distinct("model")).scalar()
    n, std, mean = F.col("records"), F.col("std"), F.col("mean")
    enough = n >= 2
    cv = F.least(std / F.abs(mean) / 0.5, F.lit(1.0))
    spread = F.when(mean == 0, F.least(F.col("value_range") / 10.0, F.lit(1.0))).otherwise(cv)
    level = F.when(~enough, "insufficient").when(std <= HIGH_STD, "high").when(std <= MEDIUM_STD, "medium").otherwise("low")
    lead = F.col("lead_hours")
    return targets.select(
        *key,
        total.cast("int").alias("total_models"),
        n.cast("int").alias("models_with_values"),
        std.alias("inter_model_std"),
        F.when(enough, F.col("value_range")).alias("inter_model_range"),
        F.when(enough, spread).alias("disagreement_score"),
        F.when(enough, F.lit(1.0) - spread).alias("consensus_score"),
        level.alias("agreement_level"),
        (enough & F.coalesce(lead > LONG_LEAD, F.lit(False))).alias("is_long_lead"),
        F.transform("members", lambda m: F.struct(m["model"].alias("model"), m["value"].alias("value"))).alias("model_values"),
    )


# Share of each factor in the confidence score.
CONFIDENCE_WEIGHTS = {
    "historical_error": 0.3,
    "model_agreement": 0.25,
    "coverage": 0.15,
    "lead_time": 0.15,
    "stability": 0.1,
    "variable_volatility": 0.05,
}
# Base predictability and volatility score by variable kind, first match wins.
PREDICTABILITY = (("temp", 0.7), ("precip", 0.4), ("wind", 0.5), ("humid", 0.55), ("pres", 0.8))
STEADINESS = (("temp", 0.8), ("precip", 0.3), ("wind", 0.5), ("humid", 0.6), ("pres", 0.9))


def _by_kind(variable: Column, table) -> Column:
    out, name = F.lit(0.5), F.lower(variable)
    for part, value in reversed(table):
        out = F.when(name.contains(part), F.lit(value)).otherwise(out)
    return out


def _upper_bands(value: Column, bands, beyond: float) -> Column:
    """First band whose upper limit (inclusive) holds the value; null is neutral."""
    out = F.lit(beyond)
    for limit, score in reversed(bands):
        out = F.when(value <= limit, F.lit(score)).otherwise(out)
    return F.when(value.isNull(), F.lit(0.5)).otherwise(out)


def confidence_factors(variable: Column, lead: Column, std: Column, coverage: Column, weight_variance: Column | None) -> dict[str, Column]:
    """Score of each factor in [0, 1]."""
    if weight_variance is None:
        stability = F.lit(0.5)
    else:
        w = weight_variance
        bands = F.when(w < 0.01, 0.9).when(w < 0.05, 0.7).when(w < 0.1, 0.5).otherwise(0.3)
        stability = F.when(w.isNull(), 0.5).otherwise(bands)
    covered = (
        F.when(coverage >= 1.0, 1.0).when(coverage >= 0.75, 0.8).when(coverage >= 0.5, 0.6).when(coverage >= 0.25, 0.4)
    )
    return {
        "historical_error": _by_kind(variable, PREDICTABILITY),
        "model_agreement": _upper_bands(std, ((0.5, 0.95), (1.0, 0.8), (2.0, 0.6), (5.0, 0.4)), 0.2),
        "coverage": covered.otherwise(0.2),
        "lead_time": _upper_bands(lead, ((24, 0.9), (48, 0.7), (72, 0.5), (120, 0.3)), 0.1),
        "stability": stability,
        "variable_volatility": _by_kind(variable, STEADINESS),
    }


def with_confidence(
    df: DataFrame,
    std: str = "inter_model_std",
    coverage: str = "coverage_fraction",
    weight_variance: Column | None = None,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Add confidence_score, factor array and a one-line reason."""
    shares = {**CONFIDENCE_WEIGHTS, **(weights or {})}
    if set(shares) != set(CONFIDENCE_WEIGHTS) or abs(sum(shares.values()) - 1.0) > 1e-9:
        raise ValueError(f"confidence weights must cover the six factors and sum to 1, got {shares}")
    factors = confidence_factors(F.col("variable"), F.col("lead_hours"), F.col(std), F.col(coverage), weight_variance)
    score = sum((factors[n] * w for n, w in shares.items()), F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    grade = lambda s: F.when(s > 0.7, "strong").when(s > 0.4, "moderate").otherwise("weak")
    listed = F.array(
        *[F.struct(F.lit(n).alias("factor"), s.cast("double").alias("score"), grade(s).alias("grade")) for n, s in factors.items()]
    )
    return df.withColumns(
        {
            "confidence_score": score,
            "confidence_factors": listed,
        }
    )
