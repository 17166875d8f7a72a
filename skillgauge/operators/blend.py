"""Weighted multi-model blends and their held-out evaluation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import error_of
from ..schemas import CIRCULAR_ERROR_VARIABLES, ISSUE, LAT, LEAD, LOCATION, LON, MODEL, TARGET, forecast_var, observed_var
from ..session import literal_table, materialize
from .agreement import TARGET_KEY, per_target, spread_level, with_confidence
from .quantiles import nearest_rank_time
from .weighting import model_weights

BLEND = "blend"


def blend(forecasts: DataFrame, weights: DataFrame, total_models: int | None = None, key=TARGET_KEY) -> DataFrame:
    """One blended row per target from long forecasts (key, model, value).

    `weights` has model and weight; a model without one counts with 1. Null
    values drop out, the rest is renormalised; if all weights are 0 the plain
    mean is taken. Contributors, spread, agreement, coverage and confidence come
    with it.
    """
    key = list(key)
    total = F.lit(total_models) if total_models else forecasts.agg(F.count_distinct("model")).scalar()
    weighted = forecasts.join(weights.select("model", "weight"), "model", "left")
    weighted = weighted.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    targets = per_target(weighted, key, carried=("weight",))
    sums = lambda f: F.aggregate("members", F.lit(0.0), lambda acc, m: acc + f(m))
    weight_sum = sums(lambda m: m["weight"] * m["n"])
    value_sum = sums(lambda m: m["weight"] * m["n"] * m["value"])
    n = F.size("members")
    out = targets.select(
        *key,
        F.when(weight_sum == 0, F.col("mean")).otherwise(value_sum / weight_sum).alias("value"),
        F.transform(
            "members",
            lambda m: F.struct(m["model"].alias("model"), m["weight"].alias("weight"), m["value"].alias("value")),
        ).alias("contributors"),
        F.col("std").alias("inter_model_std"),
        F.col("value_range").alias("inter_model_range"),
        spread_level(F.col("records"), F.col("mean"), F.col("std")).alias("model_agreement"),
        n.alias("active_models"),
        total.cast("int").alias("total_models"),
        (n / F.greatest(total, F.lit(1))).alias("coverage_fraction"),
    )
    # Population variance across all weights; below two weights it says nothing.
    variance = weights.agg(F.when(F.count("weight") >= 2, F.var_pop("weight"))).scalar()
    return with_confidence(out, weight_variance=variance)


def evaluate_blend(scored: DataFrame, by=()) -> DataFrame:
    """Blend against the best single model per `by` group.

    `scored` is long: by, model (BLEND for the blend), value, observed, and
    optionally variable (wind directions get angular errors). Negative
    improvement percentages mean the blend has the lower error.
    """
    by = list(by)
    f, o = F.col("value"), F.col("observed")
    error = f - o
    if "variable" in scored.columns:
        angle = F.col("variable").isin(*CIRCULAR_ERROR_VARIABLES)
        error = F.when(angle, error_of(f, o, True)).otherwise(error)
    rows = scored.withColumn("_e", error)
    a = F.abs("_e")
    stats = rows.groupBy(*by, "model").agg(
        F.avg(a).alias("mae"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        F.count("_e").alias("n"),
        F.count(F.lit(1)).alias("total"),
        F.stddev_pop(a).alias("_sd"),
    )
    is_blend = F.col("model") == BLEND
    cv = F.col("_sd") / F.col("mae")
    steady = F.when(F.col("mae") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - cv))
    of_blend = lambda c: F.max(F.when(is_blend, c))
    single = F.when(~is_blend & F.col("mae").isNotNull(), F.struct("mae", "model"))
    picked = stats.groupBy(*by).agg(
        of_blend(F.col("mae")).alias("blended_mae"),
        of_blend(F.col("rmse")).alias("blended_rmse"),
        F.coalesce(of_blend(F.col("n") / F.col("total")), F.lit(0.0)).alias("blended_coverage"),
        F.coalesce(of_blend(F.col("n")), F.lit(0)).alias("sample_size"),
        of_blend(F.when(F.col("n") >= 3, steady)).alias("blend_stability"),
        F.min_by(F.struct("model", "mae", "rmse"), single).alias("_best"),
    )
    gain = lambda mine, best: F.when(best > 0, (mine - best) / best * 100.0)
    mae_pct = gain(F.col("blended_mae"), F.col("_best.mae"))
    return picked.select(
        *by,
        "blended_mae",
        "blended_rmse",
        "blended_coverage",
        F.col("_best.model").alias("best_single_model"),
        F.col("_best.mae").alias("best_single_mae"),
        F.col("_best.rmse").alias("best_single_rmse"),
        mae_pct.alias("mae_improvement_pct"),
        gain(F.col("blended_rmse"), F.col("_best.rmse")).alias("rmse_improvement_pct"),
        F.coalesce(F.col("blended_mae") < F.col("_best.mae"), F.lit(False)).alias("improvement_over_best"),
        "blend_stability",
        "sample_size",
        F.when(mae_pct < 0, "lower").when(mae_pct > 0, "higher").when(mae_pct == 0, "equal").alias("mae_outcome"),
    )


# Lead bins of the binned evaluation, both ends inclusive.
LEAD_BINS = ((0, 24), (25, 72), (73, 120), (121, 9999))


def evaluate_by_lead(scored: DataFrame, by=(), bins=LEAD_BINS) -> DataFrame:
    """`evaluate_blend` per lead bin; `lead_hours` of a bin is its integer middle."""
    middle, low = F.lit(None).cast("int"), F.lit(None).cast("int")
    for lo, hi in bins:
        inside = F.col(LEAD).between(lo, hi)
        middle = F.when(inside, F.lit((lo + hi) // 2)).otherwise(middle)
        low = F.when(inside, F.lit(lo)).otherwise(low)
    rows = scored.withColumns({"bin_start": low, "bin_lead": middle}).where(F.col("bin_start").isNotNull())
    return evaluate_blend(rows, [*by, "bin_start", "bin_lead"])


def evaluate_by_variable(scored: DataFrame) -> DataFrame:
    return evaluate_blend(scored, ["variable"])


def shared_targets(verification: DataFrame, variable: str) -> DataFrame:
    """Targets forecast by every model: keys, members (model, value), observed.

    Sites are told apart by location id, or by coordinates without one. The
    observation is averaged per target because models may carry slightly
    different values. Of several forecasts of one model the smallest counts.
    """
    f, o = F.col(forecast_var(variable)), F.col(observed_var(variable))
    place = [LOCATION] if LOCATION in verification.columns else [LAT, LON]
    keys = [k for k in (ISSUE, TARGET, *place, LEAD) if k in verification.columns]
    rows = verification.where(f.isNotNull() & o.isNotNull())
    # A null key never forms a target.
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    per_model = rows.groupBy(*keys, MODEL).agg(
        F.min(f).alias("value"), F.sum(o).alias("_so"), F.count(o).alias("_no")
    )
    targets = per_model.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(MODEL, "value"))).alias("members"),
        (F.sum("_so") / F.sum("_no")).alias("observed"),
    )
    pool = rows.agg(F.count_distinct(MODEL)).scalar()
    return targets.where(F.size("members") == pool)


def with_split(targets: DataFrame, train_fraction: float = 0.5, split: str = "temporal") -> DataFrame:
    """Add `is_train`: whole issue times up to the nearest-rank quantile, or the first rows by position."""
    if split == "temporal" and ISSUE in targets.columns:
        row = nearest_rank_time(targets, ISSUE, train_fraction).first()
        return targets.withColumn("is_train", F.col(ISSUE) <= F.lit(row[0] if row else None).cast("timestamp"))
    return _positional(targets, train_fraction)


def _positional(targets: DataFrame, train_fraction: float) -> DataFrame:
    """The first rows in key order are for training: those up to the row at the cut.

    The cut's keys are found one after the other, each among the rows that share the
    ones before; only distinct values of a key with their counts are ordered (issue
    times, then lead times of one run, then sites), never the rows.
    """
    keys = [k for k in (ISSUE, TARGET, LOCATION, LAT, LON, LEAD) if k in targets.columns]
    total = targets.count()
    place = math.floor(total * train_fraction) - 1
    if place < 0:
        return targets.withColumn("is_train", F.lit(False))
    rest, same, before_cut = targets, F.lit(True), F.lit(False)
    for k in keys:
        sizes = rest.groupBy(k).agg(F.count(F.lit(1)).alias("_n"))
        placed = sizes.withColumn("_end", F.sum("_n").over(Window.orderBy(k)))
        row = placed.where(F.col("_end") > place).orderBy(k).first()
        place -= row["_end"] - row["_n"]
        value = F.lit(row[k])
        before_cut = before_cut | (same & (F.col(k) < value))
        same = same & (F.col(k) == value)
        rest = rest.where(F.col(k) == value)
    return targets.withColumn("is_train", before_cut | same)


def train_entries(split: DataFrame, variable: str) -> DataFrame:
    """Skill entries (all leads, seasons, regions) from the training MAE of each model."""
    rows = split.where("is_train").select("observed", F.inline("members"))
    return rows.groupBy(MODEL).agg(
        F.avg(F.abs(F.col("value") - F.col("observed"))).alias("value"), F.count(F.lit(1)).alias("sample_size")
    ).select(
        MODEL,
        F.lit(variable).alias("variable"),
        F.lit(None).cast("int").alias("lead_hours"),
        F.lit("").alias("season"),
        F.lit("").alias("region"),
        F.lit("mae").alias("metric_type"),
        "value",
        "sample_size",
        F.lit(None).cast("double").alias("coverage_fraction"),
        F.lit(True).alias("is_stable"),
    )


def train_weights(split: DataFrame, variable: str, min_weight: float = 0.0) -> DataFrame:
    """Model weights from the training errors; as many rows as there are models."""
    entries = train_entries(split, variable)
    context = "variable string, lead_hours int, season string, region string"
    everywhere = literal_table(split.sparkSession, [(variable, None, "", "")], context)
    return model_weights(entries, everywhere, min_weight=min_weight).select("model", "weight")


def blended_test_rows(split: DataFrame, weights: DataFrame, variable: str) -> DataFrame:
    """Long held-out rows: each member model plus the blend, with the observation."""
    table = weights.agg(F.map_from_entries(F.collect_list(F.struct("model", "weight")))).scalar()
    test = split.where(~F.col("is_train")).withColumn("_w", table)
    value = F.aggregate("members", F.lit(0.0), lambda acc, m: acc + F.col("_w")[m["model"]] * m["value"])
    both = F.concat("members", F.array(F.struct(F.lit(BLEND).alias(MODEL), value.alias("value"))))
    return test.select(LEAD, "observed", F.lit(variable).alias("variable"), F.inline(both))


def blend_holdout(
    verification: DataFrame, variable: str, train_fraction: float = 0.5, split: str = "temporal", min_weight: float = 0.0
) -> DataFrame:
    """Learn weights on the earlier targets, score the blend on the later ones: one row.

    The row is empty of scores when no target is shared or one side of the split
    has none.
    """
    # The targets feed the cutoff, the training errors and the scores, so they are stored once.
    targets = materialize(shared_targets(verification, variable), "shared-targets")
    parts = with_split(targets, train_fraction, split)
    weights = train_weights(parts, variable, min_weight)
    result = evaluate_blend(blended_test_rows(parts, weights, variable), ["variable"])
    train_rows = parts.where("is_train").agg(F.count(F.lit(1))).scalar()
    return result.withColumn("train_rows", train_rows)
