"""Keyed table of historical skill and its lookup by context.

An entry is (model, variable, lead_hours, season, region, metric_type) with a
value, sample size, coverage and stability. lead_hours null means "all leads";
season or region "" means "all". The metric type is part of the key, so a later
RMSE never replaces a MAE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.temporal import season_of
from ..schemas import SEASONS

KEY = ("model", "variable", "lead_hours", "season", "region", "metric_type")
STATS = ("value", "sample_size", "coverage_fraction", "is_stable", "updated_at")
CONTEXT = ("variable", "lead_hours", "season", "region")


def entries_from_evaluations(evaluations: DataFrame, region: str = "", updated_at: Column | None = None) -> DataFrame:
    """Store rows from evaluations that carry a `model` column.

    The season is the evaluation's own, or that of the middle of its time range.
    """
    middle = F.timestamp_micros(
        F.floor((F.unix_micros("range_start") + F.unix_micros("range_end")) / 2).cast("bigint")
    )
    derived = F.when(F.col("range_start").isNotNull(), season_of(middle))
    given = F.col("season") if "season" in evaluations.columns else F.lit(None).cast("string")
    season = F.coalesce(F.when(given.isin(*SEASONS), given), derived, F.lit(""))
    lead = F.col("lead_hours") if "lead_hours" in evaluations.columns else F.lit(None)
    return evaluations.select(
        "model",
        "variable",
        lead.cast("int").alias("lead_hours"),
        season.alias("season"),
        F.lit(region).alias("region"),
        "metric_type",
        "value",
        "sample_size",
        "coverage_fraction",
        "is_stable",
        (F.current_timestamp() if updated_at is None else updated_at).alias("updated_at"),
    )


def upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The newest row of every key; of equally old rows the one from `new`."""
    both = existing.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    newest = F.max_by(F.struct(*STATS), F.struct("updated_at", "_batch")).alias("_s")
    return both.groupBy(*KEY).agg(newest).select(*KEY, "_s.*")


def save(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def model_summary(entries: DataFrame) -> DataFrame:
    """Per model and variable: number of entries and stable entries, best MAE, mean coverage."""
    mae = F.when((F.col("metric_type") == "mae") & F.col("is_stable"), F.col("value"))
    return entries.groupBy("model", "variable").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if("is_stable").alias("stable_entries"),
        F.min(mae).alias("best_mae"),
        F.avg("coverage_fraction").alias("mean_coverage"),
    )


# Fallback levels, most specific first, as (lead, season, region) considered or not.
LEVELS = ((1, 1, 1), (1, 1, 0), (1, 0, 1), (1, 0, 0), (0, 1, 1), (0, 1, 0), (0, 0, 1), (0, 0, 0))
_ANY_LEAD, _ANY_TEXT = -(2**31), ""


def _masked(flags, number: Column) -> Column:
    """Struct (mask, lead, season, region) with only the flagged and present fields kept."""
    has = (F.col("lead_hours").isNotNull(), F.col("season") != "", F.col("region") != "")
    use = [h if flag else F.lit(False) for flag, h in zip(flags, has, strict=True)]
    bit = [F.when(u, F.lit(b)).otherwise(F.lit(0)) for u, b in zip(use, (4, 2, 1), strict=True)]
    return F.struct(
        number.alias("level"),
        (bit[0] + bit[1] + bit[2]).alias("_mask"),
        F.when(use[0], F.col("lead_hours")).otherwise(F.lit(_ANY_LEAD)).alias("_lead"),
        F.when(use[1], F.col("season")).otherwise(F.lit(_ANY_TEXT)).alias("_season"),
        F.when(use[2], F.col("region")).otherwise(F.lit(_ANY_TEXT)).alias("_region"),
    )


_MASK_KEY = ("variable", "_mask", "_lead", "_season", "_region")


def skill_by_context(entries: DataFrame, contexts: DataFrame, metric_type: str = "mae") -> DataFrame:
    """Per context and model: the entries of the first fallback level that has any, summarised.

    `contexts` has variable, lead_hours, season, region (null or "" = any) and
    any further columns. Entries are summarised once per masked key, so a
    context meets one row per model and level, never the entries themselves.
    """
    # An entry serves a mask only where all flagged fields are present, which the mask bits express.
    options = F.array_distinct(F.array(*[_masked(flags, F.lit(0)) for flags in LEVELS]))
    keyed = entries.select("*", F.explode(options).alias("_k")).select(*entries.columns, "_k.*")
    usable = (F.col("metric_type") == metric_type) & F.col("value").isNotNull() & F.col("is_stable")
    specificity = F.struct(F.coalesce(F.col("lead_hours"), F.lit(-1)), "season", "region")
    summary = keyed.groupBy(*_MASK_KEY, "model").agg(
        F.count(F.lit(1)).alias("entries"),
        F.min(F.when(usable, F.col("value"))).alias("best_value"),
        F.min_by(F.col("value"), F.when(usable, specificity)).alias("first_value"),
        F.avg("coverage_fraction").alias("mean_coverage"),
        F.avg(F.col("is_stable").cast("double")).alias("stable_share"),
    )
    levels = F.array(*[_masked(flags, F.lit(i + 1)) for i, flags in enumerate(LEVELS)])
    own = contexts.columns
    clean = contexts.withColumns({"season": F.coalesce("season", F.lit("")), "region": F.coalesce("region", F.lit(""))})
    wanted = clean.select(*own, F.explode(levels).alias("_k")).select(*own, "_k.*")
    found = wanted.join(summary, list(_MASK_KEY))
    stats = ("level", "entries", "best_value", "first_value", "mean_coverage", "stable_share")
    best = F.min_by(F.struct(*stats), F.col("level")).alias("_s")
    return found.groupBy(*own, "model").agg(best).select(*own, "model", "_s.*")


def ranking(skill: DataFrame, context_cols=CONTEXT) -> DataFrame:
    """Models of a context by their first stable entry, lowest error first.

    A context has one row per model, which bounds its window.
    """
    order = Window.partitionBy(*context_cols).orderBy("first_value", "model")
    rows = skill.where(F.col("first_value").isNotNull())
    return rows.select(*context_cols, "model", F.col("first_value").alias("value"), F.row_number().over(order).alias("rank"))


def best_model(skill: DataFrame, context_cols=CONTEXT) -> DataFrame:
    """The model with the lowest stable value per context."""
    rows = skill.where(F.col("best_value").isNotNull())
    top = F.min_by(F.struct("model", F.col("best_value").alias("value")), F.struct("best_value", "model")).alias("_t")
    return rows.groupBy(*context_cols).agg(top).select(*context_cols, "_t.*")
