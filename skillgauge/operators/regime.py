"""Model selection by season and region rules, with skill as the fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import literal_table
from .skillstore import best_model, skill_by_context

# Only these condition types can match; others may be declared and never apply.
MATCHING = ("season", "region")
RULE_SCHEMA = (
    "condition_type string, condition_value string, variable string, recommended array<string>, excluded array<string>"
)


def rule(condition_type: str, value: str, variable: str, recommended=(), excluded=()) -> tuple:
    return (condition_type, value, variable, list(recommended), list(excluded))


def rule_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    return literal_table(spark, rules, RULE_SCHEMA)


def without_rules(rules: DataFrame, condition_type: str | None = None) -> DataFrame:
    """Rules with one condition type (or everything) cleared."""
    return rules.where(F.lit(False) if condition_type is None else F.col("condition_type") != condition_type)


def select_models(contexts: DataFrame, rules: DataFrame, models: list[str], entries: DataFrame) -> DataFrame:
    """Selected and excluded models per context.

    `contexts` has context_id, variable, season, region. Matching rules
    recommend models; a context without a recommendation gets the model with the
    best historical MAE. Only models of the pool `models` can appear.
    """
    pool = F.array(*[F.lit(m) for m in models])
    own = ["context_id", "variable", "season", "region"]
    facts = F.array(
        *[F.struct(F.lit(i).alias("_o"), F.lit(t).alias("condition_type"), F.col(t).alias("condition_value")) for i, t in enumerate(MATCHING)]
    )
    asked = contexts.select(*own, F.inline(facts))
    hits = asked.join(rules, ["condition_type", "condition_value", "variable"])
    reason = F.format_string(
        "recommended by %s rule for %s in %s", F.col("condition_type"), F.col("variable"), F.col("condition_value")
    )
    hits = hits.select(
        *own,
        "_o",
        reason.alias("_reason"),
        F.array_intersect("recommended", pool).alias("_rec"),
        F.array_intersect("excluded", pool).alias("_exc"),
    )
    chosen = F.transform("_rec", lambda m: F.struct(F.col("_o").alias("o"), m.alias("model"), F.col("_reason").alias("reason")))
    per_context = hits.groupBy(*own).agg(
        F.array_sort(F.flatten(F.collect_list(chosen))).alias("_chosen"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_exc")))).alias("_excluded"),
        F.count(F.lit(1)).alias("_rules"),
    )
    joined = _left_null_safe(contexts.select(*own), per_context, own)
    asks = contexts.select(*own, F.lit(None).cast("int").alias("lead_hours"))
    skill = skill_by_context(entries, asks).where(F.col("model").isin(*models))
    top = best_model(skill, own).select(*own, F.col("model").alias("_top"))
    joined = _left_null_safe(joined, top, own)
    by_rule = F.coalesce("_chosen", F.array().cast("array<struct<o:int,model:string,reason:string>>"))
    fallback = F.when(
        F.col("_top").isNotNull(),
        F.array(F.struct(F.lit(9).alias("o"), F.col("_top").alias("model"), F.lit("best historical skill").alias("reason"))),
    ).otherwise(F.array().cast("array<struct<o:int,model:string,reason:string>>"))
    selected = F.when(F.size(by_rule) > 0, by_rule).otherwise(fallback)
    return joined.select(
        *own,
        F.transform(selected, lambda s: F.struct(s["model"].alias("model"), s["reason"].alias("reason"), F.lit(1.0).alias("weight"))).alias("selected_models"),
        F.coalesce("_excluded", F.array().cast("array<string>")).alias("excluded_models"),
        F.coalesce("_rules", F.lit(0)).cast("int").alias("rules_applied"),
    )


def _left_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on `keys`, where a season or region that is null or empty, which means any, matches itself."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        mine, other = F.col(k), F.col(f"_r_{k}")
        if k in MATCHING:
            mine, other = F.coalesce(mine, F.lit("")), F.coalesce(other, F.lit(""))
        on = on & mine.eqNullSafe(other)
    return left.join(renamed, on, "left").drop(*[f"_r_{k}" for k in keys])
