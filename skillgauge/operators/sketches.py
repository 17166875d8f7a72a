"""Mergeable quantile sketches of errors: kept instead of the rows, merged to any grouping.

A KLL sketch has a bounded size whatever it has seen. The rank of a quantile is off by
less than 2.3 / K ** 0.9 of all values (0.24 %) with a probability of 99 %; merging
loses no more. Counts, the least and the greatest value are exact. Where quantiles must be exact, `quantiles`
has them, from the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import error_var

K = 2000
# Rank error that quantiles keep within, as a share of all values: four times that bound.
RANK_ERROR = 0.01


def error_sketches(df: DataFrame, by, variables, k: int = K) -> DataFrame:
    """by, variable, sketch, n of every variable's errors, from one pass; a group without errors of a variable has no row."""
    wide = []
    for i, v in enumerate(variables):
        e = F.col(error_var(v)).cast("double")
        wide += [F.kll_sketch_agg_double(e, F.lit(k)).alias(f"_s{i}"), F.count(e).alias(f"_n{i}")]
    held = df.groupBy(*by).agg(*wide)
    rows = [F.struct(F.lit(v).alias("variable"), F.col(f"_s{i}").alias("sketch"), F.col(f"_n{i}").alias("n")) for i, v in enumerate(variables)]
    return held.select(*by, F.inline(F.array(*rows))).where("n > 0")


def merged_sketches(sketches: DataFrame, by=()) -> DataFrame:
    """by, variable, sketch, n of coarser groups; rows whose key is null are left out."""
    for b in by:
        sketches = sketches.where(F.col(b).isNotNull())
    return sketches.groupBy(*by, "variable").agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))


def sketch_quantiles(sketches: DataFrame, percentiles) -> DataFrame:
    """One row per sketch and percentile: percentile, value; 0 and 100 are exact."""
    ranks = F.array(*[F.lit(p / 100.0) for p in percentiles])
    values = F.kll_sketch_get_quantile_double(F.col("sketch"), ranks)
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in percentiles]).alias("percentile"), values.alias("value"))
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], F.inline(pairs))


def share_below(sketch: Column, value: Column) -> Column:
    """About which share of a sketch's values is at most `value`."""
    return F.kll_sketch_get_rank_double(sketch, value)
