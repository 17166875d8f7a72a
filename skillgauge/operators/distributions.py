"""Histograms, box statistics and site-level error structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import error_var
from .quantiles import quantile_columns


def variation_flag(df: DataFrame, value: str, by=(), tiny: float = 1e-9) -> DataFrame:
    """Whether each group has values that are not all (about) zero."""
    v = F.col(value)
    stats = df.groupBy(*by).agg(F.count(v).alias("n"), F.stddev_pop(v).alias("_s"), F.max(F.abs(v)).alias("_m"))
    flat = (F.col("n") > 1) & (F.col("_s") < tiny) & (F.col("_m") < tiny)
    return stats.select(*by, "n", ((F.col("n") > 0) & ~F.coalesce(flat, F.lit(False))).alias("has_variation"))


def histogram(df: DataFrame, value: str, bins: int = 50, low: float | None = None, high: float | None = None) -> DataFrame:
    """Equal-width counts (bin 1..bins); the last bin includes its right edge.

    Without given edges the data's own minimum and maximum are used, fetched by
    one one-row subquery. Values outside given edges do not count.
    """
    v = F.col(value)
    rows = df.where(v.isNotNull()).select(v.alias("_v"))
    if low is None or high is None:
        edges = rows.agg(F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi"))).scalar()
        lo, hi = edges["lo"], edges["hi"]
    else:
        lo, hi = F.lit(float(low)), F.lit(float(high))
        rows = rows.where(F.col("_v").between(low, high))
    width = (hi - lo) / F.lit(float(bins))
    position = F.floor((F.col("_v") - lo) / width) + 1
    number = F.when(width == 0, F.lit(1)).otherwise(F.least(position, F.lit(bins))).cast("int")
    binned = rows.select(number.alias("bin"), lo.alias("_lo"), width.alias("_w"))
    counted = binned.groupBy("bin", "_lo", "_w").agg(F.count(F.lit(1)).alias("count"))
    edge = F.col("_lo") + (F.col("bin") - 1) * F.col("_w")
    return counted.select("bin", edge.alias("left_edge"), (edge + F.col("_w")).alias("right_edge"), "count")


def distribution_summary(df: DataFrame, variable: str, by=()) -> DataFrame:
    """Mean, median, sample std, count and the 10/25/75/90 marks of the errors."""
    by, e = list(by), error_var(variable)
    rows = df.where(F.col(e).isNotNull())
    stats = rows.groupBy(*by).agg(F.avg(e).alias("mean"), F.stddev_samp(e).alias("std"), F.count(e).alias("n"))
    marks = quantile_columns(rows, e, {"p10": 10, "p25": 25, "median": 50, "p75": 75, "p90": 90}, by)
    return stats.join(marks, by) if by else stats.withColumn("_k", F.lit(1)).join(marks.withColumn("_k", F.lit(1)), "_k").drop("_k")


def box_statistics(df: DataFrame, variable: str, by=("lead_hours",), reach: float = 1.5) -> DataFrame:
    """Median, quartiles, whiskers at `reach` IQR and outlier count per group."""
    by, e = list(by), error_var(variable)
    rows = df.where(F.col(e).isNotNull()).select(*by, F.col(e).alias("_e"))
    # Equal errors of a group are counted once, so a hot group meets its quartiles spread out.
    counted = rows.groupBy(*by, "_e").agg(F.count(F.lit(1)).alias("_c"))
    box = quantile_columns(rows, "_e", {"q1": 25, "median": 50, "q3": 75}, by)
    iqr = F.col("q3") - F.col("q1")
    fenced = counted.join(box, by).withColumns({"_lo": F.col("q1") - reach * iqr, "_hi": F.col("q3") + reach * iqr})
    inside = F.col("_e").between(F.col("_lo"), F.col("_hi"))
    return fenced.groupBy(*by, "q1", "median", "q3").agg(
        # A whisker never ends inside the box.
        F.least(F.min(F.when(inside, F.col("_e"))), F.col("q1")).alias("whisker_low"),
        F.greatest(F.max(F.when(inside, F.col("_e"))), F.col("q3")).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("_c"))), F.lit(0)).alias("outliers"),
        F.sum("_c").alias("n"),
    )


def correlation_matrix(df: DataFrame, group: list[str], variables) -> DataFrame:
    """Pearson correlation of per-group MAE for every pair of variables."""
    mae = df.groupBy(*group).agg(*[F.avg(F.abs(error_var(v))).alias(v) for v in variables])
    pairs = [(a, b) for a in variables for b in variables]
    row = mae.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    packed = [
        F.struct(F.lit(a).alias("variable_a"), F.lit(b).alias("variable_b"), F.col(f"_{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.inline(F.array(*packed)))


def lead_band(lead: Column, bands) -> Column:
    """Index of the half-open band [low, high) holding the lead, else null."""
    out = F.lit(None).cast("int")
    for i, (low, high) in enumerate(bands):
        out = F.when((lead >= low) & (lead < high), F.lit(i)).otherwise(out)
    return out


def band_mae(df: DataFrame, group: list[str], error: str, bands) -> DataFrame:
    """MAE per group and lead band, with the band's limits."""
    index = lead_band(F.col("lead_hours"), bands)
    rows = df.withColumn("band", index).where(F.col("band").isNotNull())
    limits = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in bands])
    out = rows.groupBy(*group, "band").agg(F.avg(F.abs(error)).alias("mae"))
    return out.withColumn("_l", F.get(limits, F.col("band"))).select(*group, "band", "_l.low", "_l.high", "mae")


def lead_variation(df: DataFrame, group: list[str], error: str) -> DataFrame:
    """Coefficient of variation (sample std / mean) of the per-lead MAE of each group."""
    per_lead = df.groupBy(*group, "lead_hours").agg(F.avg(F.abs(error)).alias("_mae"))
    return per_lead.groupBy(*group).agg(F.try_divide(F.stddev_samp("_mae"), F.avg("_mae")).alias("lead_cv"))


def mae_grid(df: DataFrame, rows: str, columns: str, errors: dict[str, str]) -> DataFrame:
    """MAE matrix in long form: one row per (rows, columns) cell, one column per error."""
    cells = df.groupBy(rows, columns).agg(*[F.avg(F.abs(e)).alias(n) for n, e in errors.items()])
    return cells
