"""Exact quantiles of groups of any size, without holding a group in one task.

Spark's `percentile` keeps every distinct value of a group in one buffer, which
a group with a third of all rows does not fit. Here equal values are counted
first and fall into fixed logarithmic buckets of two widths. The wide buckets'
totals locate the wanted ranks, the narrow buckets inside those locate them
again, and only the values of the narrow buckets left are put in order. The
bucket of a value depends on the value alone, so recomputed partitions always
agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Relative width of the wide and narrow buckets, and the magnitude below which all is zero.
WIDE, NARROW = 1e-2, 1e-6
SMALLEST = 1e-300

Bucket = Callable[[Column], Column]


def value_bucket(width: float) -> Bucket:
    """Monotone bucket numbers of relative width `width`; never null."""

    def bucket(value: Column) -> Column:
        magnitude = F.abs(value)
        # Infinities, and NaN above them, have end buckets of their own.
        endless = F.when(F.isnan(value), F.lit(1 << 41)).when(magnitude == float("inf"), F.signum(value).cast("bigint") * (1 << 40))
        magnitude = F.when(endless.isNull(), magnitude)
        steps = F.floor((F.log(magnitude) - F.lit(math.log(SMALLEST))) / F.lit(math.log1p(width))) + 1
        signed = F.when(endless.isNull(), F.signum(value).cast("bigint")) * steps
        return F.coalesce(endless, F.when(magnitude < SMALLEST, F.lit(0)).otherwise(signed).cast("bigint"), F.lit(0))

    return bucket


def _counted(df: DataFrame, value: str, by: list[str], wide: Bucket, narrow: Bucket) -> DataFrame:
    """(by, _v, _c, _wide, _narrow): each distinct value of a group with its count and buckets."""
    rows = df.where(F.col(value).isNotNull())
    for b in by:
        rows = rows.where(F.col(b).isNotNull())
    counts = rows.select(*by, F.col(value).alias("_v")).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    # Null keys are gone and buckets are never null, so no later join adds a filter of
    # its own below the counts: all uses share one shuffle.
    return counts.withColumns({"_wide": wide(F.col("_v")), "_narrow": narrow(F.col("_v"))})


def _pick(counts: DataFrame, by: list[str], wanted: Column) -> DataFrame:
    """(by, _want, _lo_v, _hi_v): the values at each wanted pair of zero-based ranks.

    `wanted` is an array of structs with lo and hi, over the group size `_n`.
    """
    group = Window.partitionBy(*(by or [F.lit(0)]))
    totals = counts.groupBy(*by, "_wide").agg(F.sum("_c").alias("_c"))
    sized = totals.select(
        *by,
        "_wide",
        (F.sum("_c").over(group.orderBy("_wide")) - F.col("_c")).alias("_before"),
        "_c",
        F.sum("_c").over(group).alias("_n"),
    )
    broad = _with_hits(sized.withColumn("_want", wanted)).select(*by, "_wide", "_before", "_want")
    # The wanted ranks are the same in every row of a bucket, so any row may carry them.
    inner = counts.join(broad, [*by, "_wide"]).groupBy(*by, "_wide", "_narrow")
    inner = inner.agg(F.sum("_c").alias("_c"), F.min("_before").alias("_base"), F.first("_want").alias("_want"))
    along = Window.partitionBy(*by, "_wide").orderBy("_narrow")
    inner = inner.withColumn("_before", F.col("_base") + F.sum("_c").over(along) - F.col("_c"))
    exact = _with_hits(inner).select(*by, "_wide", "_narrow", "_before", "_want")
    inside = counts.join(exact, [*by, "_wide", "_narrow"])
    order = Window.partitionBy(*by, "_wide", "_narrow").orderBy("_v")
    placed = inside.withColumn("_end", F.col("_before") + F.sum("_c").over(order))
    placed = placed.withColumn("_start", F.col("_end") - F.col("_c"))
    hits = placed.select(
        *by,
        "_v",
        "_start",
        "_end",
        F.explode(F.filter("_want", lambda w: _hits(w, F.col("_start"), F.col("_end")))).alias("_want"),
    )
    return hits.groupBy(*by, "_want").agg(
        F.max(F.when(_holds(F.col("_want.lo")), F.col("_v"))).alias("_lo_v"),
        F.max(F.when(_holds(F.col("_want.hi")), F.col("_v"))).alias("_hi_v"),
    )


def _with_hits(buckets: DataFrame) -> DataFrame:
    """Buckets that hold a wanted rank, with just those ranks."""
    end = F.col("_before") + F.col("_c")
    kept = buckets.withColumn("_want", F.filter("_want", lambda w: _hits(w, F.col("_before"), end)))
    return kept.where(F.size("_want") > 0)


def _holds(rank: Column) -> Column:
    return (rank >= F.col("_start")) & (rank < F.col("_end"))


def _hits(want: Column, start: Column, end: Column) -> Column:
    lo, hi = want["lo"], want["hi"]
    return ((lo >= start) & (lo < end)) | ((hi >= start) & (hi < end))


def exact_quantiles(df: DataFrame, value: str, percentiles, by=()) -> DataFrame:
    """(by..., percentile, value) with linear interpolation between neighbouring ranks."""
    by = list(by)
    counts = _counted(df, value, by, value_bucket(WIDE), value_bucket(NARROW))

    def target(p):
        position = (F.col("_n") - 1) * F.lit(p / 100.0)
        return F.struct(
            F.lit(p).alias("percentile"),
            F.floor(position).alias("lo"),
            F.ceil(position).alias("hi"),
            position.alias("position"),
        )

    wanted = F.array(*[target(p) for p in percentiles])
    picked = _pick(counts, by, wanted)
    gap = F.col("_want.position") - F.col("_want.lo")
    # Equal neighbours, also infinite ones, are the value itself.
    between = F.col("_lo_v") + (F.col("_hi_v") - F.col("_lo_v")) * gap
    estimate = F.when(F.col("_lo_v") == F.col("_hi_v"), F.col("_lo_v")).when(gap == 0, F.col("_lo_v")).otherwise(between)
    return picked.select(*by, F.col("_want.percentile").alias("percentile"), estimate.alias("value"))


def quantile_columns(df: DataFrame, value: str, percentiles: dict[str, float], by=()) -> DataFrame:
    """The same quantiles as one column per entry of `percentiles`."""
    by = list(by)
    long = exact_quantiles(df, value, list(percentiles.values()), by)
    columns = [F.max(F.when(F.col("percentile") == p, F.col("value"))).alias(n) for n, p in percentiles.items()]
    return long.groupBy(*by).agg(*columns)


def approximate_quantiles(df: DataFrame, value: str, percentiles, by=(), accuracy: int = 10000) -> DataFrame:
    """One-pass alternative with a mergeable sketch; the error is about 1/accuracy in rank."""
    by = list(by)
    rows = df.where(F.col(value).isNotNull())
    sketch = F.percentile_approx(value, [p / 100.0 for p in percentiles], accuracy).alias("_q")
    labels = F.array(*[F.lit(p) for p in percentiles])
    grouped = rows.groupBy(*by).agg(sketch)
    packed = F.arrays_zip(labels.alias("percentile"), F.col("_q").alias("value"))
    return grouped.select(*by, F.inline(packed)).toDF(*by, "percentile", "value")


def nearest_rank_time(df: DataFrame, time_col: str, fraction: float) -> DataFrame:
    """One row `cutoff`: the time at position round((n-1)*fraction), ties to even.

    Months and days are the buckets, so no task ever orders more than a day of times.
    """
    month = lambda t: F.coalesce(F.year(t) * 12 + F.month(t), F.lit(0))
    day = lambda t: F.coalesce(F.day(t), F.lit(0))
    counts = _counted(df, time_col, [], month, day)
    rank = F.bround((F.col("_n") - 1) * F.lit(float(fraction))).cast("bigint")
    wanted = F.array(F.struct(rank.alias("lo"), rank.alias("hi")))
    return _pick(counts, [], wanted).select(F.col("_lo_v").alias("cutoff"))
