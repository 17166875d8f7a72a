"""Grouped error metrics in one pass over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import variable_type
from ..functions.temporal import season_of, with_calendar
from ..schemas import DIMENSIONS, METRICS, error_var, forecast_var, observed_var
from ..session import materialize

# Metric name -> aggregate over an error column (nulls skipped).
METRIC_AGGREGATES = {
    "mae": lambda e: F.avg(F.abs(e)),
    "rmse": lambda e: F.sqrt(F.avg(e * e)),
    "bias": lambda e: F.avg(e),
    "std": lambda e: F.stddev_samp(e),
}
COUNTS = ("sample_size", "total_rows", "missing_count")


def check_arguments(df: DataFrame, dims, metrics, variables, allowed=DIMENSIONS) -> None:
    """Reject unknown or repeated dimensions and metrics, and variables without errors."""
    for what, given, valid in (("dimension", dims, allowed), ("metric", metrics, METRICS)):
        unknown = [x for x in given if x not in valid]
        if unknown:
            raise ValueError(f"unknown {what}: {unknown}, expected {sorted(valid)}")
        if len(set(given)) != len(list(given)):
            raise ValueError(f"repeated {what} in {list(given)}")
    if not metrics or not variables:
        raise ValueError("at least one metric and one variable are needed")
    missing = [error_var(v) for v in variables if error_var(v) not in df.columns]
    if missing:
        raise ValueError(f"missing error columns: {missing}")


def with_dimensions(df: DataFrame, dims) -> DataFrame:
    """Derive missing calendar dimensions and drop rows whose key is null."""
    df = with_calendar(df, dims)
    absent = [d for d in dims if d not in df.columns]
    if absent:
        raise ValueError(f"missing dimension columns: {absent}")
    for d in dims:
        df = df.where(F.col(d).isNotNull())
    return df


def grouped_metrics(df: DataFrame, dims, variables, metrics=METRICS) -> DataFrame:
    """Long table: dims, variable, metric_name, metric_value and counts.

    All variables and metrics come from a single aggregate, so rows are neither
    multiplied before the shuffle nor read twice; only group rows are unfolded.
    """
    dims, metrics = list(dims), list(metrics)
    check_arguments(df, dims, metrics, variables)
    df = with_dimensions(df, dims)
    aggregates: list[Column] = [F.count(F.lit(1)).alias("_total")]
    for i, v in enumerate(variables):
        e = F.col(error_var(v))
        aggregates.append(F.count(e).alias(f"_n{i}"))
        aggregates += [METRIC_AGGREGATES[m](e).alias(f"_{m}{i}") for m in metrics]
    wide = df.groupBy(*dims).agg(*aggregates) if dims else df.agg(*aggregates)
    rows = [
        _metric_row(v, m, F.col(f"_{m}{i}"), F.col(f"_n{i}"), F.col("_total"))
        for i, v in enumerate(variables)
        for m in metrics
    ]
    return wide.select(*dims, F.inline(F.array(*rows)))


def _metric_row(variable: str, metric: str, value: Column, n: Column, total: Column) -> Column:
    return F.struct(
        F.lit(variable).alias("variable"),
        F.lit(metric).alias("metric_name"),
        value.alias("metric_value"),
        n.alias("sample_size"),
        total.alias("total_rows"),
        (total - n).alias("missing_count"),
    )


def summary_by_lead_time(df, variables, metrics=METRICS):
    return grouped_metrics(df, ["lead_hours"], variables, metrics)


def summary_by_model_and_lead(df, variables, metrics=METRICS):
    return grouped_metrics(df, ["model", "lead_hours"], variables, metrics)


def summary_by_month(df, variables, metrics=METRICS):
    return grouped_metrics(df, ["month"], variables, metrics)


def summary_by_season(df, variables, metrics=METRICS):
    return grouped_metrics(df, ["season"], variables, metrics)


# Moments of a variable's errors, in this order: count, sums of magnitudes and squares, mean, and squared distances from the mean.
MOMENTS = ("n", "abs", "square", "mean", "spread")


def moment(variable: str, name: str) -> str:
    return f"{variable}_{name}"


def error_moments(df: DataFrame, dims, variables) -> DataFrame:
    """dims, row_total and the moments of each variable: all that any coarser grouping's metrics need."""
    base: list[Column] = [F.count(F.lit(1)).alias("row_total")]
    for v in variables:
        e = F.col(error_var(v))
        values = (F.count(e), F.sum(F.abs(e)), F.sum(e * e), F.avg(e), F.var_pop(e) * F.count(e))
        base += [value.alias(moment(v, name)) for name, value in zip(MOMENTS, values, strict=True)]
    return df.groupBy(*dims).agg(*base)


def metrics_by_grouping_sets(df: DataFrame, sets, variables, metrics=METRICS) -> DataFrame:
    """Several groupings of one table: `grouping`, all dims (null when unused), metrics.

    The table is reduced once to moments per combination of all dimensions, which are
    written; the grouping sets then expand that small table, never the rows.
    """
    sets = [list(s) for s in sets]
    dims = list(dict.fromkeys(d for s in sets for d in s))
    check_arguments(df, dims, metrics, variables)
    # Null keys are dropped per grouping, as a single-dimension grouping would.
    return merged_moments(materialize(error_moments(with_calendar(df, dims), dims, variables), "moments"), sets, variables, metrics)


def merged_moments(moments: DataFrame, sets, variables, metrics=METRICS) -> DataFrame:
    """Metrics of several groupings from the moments of finer groups, of which there may be several for one combination of dims.

    `moments` is read twice, so it should be a stored table.
    """
    sets = [list(s) for s in sets]
    dims = list(dict.fromkeys(d for s in sets for d in s))
    of = lambda v, name: F.col(moment(v, name))
    merged: list[Column] = [F.grouping_id().alias("_gid"), F.sum("row_total").alias("_total")]
    for i, v in enumerate(variables):
        n = of(v, "n")
        merged += [
            F.sum(n).alias(f"_n{i}"),
            F.sum(of(v, "abs")).alias(f"_a{i}"),
            F.sum(of(v, "square")).alias(f"_q{i}"),
            F.sum(n * of(v, "mean")).alias(f"_t{i}"),
            F.sum(of(v, "spread")).alias(f"_s{i}"),
        ]
    expanded = moments.groupingSets([[F.col(d) for d in s] for s in sets], *[F.col(d) for d in dims])
    rolled = expanded.agg(*merged)
    rolled = _with_between(moments, rolled, sets, dims, list(variables))
    names = {_grouping_id(dims, s): s for s in sets}
    label, keep = F.lit(None).cast("string"), F.lit(False)
    for gid, s in names.items():
        label = F.when(F.col("_gid") == gid, F.lit("+".join(s))).otherwise(label)
        complete = F.col("_gid") == gid
        for d in s:
            complete = complete & F.col(d).isNotNull()
        keep = keep | complete
    rows = []
    for i, v in enumerate(variables):
        n = F.col(f"_n{i}")
        mean = F.try_divide(F.col(f"_t{i}"), n)
        spread = F.col(f"_s{i}") + F.col(f"_b{i}")
        values = {
            "mae": F.try_divide(F.col(f"_a{i}"), n),
            "rmse": F.sqrt(F.try_divide(F.col(f"_q{i}"), n)),
            "bias": mean,
            "std": F.when(n > 1, F.sqrt(spread / (n - 1))),
        }
        rows += [_metric_row(v, m, values[m], n, F.col("_total")) for m in metrics]
    return rolled.where(keep).select(label.alias("grouping"), *dims, F.inline(F.array(*rows)))


def _with_between(moments: DataFrame, rolled: DataFrame, sets, dims: list[str], variables: list[str]) -> DataFrame:
    """`rolled` with the spread of the merged groups' means around the mean of each merged group.

    Squares of the deviations themselves are summed, so a large common mean costs
    no digits. Both tables have a row per combination of dimensions.
    """
    masks = [
        F.struct(F.lit(_grouping_id(dims, s)).alias("_gid"), *[(F.col(d) if d in s else F.lit(None).cast(moments.schema[d].dataType)).alias(f"_g_{d}") for d in dims])
        for s in sets
    ]
    parts = moments.select(*[moment(v, name) for v in variables for name in ("n", "mean")], F.inline(F.array(*masks)))
    means = rolled.select(
        F.col("_gid").alias("_mid"),
        *[F.col(d).alias(f"_m_{d}") for d in dims],
        *[F.try_divide(F.col(f"_t{i}"), F.col(f"_n{i}")).alias(f"_mean{i}") for i in range(len(variables))],
    )
    same = F.col("_gid") == F.col("_mid")
    for d in dims:
        same = same & F.col(f"_g_{d}").eqNullSafe(F.col(f"_m_{d}"))
    off = [F.col(moment(v, "mean")) - F.col(f"_mean{i}") for i, v in enumerate(variables)]
    between = parts.join(means, same).groupBy("_mid", *[f"_m_{d}" for d in dims])
    between = between.agg(*[F.sum(F.col(moment(variables[i], "n")) * o * o).alias(f"_b{i}") for i, o in enumerate(off)])
    back = F.col("_gid") == F.col("_mid")
    for d in dims:
        back = back & F.col(d).eqNullSafe(F.col(f"_m_{d}"))
    return rolled.join(between, back).drop("_mid", *[f"_m_{d}" for d in dims])


def _grouping_id(dims: list[str], present: list[str]) -> int:
    return sum(1 << (len(dims) - 1 - k) for k, d in enumerate(dims) if d not in present)


def evaluations(
    aligned: DataFrame,
    group_by: str | None = None,
    min_sample_size: int = 1,
    keep_undefined: bool | None = None,
    by=(),
) -> DataFrame:
    """Long evaluations of aligned records with coverage, stability and time range.

    `group_by` is None or one of lead_time, variable, location, run_time, season,
    month; `by` adds plain columns to the key. Groups without a matched pair are
    dropped, except by season and month. The variance is the population variance.
    """
    keys = {
        None: {},
        "lead_time": {"lead_hours": F.col("lead_hours")},
        "variable": {"variable": F.col("variable")},
        "location": {"latitude": F.col("latitude"), "longitude": F.col("longitude")},
        "run_time": {"forecast_run_time": F.col("forecast_run_time")},
        "season": {"season": season_of("valid_time")},
        "month": {"month": F.month("valid_time")},
    }
    if group_by not in keys:
        raise ValueError(f"unknown grouping {group_by!r}")
    dims = {**{c: F.col(c) for c in by}, **keys[group_by]}
    if keep_undefined is None:
        keep_undefined = group_by in ("season", "month")
    df = aligned.withColumns({k: c for k, c in dims.items() if k not in aligned.columns})
    if group_by == "run_time":
        df = df.where(F.col("forecast_run_time").isNotNull())
    e = F.col("error")
    stats = df.groupBy(*dims).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("bias"),
        F.var_pop(e).alias("error_variance"),
        F.count(e).alias("sample_size"),
        F.count(F.lit(1)).alias("total_count"),
        F.min("valid_time").alias("range_start"),
        F.max("valid_time").alias("range_end"),
        F.min("variable").alias("_variable"),
    )
    shown = F.col("variable") if "variable" in dims else F.col("_variable")
    n, total = F.col("sample_size"), F.col("total_count")
    # Metric types of an evaluation.
    kinds = ("mae", "rmse", "bias", "error_variance")
    metric = F.explode(F.array(*[F.struct(F.lit(k).alias("metric_type"), F.col(k).alias("value")) for k in kinds]))
    out = stats.select(
        *dims,
        *([] if "variable" in dims else [shown.alias("variable")]),
        variable_type(shown).alias("variable_type"),
        metric.alias("_m"),
        "sample_size",
        "total_count",
        coverage(n, total).alias("coverage_fraction"),
        (n >= min_sample_size).alias("is_stable"),
        "range_start",
        "range_end",
    )
    out = out.select("*", "_m.*").drop("_m")
    return out if keep_undefined else out.where(F.col("value").isNotNull())


def coverage(n: Column, total: Column) -> Column:
    """n/total; without a total, 0 for an empty group and 1 otherwise."""
    return F.when(total > 0, n / total).when(n == 0, F.lit(0.0)).otherwise(F.lit(1.0))


def evaluation_of_group(aligned: DataFrame, metric_type: str, group_by: str, key) -> DataFrame:
    """One group's evaluation; the key filter reaches the rows before the aggregate."""
    column = {"lead_time": "lead_hours", "run_time": "forecast_run_time"}.get(group_by, group_by)
    if group_by == "location":
        rows = aligned.where((F.col("latitude") == key[0]) & (F.col("longitude") == key[1]))
    elif group_by in ("season", "month"):
        derived = season_of("valid_time") if group_by == "season" else F.month("valid_time")
        rows = aligned.where(derived == key)
    else:
        rows = aligned.where(F.col(column) == key)
    return evaluations(rows, group_by).where(F.col("metric_type") == metric_type)


def error_statistics(aligned: DataFrame, by=()) -> DataFrame:
    """mean error, MAE, RMSE, bias, population variance and size over matched rows."""
    e = F.col("error")
    return aligned.groupBy(*by).agg(
        F.avg(e).alias("mean_error"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("bias"),
        F.var_pop(e).alias("error_variance"),
        F.count(e).alias("sample_size"),
    )


def rmse_by_lead(df: DataFrame, variables) -> DataFrame:
    """Per variable and non-negative lead: pair count and RMSE (joined on lead, not position)."""
    rows = df.where(F.col("lead_hours") >= 0)
    stats = [s for i, v in enumerate(variables) for s in _pair_stats(v, i)]
    wide = rows.groupBy("lead_hours").agg(*stats)
    packed = F.array(
        *[
            F.struct(F.lit(v).alias("variable"), F.col(f"_n{i}").alias("count"), F.col(f"_r{i}").alias("rmse"))
            for i, v in enumerate(variables)
        ]
    )
    return wide.select("lead_hours", F.inline(packed)).where(F.col("count") > 0)


def _pair_stats(v: str, i: int) -> list[Column]:
    d = F.col(forecast_var(v)) - F.col(observed_var(v))
    return [
        F.count(d).alias(f"_n{i}"),
        F.sqrt(F.avg(d * d)).alias(f"_r{i}"),
        F.avg(F.abs(d)).alias(f"_a{i}"),
        F.avg(d).alias(f"_b{i}"),
    ]


def errors_by_season(df: DataFrame, variables) -> DataFrame:
    """Per variable and season: pair count, MAE and the season's own bias."""
    rows = with_dimensions(df, ["season"])
    wide = rows.groupBy("season").agg(*[s for i, v in enumerate(variables) for s in _pair_stats(v, i)])
    packed = F.array(
        *[
            F.struct(
                F.lit(v).alias("variable"),
                F.col(f"_n{i}").alias("count"),
                F.col(f"_a{i}").alias("mae"),
                F.col(f"_b{i}").alias("bias"),
            )
            for i, v in enumerate(variables)
        ]
    )
    return wide.select("season", F.inline(packed)).where(F.col("count") > 0)


def combined_lead_table(df: DataFrame, variables) -> DataFrame:
    """Wide table: one row per lead with `{v}_rmse` of every variable."""
    rows = df.where(F.col("lead_hours") >= 0)
    picked = [s for i, v in enumerate(variables) for s in _pair_stats(v, i)]
    wide = rows.groupBy("lead_hours").agg(*picked)
    return wide.select("lead_hours", *[F.col(f"_r{i}").alias(f"{v}_rmse") for i, v in enumerate(variables)])

