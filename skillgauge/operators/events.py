"""Binary events, contingency tables, skill scores and the climatology baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import SCORES, score
from ..functions.thresholds import OPERATORS, meets
from ..schemas import DIMENSIONS, EVENTS, MODEL, TARGET, forecast_var, observed_var
from ..session import literal_table
from .metrics import with_dimensions

EventCatalog = dict[str, tuple[str, float, str]]
COUNTS = ("hits", "misses", "false_alarms", "correct_negatives")


def event_definition(name: str, catalog: EventCatalog = EVENTS) -> tuple[str, float, str]:
    if name not in catalog:
        raise ValueError(f"unknown event {name!r}, expected one of {sorted(catalog)}")
    return catalog[name]


def forecast_event_col(name: str) -> str:
    return f"event_forecast_{name}"


def observed_event_col(name: str) -> str:
    return f"event_observed_{name}"


def event_flags(
    df: DataFrame,
    name: str,
    variable: str | None = None,
    threshold: float | None = None,
    operator: str | None = None,
    catalog: EventCatalog = EVENTS,
) -> DataFrame:
    """Add `event_forecast_{name}` / `event_observed_{name}`.

    Either a catalog event by name, or a custom one by all of variable,
    threshold and operator (a custom event still needs its own name).
    """
    custom = (variable, threshold, operator)
    if name in catalog:
        if any(x is not None for x in custom):
            raise ValueError(f"{name!r} is a catalog event; give either a name or a definition")
        variable, threshold, operator = catalog[name]
    elif any(x is None for x in custom):
        raise ValueError(f"unknown event {name!r}; a custom event needs variable, threshold and operator")
    missing = [c for c in (forecast_var(variable), observed_var(variable)) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing} for event {name!r}")
    return df.withColumns(
        {
            forecast_event_col(name): meets(F.col(forecast_var(variable)), threshold, operator),
            observed_event_col(name): meets(F.col(observed_var(variable)), threshold, operator),
        }
    )


def event_catalog(df: DataFrame, catalog: EventCatalog = EVENTS) -> DataFrame:
    """The event definitions as a table (name, variable, threshold, operator)."""
    schema = "event_name string, variable string, threshold double, operator string"
    return literal_table(df.sparkSession, [(n, *d) for n, d in catalog.items()], schema)


def contingency(df: DataFrame, names, dims=(), catalog: EventCatalog = EVENTS) -> DataFrame:
    """Contingency counts per group for one or several events, in a single aggregate.

    Pairs with a missing forecast or observation are excluded and counted.
    """
    names = [names] if isinstance(names, str) else list(names)
    dims = list(dims)
    bad = [d for d in dims if d not in DIMENSIONS]
    if bad:
        raise ValueError(f"unknown dimension: {bad}")
    df = with_dimensions(df, dims)
    aggregates: list[Column] = [F.count(F.lit(1)).alias("_total")]
    rows = []
    for i, name in enumerate(names):
        variable, threshold, operator = event_definition(name, catalog)
        f, o = F.col(forecast_var(variable)), F.col(observed_var(variable))
        pair = f.isNotNull() & o.isNotNull()
        fe, oe = meets(f, threshold, operator), meets(o, threshold, operator)
        aggregates += [
            F.count_if(pair & fe & oe).alias(f"_h{i}"),
            F.count_if(pair & ~fe & oe).alias(f"_m{i}"),
            F.count_if(pair & fe & ~oe).alias(f"_f{i}"),
            F.count_if(pair & ~fe & ~oe).alias(f"_c{i}"),
            F.count_if(~pair).alias(f"_x{i}"),
        ]
        counts = [F.col(f"_{k}{i}").alias(n) for k, n in zip("hmfc", COUNTS, strict=True)]
        rows.append(
            F.struct(
                F.lit(name).alias("event_name"),
                F.lit(variable).alias("variable"),
                F.lit(float(threshold)).alias("threshold"),
                F.lit(operator).alias("operator"),
                *counts,
                F.col(f"_x{i}").alias("excluded_nan"),
                (F.col("_total") - F.col(f"_x{i}")).alias("sample_size"),
                F.col("_total").alias("total_rows"),
            )
        )
    grouped = df.groupBy(*dims).agg(*aggregates)
    return grouped.where(F.col("_total") > 0).select(*dims, F.inline(F.array(*rows)))


def skill_scores(table: DataFrame) -> DataFrame:
    """Seven scores per contingency row; all four dimension columns are always there."""
    types = {"lead_hours": T.IntegerType(), "model": T.StringType(), "month": T.IntegerType(), "season": T.StringType()}
    dims = [(F.col(d) if d in table.columns else F.lit(None)).cast(types[d]).alias(d) for d in DIMENSIONS]
    long = F.array(*[F.struct(F.lit(n).alias("metric_name"), score(n).alias("metric_value")) for n in SCORES])
    return table.select(
        *dims,
        "event_name",
        "variable",
        F.inline(long),
        F.col("sample_size"),
        F.col("total_rows"),
        F.col("excluded_nan").alias("missing_count"),
    )


def model_comparison(df: DataFrame, name: str, metric: str, dims=(), catalog: EventCatalog = EVENTS) -> DataFrame:
    """One score per model (and further dimensions)."""
    if metric not in SCORES:
        raise ValueError(f"unknown score {metric!r}, expected one of {sorted(SCORES)}")
    keys = list(dict.fromkeys([MODEL, *dims]))
    scores = skill_scores(contingency(df, name, keys, catalog))
    return scores.where(F.col("metric_name") == metric).select(
        *keys, "event_name", "metric_name", "metric_value", "sample_size"
    )


def best_model(comparison: DataFrame) -> DataFrame:
    """The model with the highest score per event; the name decides ties."""
    top = F.max_by(F.struct("model", "metric_value"), F.struct("metric_value", "model")).alias("_top")
    rows = comparison.where(F.col("metric_value").isNotNull())
    return rows.groupBy("event_name", "metric_name").agg(top).select("event_name", "metric_name", "_top.*")


def climatology(
    df: DataFrame, name: str, dims=(), catalog: EventCatalog = EVENTS, exclude_missing: bool = False
) -> DataFrame:
    """Observed event frequency per group.

    Event flags are never null, so unobserved rows count as non-events; with
    `exclude_missing` they do not count at all.
    """
    variable, threshold, operator = event_definition(name, catalog)
    dims = list(dims)
    o = F.col(observed_var(variable))
    rows = with_dimensions(df, dims)
    if exclude_missing:
        rows = rows.where(o.isNotNull())
    out = rows.groupBy(*dims).agg(
        F.avg(meets(o, threshold, operator).cast("double")).alias("climatology_prob"),
        F.count(F.lit(1)).alias("sample_size"),
        F.count(F.lit(1)).alias("total_rows"),
    )
    return out.select(*dims, F.lit(name).alias("event_name"), "climatology_prob", "sample_size", "total_rows")


def climatology_skill(table: DataFrame, baseline: DataFrame, dims=()) -> DataFrame:
    """CSI of forecast and climatology with both relative forms.

    `relative_skill` is 1 - (f - c)/(1 - c), so larger is worse; `csi_skill` is
    the usual (f - c)/(1 - c).
    """
    dims = list(dims)
    p = baseline.select(*dims, "event_name", "climatology_prob")
    joined = table.join(p, ["event_name", *dims])
    events = F.col("hits") + F.col("misses")
    quiet = F.col("false_alarms") + F.col("correct_negatives")
    prob = F.col("climatology_prob")
    # The constant "always" forecast catches int(events * p) and raises int(quiet * p) false alarms.
    caught, raised = F.floor(events * prob), F.floor(quiet * prob)
    clim = F.when(prob > 0.5, F.try_divide(caught.cast("double"), (events + raised).cast("double"))).otherwise(0.0)
    out = joined.select(*dims, "event_name", score("csi").alias("forecast_csi"), clim.alias("climatology_csi"))
    f, c = F.col("forecast_csi"), F.col("climatology_csi")
    gain = F.try_divide(f - c, F.lit(1.0) - c)
    return out.withColumns({"relative_skill": F.lit(1.0) - gain, "csi_skill": gain})


# Category names and default thresholds of the threshold sweep.
CATEGORIES = ("Hit", "Miss", "FalseAlarm", "CorrectRejection")
SWEEP = (0.1, 1.0, 5.0, 10.0, 25.0)


def classify(df: DataFrame, variable: str, threshold: float) -> DataFrame:
    """Category of every complete pair for the event `value >= threshold`."""
    f, o = F.col(forecast_var(variable)), F.col(observed_var(variable))
    fe, oe = f >= threshold, o >= threshold
    category = (
        F.when(fe & oe, CATEGORIES[0])
        .when(~fe & oe, CATEGORIES[1])
        .when(fe & ~oe, CATEGORIES[2])
        .otherwise(CATEGORIES[3])
    )
    return df.where(f.isNotNull() & o.isNotNull()).withColumn("event_category", category)


def threshold_sweep(df: DataFrame, variable: str, thresholds=SWEEP, by=()) -> DataFrame:
    """Counts, rates and event frequencies per threshold, from one aggregate."""
    f, o = F.col(forecast_var(variable)), F.col(observed_var(variable))
    pairs = df.where(f.isNotNull() & o.isNotNull())
    aggregates = [F.count(F.lit(1)).alias("_n")]
    for i, t in enumerate(thresholds):
        aggregates += [
            F.count_if((f >= t) & (o >= t)).alias(f"_h{i}"),
            F.count_if((f < t) & (o >= t)).alias(f"_m{i}"),
            F.count_if((f >= t) & (o < t)).alias(f"_f{i}"),
        ]
    grouped = pairs.groupBy(*by).agg(*aggregates)
    rows = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.col(f"_h{i}").alias("hits"),
            F.col(f"_m{i}").alias("misses"),
            F.col(f"_f{i}").alias("false_alarms"),
            (F.col("_n") - F.col(f"_h{i}") - F.col(f"_m{i}") - F.col(f"_f{i}")).alias("correct_negatives"),
        )
        for i, t in enumerate(thresholds)
    ]
    table = grouped.select(*by, "_n", F.inline(F.array(*rows)))
    return table.withColumns(
        {
            "hit_rate": score("hit_rate"),
            "false_alarm_rate": score("false_alarm_rate"),
            "csi": score("csi"),
            "observed_pct": F.try_divide((F.col("hits") + F.col("misses")) * 100.0, F.col("_n").cast("double")),
            "forecast_pct": F.try_divide((F.col("hits") + F.col("false_alarms")) * 100.0, F.col("_n").cast("double")),
        }
    ).drop("_n")


def event_contingency(df: DataFrame, variable: str, threshold: float, by=()) -> DataFrame:
    """2x2 counts as columns, with total and rates (null when undefined)."""
    rows = classify(df, variable, threshold)
    names = dict(zip(CATEGORIES, COUNTS, strict=True))
    counts = [F.count_if(F.col("event_category") == c).alias(n) for c, n in names.items()]
    table = rows.groupBy(*by).agg(*counts, F.count(F.lit(1)).alias("total"))
    return table.withColumns(
        {"hit_rate": score("hit_rate"), "false_alarm_rate": score("false_alarm_rate"), "csi": score("csi")}
    )


def event_rows(df: DataFrame, catalog: EventCatalog = EVENTS, only_events: bool = False) -> DataFrame:
    """Forecast-side and observation-side event rows of every catalog event.

    One row per event, side and non-null value with flag, threshold and date;
    `only_events` keeps the rows where the event happened.
    """
    sides = []
    for name, (variable, threshold, operator) in catalog.items():
        for side, column in (("forecast", forecast_var(variable)), ("observed", observed_var(variable))):
            if column not in df.columns:
                continue
            if operator not in OPERATORS:
                raise ValueError(f"unknown operator {operator!r}")
            sides.append(
                F.struct(
                    F.lit(name).alias("event_name"),
                    F.lit(side).alias("source"),
                    F.lit(variable).alias("variable"),
                    F.lit(float(threshold)).alias("threshold"),
                    F.col(column).alias("value"),
                    meets(F.col(column), threshold, operator).alias("is_event"),
                )
            )
    keep = [c for c in ("forecast_issue_time", TARGET, "lead_hours", "model", "location_id") if c in df.columns]
    rows = df.select(*keep, F.to_date(TARGET).alias("event_date"), F.inline(F.array(*sides)))
    rows = rows.where(F.col("value").isNotNull())
    return rows.where("is_event") if only_events else rows


def combined_events(df: DataFrame, name: str, catalog: EventCatalog = EVENTS) -> DataFrame:
    """Verification rows where the event was forecast or observed."""
    variable, threshold, operator = event_definition(name, catalog)
    either = meets(F.col(forecast_var(variable)), threshold, operator) | meets(
        F.col(observed_var(variable)), threshold, operator
    )
    return df.where(either)
