"""Error columns, lead-hour repair and canonical projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.angles import circular_error, error_of
from ..functions.temporal import lead_hours
from ..schemas import (
    CIRCULAR_ERROR_VARIABLES,
    ISSUE,
    LEAD,
    TARGET,
    error_var,
    forecast_var,
    observed_var,
    verification_schema,
)


def add_errors(df: DataFrame, variables, circular: bool = False) -> DataFrame:
    """`{v}_error = forecast_v - observed_v` for every variable present on both sides.

    With `circular`, wind directions get the shortest signed angle instead.
    """
    new = {}
    for v in variables:
        f, o = forecast_var(v), observed_var(v)
        if f in df.columns and o in df.columns:
            angle = circular and v in CIRCULAR_ERROR_VARIABLES
            new[error_var(v)] = error_of(F.col(f), F.col(o), angle)
    return df.withColumns(new) if new else df


def repair_lead_hours(df: DataFrame) -> DataFrame:
    """Add lead hours, or correct those more than an hour away from target minus issue."""
    expected = lead_hours(ISSUE, TARGET)
    if LEAD not in df.columns:
        return df.withColumn(LEAD, expected)
    wrong = F.abs(F.col(LEAD) - expected) > 1
    return df.withColumn(LEAD, F.when(wrong, expected).otherwise(F.col(LEAD)).cast("int"))


def canonical(df: DataFrame, variables) -> DataFrame:
    """Provenance then variable columns, typed; absent columns become null."""
    fields = verification_schema(variables).fields
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )


def to_long(df: DataFrame, ids: list[str], variables, value: str = "value") -> DataFrame:
    """One row per variable: (ids..., variable, value)."""
    return df.unpivot([F.col(c) for c in ids], [F.col(v) for v in variables], "variable", value)


def errors_to_long(df: DataFrame, ids: list[str], variables) -> DataFrame:
    """One row per variable with forecast, observed and error values."""
    packed = F.array(
        *[
            F.struct(
                F.lit(v).alias("variable"),
                F.col(forecast_var(v)).alias("forecast_value"),
                F.col(observed_var(v)).alias("observation_value"),
                F.col(error_var(v)).alias("error"),
            )
            for v in variables
        ]
    )
    return df.select(*ids, F.inline(packed))


def runs_to_long(df: DataFrame, ids: list[str], times: str = "times", variables: str = "variables") -> DataFrame:
    """Nested runs (array of times, map of variable -> array of values) to one row per value."""
    per_variable = df.select(*ids, times, F.explode(variables).alias("variable", "_values"))
    per_time = per_variable.select(*ids, times, "variable", F.posexplode("_values").alias("_i", "value"))
    return per_time.select(*ids, "variable", F.to_timestamp(F.get(times, F.col("_i"))).alias("valid_time"), "value")


def record_errors(aligned: DataFrame) -> DataFrame:
    """error, absolute, squared error and bias contribution of fully matched long rows."""
    f, o = F.col("forecast_value"), F.col("observation_value")
    both = (F.col("match_status") == "matched") & f.isNotNull() & o.isNotNull()
    angle = F.col("variable").isin(*CIRCULAR_ERROR_VARIABLES)
    error = F.when(both, F.when(angle, circular_error(f, o)).otherwise(f - o))
    with_error = aligned.withColumn("error", error)
    return with_error.withColumns(
        {
            "absolute_error": F.abs("error"),
            "squared_error": F.col("error") * F.col("error"),
            "bias_contribution": F.col("error"),
        }
    )
