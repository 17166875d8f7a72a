"""Joins of forecasts with observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import with_calendar
from ..schemas import ELEV, LAT, LOCATION, LON, OBS_TIME, TARGET, forecast_var, observed_var
from ..session import materialize
from .errors import add_errors, canonical, record_errors
from .interpolate import collapse_corners, interpolate_to_sites, sites_of
from .locations import require_compatible

POINT = (LAT, LON, ELEV)


def join_keys(forecasts: DataFrame, observations: DataFrame, point_keys: bool | None = None) -> list[str]:
    """Location part of the join key.

    A shared location id wins. Otherwise coordinates count when either side has
    more than one point; `point_keys` states that up front and saves the probe.
    """
    if LOCATION in forecasts.columns and LOCATION in observations.columns:
        return [LOCATION]
    if point_keys is None:
        point_keys = _has_many_points(forecasts) or _has_many_points(observations)
    return list(POINT) if point_keys else []


def _has_many_points(df: DataFrame) -> bool:
    """Whether latitude or longitude varies, from one map-side-combined row of extremes."""
    row = df.agg(
        *[F.min(c).alias(f"lo_{c}") for c in (LAT, LON)],
        *[F.max(c).alias(f"hi_{c}") for c in (LAT, LON)],
    ).first()
    return any(row[f"lo_{c}"] != row[f"hi_{c}"] for c in (LAT, LON))


def align(forecasts: DataFrame, observations: DataFrame, variables, point_keys: bool | None = None) -> DataFrame:
    """Left join on target = observation time and location: every forecast survives.

    Forecast-side coordinates win; ids, coordinates and elevations that are null on both sides match.
    """
    keys = join_keys(forecasts, observations, point_keys)
    f_cols = [c for c in forecasts.columns if c not in variables]
    f = forecasts.select(*f_cols, *[F.col(v).alias(forecast_var(v)) for v in variables if v in forecasts.columns])
    o = observations.select(
        OBS_TIME,
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        *[F.col(v).alias(observed_var(v)) for v in variables if v in observations.columns],
    )
    on = F.col(TARGET) == F.col(OBS_TIME)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    return f.join(o, on, "left").drop(*[f"_o_{k}" for k in keys])


def build_verification(
    forecasts: DataFrame,
    observations: DataFrame,
    variables,
    point_keys: bool | None = None,
    interpolate: str | None = None,
    max_km: float | None = None,
) -> DataFrame:
    """Aligned, with errors, month and season, in canonical order.

    `interpolate` ("bilinear", "idw", "nearest") first brings gridded forecasts to
    the sites of the observations, by location id; groups without a single site, and
    bilinear groups with fewer than four grid points, keep their native values. With
    `max_km` places that do not fit together are refused (see
    `locations.require_compatible`), after the interpolation.
    """
    if interpolate is not None:
        forecasts = interpolate_to_sites(collapse_corners(forecasts), sites_of(observations), variables, interpolate)
    if max_km is not None:
        require_compatible(forecasts, observations, max_km)
    joined = align(forecasts, observations, variables, point_keys)
    return with_calendar(canonical(add_errors(joined, variables), variables))


ALIGNED = (
    "forecast_issue_time",
    "forecast_target_time",
    "lead_hours",
    "model",
    "latitude",
    "longitude",
    "location_id",
    "variable",
    "observation_value",
    "forecast_value",
    "error",
    "abs_error",
    "match_status",
)


def align_long(forecasts: DataFrame, observations: DataFrame, time_col: str = OBS_TIME) -> DataFrame:
    """Long left join on (target, variable[, location_id]) with status and errors.

    `forecasts` and `observations` carry `value`. A row without an observed
    value is `forecast_only`.
    """
    shared_id = LOCATION in forecasts.columns and LOCATION in observations.columns
    f = forecasts.withColumnRenamed("value", "forecast_value")
    o = observations.select(
        F.col(time_col).alias("_o_time"),
        F.col("variable").alias("_o_variable"),
        *([F.col(LOCATION).alias("_o_location")] if shared_id else []),
        F.col("value").alias("observation_value"),
    )
    on = (F.col(TARGET) == F.col("_o_time")) & (F.col("variable") == F.col("_o_variable"))
    if shared_id:
        on = on & F.col(LOCATION).eqNullSafe(F.col("_o_location"))
    joined = f.join(o, on, "left")
    matched = F.col("observation_value").isNotNull()
    error = F.when(matched, F.col("forecast_value") - F.col("observation_value"))
    out = joined.withColumns(
        {
            "match_status": F.when(matched, "matched").otherwise("forecast_only"),
            "error": error,
            "abs_error": F.abs(error),
        }
    )
    return out.select(*[c for c in ALIGNED if c in out.columns])


def alignment_summary(aligned: DataFrame) -> DataFrame:
    """One row: counts per status, MAE, RMSE, bias, coverage."""
    status = F.col("match_status")
    total, matched = F.count(F.lit(1)), F.count_if(status == "matched")
    return aligned.agg(
        total.alias("total_rows"),
        matched.alias("matched_rows"),
        F.count_if(status == "forecast_only").alias("forecast_only"),
        F.count_if(status == "observation_only").alias("observation_only"),
        F.avg("abs_error").alias("mae"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        F.avg("error").alias("bias"),
        (matched / F.greatest(total, F.lit(1))).alias("coverage_fraction"),
    )


RECORD_KEY = (LAT, LON, "valid_time", "variable")
# A key with more forecasts than this is dealt to several places; rows without a key to NO_KEY_PLACES.
HOT_ROWS = 200_000
NO_KEY_PLACES = 1024


def salted_full_outer(left: DataFrame, right: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Full outer join on `keys` that no hot key of `left` can hold up.

    Adaptive execution cannot split a partition of a full outer join. Here it is a
    left outer join, in which the left rows of a hot key are dealt to several places by their
    values and the right rows of that key go to each of them, and the right rows that
    meet no left row. How many places a key needs is counted first; there are at
    most rows / `hot_rows` such keys. Null keys match nothing and are spread.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    places = F.ceil(F.count(F.lit(1)) / hot_rows).cast("int")
    hot = materialize(left.where(known).groupBy(*keys).agg(places.alias("_places")).where("_places > 1"), "hot-keys")
    own = lambda n: F.pmod(F.xxhash64(*left.columns), n.cast("bigint")).cast("int")
    dealt = left.join(hot, keys, "left").withColumn("_place", F.when(~known, own(F.lit(NO_KEY_PLACES))).otherwise(own(F.coalesce("_places", F.lit(1)))))
    copies = F.sequence(F.lit(0), F.coalesce("_places", F.lit(1)) - 1)
    spread = right.where(known).join(hot, keys, "left").withColumn("_place", F.explode(copies))
    met = dealt.drop("_places").join(spread.drop("_places"), [*keys, "_place"], "left").drop("_place")
    alone = right.join(left.select(*keys).distinct(), keys, "left_anti")
    return met.unionByName(alone, allowMissingColumns=True)


def align_records(forecasts: DataFrame, observations: DataFrame, strict: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Full outer join of long records on (lat, lon, valid_time, variable).

    Every forecast of a key pairs with every observation of it; the rest is
    `forecast_only` or `observation_only`. Errors are circular aware. If `strict`,
    two inputs without a row are an error.
    """
    if strict and forecasts.isEmpty() and observations.isEmpty():
        raise ValueError("nothing to align: neither forecasts nor observations have a row")
    f = forecasts.select(
        *RECORD_KEY,
        F.col("lead_hours").alias("_f_lead"),
        F.col("run_time").alias("forecast_run_time"),
        F.col("model").alias("forecast_model"),
        F.col("value").alias("forecast_value"),
        F.lit(True).alias("_f"),
    )
    o_lead = F.col("lead_hours") if "lead_hours" in observations.columns else F.lit(0)
    o = observations.select(
        *RECORD_KEY,
        o_lead.cast("int").alias("_o_lead"),
        F.col("value").alias("observation_value"),
        F.lit(True).alias("_o"),
    )
    status = (
        F.when(F.col("_f").isNotNull() & F.col("_o").isNotNull(), "matched")
        .when(F.col("_f").isNotNull(), "forecast_only")
        .otherwise("observation_only")
    )
    joined = salted_full_outer(f, o, list(RECORD_KEY), hot_rows).withColumn("match_status", status)
    joined = joined.withColumn("lead_hours", F.coalesce("_f_lead", "_o_lead"))
    return record_errors(joined.drop("_f", "_o", "_f_lead", "_o_lead"))


def fully_matched(aligned: DataFrame) -> DataFrame:
    return aligned.where(
        (F.col("match_status") == "matched")
        & F.col("forecast_value").isNotNull()
        & F.col("observation_value").isNotNull()
    )


def with_status(aligned: DataFrame, *statuses: str) -> DataFrame:
    """Rows of the given match statuses; a table without the column is unchanged."""
    if "match_status" not in aligned.columns:
        return aligned
    return aligned.where(F.col("match_status").isin(*statuses))


def alignment_profile(aligned: DataFrame) -> DataFrame:
    """One row: counts per status, distinct locations and variables, time range."""
    status = F.col("match_status")
    return aligned.agg(
        F.count_if(status == "matched").alias("matched"),
        F.count_if(status == "forecast_only").alias("forecast_only"),
        F.count_if(status == "observation_only").alias("observation_only"),
        F.count_distinct(LAT, LON).alias("locations"),
        F.count_distinct("variable").alias("variables"),
        F.min("valid_time").alias("first_valid_time"),
        F.max("valid_time").alias("last_valid_time"),
    )


def run_overlap(forecasts: DataFrame) -> DataFrame:
    """Keys forecast by more than one run: run list, number of runs, record count."""
    grouped = forecasts.groupBy(*RECORD_KEY, "run_time").agg(F.count(F.lit(1)).alias("_n"))
    runs = grouped.groupBy(*RECORD_KEY).agg(
        F.sort_array(F.collect_list("run_time")).alias("run_times"),
        F.count(F.lit(1)).alias("num_runs"),
        F.sum("_n").alias("record_count"),
    )
    return runs.where(F.col("num_runs") > 1)
