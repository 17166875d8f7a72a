"""Queries: projections, metrics, degradation, seasons, anomalies."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import names
from ..functions.temporal import season_of
from ..operators import align, anomalies, degradation, distributions, errors, extremes, metrics, seasonal
from ..sinks import bucketed
from ..sources.tables import filter_metrics, pivot_metrics
from .registry import (
    VARIABLES,
    ensemble_forecasts,
    ensemble_observations,
    metric_sql,
    on_ensemble,
    on_shipments,
    on_verification,
    query,
    shipments,
    stored,
    verification,
)

M = "metric_value"


def by_model_lead(spark, sf):
    return metrics.grouped_metrics(verification(spark, sf), ["model", "lead_hours"], VARIABLES)


def by_model_lead_stored(spark, sf):
    return stored("metrics-model-lead", spark, sf, by_model_lead)


def by_season_lead_stored(spark, sf):
    build = lambda sp, d: metrics.grouped_metrics(verification(sp, d), ["season", "lead_hours"], VARIABLES)
    return stored("metrics-season-lead", spark, sf, build)


def by_month_model_stored(spark, sf):
    build = lambda sp, d: metrics.grouped_metrics(verification(sp, d), ["month", "model"], VARIABLES)
    return stored("metrics-month-model", spark, sf, build)


ML = f"m AS ({metric_sql('model, lead_hours')})"
SL = f"m AS ({metric_sql('season, lead_hours')})"
MM = f"m AS ({metric_sql('month, model')})"


@query("metrics_by_model_lead", "AGG-01", "AGG-02", "AGG-03", "AGG-04", "AGG-05", sql=on_verification(metric_sql("model, lead_hours"), M))
def _(spark, sf):
    return by_model_lead(spark, sf)


@query("agg06_summary_by_lead", "AGG-06", sql=on_verification(metric_sql("lead_hours"), M))
def _(spark, sf):
    return metrics.summary_by_lead_time(verification(spark, sf), VARIABLES)


@query("agg06_summary_by_month", "AGG-06", sql=on_verification(metric_sql("month"), M))
def _(spark, sf):
    return metrics.summary_by_month(verification(spark, sf).drop("month"), VARIABLES)


@query("agg06_summary_by_season", "AGG-06", "PRJ-06", sql=on_verification(metric_sql("season"), M))
def _(spark, sf):
    return metrics.summary_by_season(verification(spark, sf).drop("season"), VARIABLES)


@query("agg07_metrics_overall", "AGG-07", sql=on_verification(metric_sql(""), M))
def _(spark, sf):
    return metrics.grouped_metrics(verification(spark, sf), [], VARIABLES)


def _sets_sql() -> str:
    parts = []
    for d in ("lead_hours", "season", "month", "model"):
        shown = ", ".join(
            c if c == d else f"CAST(NULL AS {'VARCHAR' if c in ('season', 'model') else 'INT'}) AS {c}"
            for c in ("lead_hours", "season", "month", "model")
        )
        parts.append(
            f"SELECT '{d}' AS \"grouping\", {shown}, variable, metric_name, metric_value, sample_size, total_rows, missing_count "
            f"FROM ({metric_sql(d)}) AS s_{d}"
        )
    return " UNION ALL ".join(parts)


@query("agg08_grouping_sets", "AGG-08", "SNK-09", sql=on_verification(_sets_sql(), M))
def _(spark, sf):
    sets = [["lead_hours"], ["season"], ["month"], ["model"]]
    return metrics.metrics_by_grouping_sets(verification(spark, sf), sets, VARIABLES)


# --- aligned records of the ensemble ------------------------------------------------


def records(spark, sf):
    f = ensemble_forecasts(spark, sf).withColumnsRenamed(
        {"forecast_target_time": "valid_time", "forecast_issue_time": "run_time"}
    )
    o = ensemble_observations(spark, sf).withColumnRenamed("observation_time", "valid_time")
    return align.align_records(f, o)


RECORDS = """rec AS (
  SELECT coalesce(f.latitude, o.latitude) AS latitude, coalesce(f.longitude, o.longitude) AS longitude,
         coalesce(f.forecast_target_time, o.observation_time) AS valid_time, 'load' AS variable,
         f.forecast_issue_time AS forecast_run_time, f.model AS forecast_model,
         f.value AS forecast_value, o.value AS observation_value, coalesce(f.lead_hours, 0) AS lead_hours,
         CASE WHEN f.model IS NULL THEN 'observation_only' WHEN o.location_id IS NULL THEN 'forecast_only' ELSE 'matched' END AS match_status,
         f.value - o.value AS error
  FROM ens_forecasts f FULL OUTER JOIN ens_observations o
    ON f.latitude = o.latitude AND f.longitude = o.longitude AND f.forecast_target_time = o.observation_time)"""


@query(
    "jn05_full_outer_records",
    "JN-05",
    "SET-02",
    "PRJ-04",
    sql=on_ensemble(
        """SELECT latitude, longitude, valid_time, variable, forecast_run_time, forecast_model, forecast_value,
           observation_value, match_status, lead_hours, error, abs(error) AS absolute_error,
           error * error AS squared_error, error AS bias_contribution FROM rec""",
        "latitude longitude forecast_value observation_value error absolute_error squared_error bias_contribution",
        RECORDS,
    ),
)
def _(spark, sf):
    return records(spark, sf)


def _evaluation_sql(key: str, alias: str, having: str = "count(error) > 0", where: str = "TRUE") -> str:
    shown = f"{key} AS {alias}, " if alias else ""
    group = f"GROUP BY {key}" if alias else ""
    parts = [
        f"""SELECT {shown}'{name}' AS metric_type, {expr} AS value, count(error) AS sample_size, count(*) AS total_count,
            count(error) / CAST(count(*) AS DOUBLE) AS coverage_fraction, count(error) >= 30 AS is_stable,
            min(valid_time) AS range_start, max(valid_time) AS range_end
            FROM rec WHERE {where} {group} HAVING {having}"""
        for name, expr in (
            ("mae", "avg(abs(error))"),
            ("rmse", "sqrt(avg(error * error))"),
            ("bias", "avg(error)"),
            ("error_variance", "var_pop(error)"),
        )
    ]
    return " UNION ALL ".join(parts)


def _evaluation_query(name: str, ids: tuple[str, ...], group_by, key: str, alias: str, where: str = "TRUE"):
    sql = on_ensemble(_evaluation_sql(key, alias, where=where), "value coverage_fraction", RECORDS)

    @query(name, *ids, sql=sql)
    def _(spark, sf):
        return metrics.evaluations(records(spark, sf), group_by, min_sample_size=30).drop("variable", "variable_type")


_evaluation_query("agg10_evaluations_overall", ("AGG-10", "AGG-13"), None, "", "")
_evaluation_query("agg10_evaluations_by_lead", ("AGG-10", "AGG-12", "AGG-13"), "lead_time", "lead_hours", "lead_hours")
_evaluation_query(
    "agg10_evaluations_by_run", ("AGG-10", "AGG-12"), "run_time", "forecast_run_time", "forecast_run_time", "forecast_run_time IS NOT NULL"
)
_evaluation_query("agg11_evaluations_by_month", ("AGG-11",), "month", "CAST(month(valid_time) AS INT)", "month")


@query(
    "agg10_evaluations_by_location",
    "AGG-10",
    "AGG-12",
    sql=on_ensemble(
        _evaluation_sql("latitude, longitude", "_", "count(error) > 0").replace("latitude, longitude AS _, ", "latitude, longitude, "),
        "latitude longitude value coverage_fraction",
        RECORDS,
    ),
)
def _(spark, sf):
    return metrics.evaluations(records(spark, sf), "location", min_sample_size=30).drop("variable", "variable_type")


@query(
    "agg11_evaluations_by_season",
    "AGG-11",
    sql=on_ensemble(
        _evaluation_sql(
            "CASE WHEN month(valid_time) IN (12,1,2) THEN 'DJF' WHEN month(valid_time) IN (3,4,5) THEN 'MAM' "
            "WHEN month(valid_time) IN (6,7,8) THEN 'JJA' ELSE 'SON' END",
            "season",
            "TRUE",
        ),
        "value coverage_fraction",
        RECORDS,
    ),
)
def _(spark, sf):
    return metrics.evaluations(records(spark, sf), "season", min_sample_size=30).drop("variable", "variable_type")


@query(
    "agg12_evaluations_by_variable",
    "AGG-12",
    "PRJ-15",
    sql=on_ensemble(
        f"SELECT *, CAST(NULL AS VARCHAR) AS variable_type FROM ({_evaluation_sql('variable', 'variable')}) AS v", "value coverage_fraction", RECORDS
    ),
)
def _(spark, sf):
    return metrics.evaluations(records(spark, sf), "variable", min_sample_size=30)


@query(
    "agg14_evaluation_of_one_lead",
    "AGG-14",
    sql=on_ensemble(
        "SELECT lead_hours, 'rmse' AS metric_type, sqrt(avg(error * error)) AS value, count(error) AS sample_size "
        "FROM rec WHERE lead_hours = 72 GROUP BY lead_hours",
        "value",
        RECORDS,
    ),
)
def _(spark, sf):
    out = metrics.evaluation_of_group(records(spark, sf), "rmse", "lead_time", 72)
    return out.select("lead_hours", "metric_type", "value", "sample_size")


@query(
    "agg09_error_statistics",
    "AGG-09",
    sql=on_ensemble(
        "SELECT forecast_model, avg(error) AS mean_error, avg(abs(error)) AS mae, sqrt(avg(error * error)) AS rmse, avg(error) AS bias, "
        "var_pop(error) AS error_variance, count(error) AS sample_size FROM rec GROUP BY forecast_model",
        "mean_error mae rmse bias error_variance",
        RECORDS,
    ),
)
def _(spark, sf):
    return metrics.error_statistics(records(spark, sf), ["forecast_model"])


@query(
    "agg45_alignment_profile",
    "AGG-45",
    sql=on_ensemble(
        "SELECT count(*) FILTER (WHERE match_status = 'matched') AS matched, count(*) FILTER (WHERE match_status = 'forecast_only') AS forecast_only, "
        "count(*) FILTER (WHERE match_status = 'observation_only') AS observation_only, count(DISTINCT (latitude, longitude)) AS locations, "
        "count(DISTINCT variable) AS variables, min(valid_time) AS first_valid_time, max(valid_time) AS last_valid_time FROM rec",
        "",
        RECORDS,
    ),
)
def _(spark, sf):
    return align.alignment_profile(records(spark, sf))


@query(
    "prj13_gaps_by_status",
    "PRJ-13",
    sql=on_ensemble(
        "SELECT match_status, latitude, longitude, valid_time, coalesce(forecast_model, '') AS forecast_model FROM rec WHERE match_status <> 'matched'",
        "latitude longitude",
        RECORDS,
    ),
)
def _(spark, sf):
    rows = align.with_status(records(spark, sf), "forecast_only", "observation_only")
    model = F.coalesce("forecast_model", F.lit("")).alias("forecast_model")
    return rows.select("match_status", "latitude", "longitude", "valid_time", model)


@query(
    "prj13_matched_records",
    "PRJ-13",
    sql=on_ensemble(
        "SELECT forecast_model, count(*) AS matched FROM rec WHERE match_status = 'matched' AND forecast_value IS NOT NULL "
        "AND observation_value IS NOT NULL GROUP BY forecast_model",
        "",
        RECORDS,
    ),
)
def _(spark, sf):
    return align.fully_matched(records(spark, sf)).groupBy("forecast_model").agg(F.count(F.lit(1)).alias("matched"))


# --- joins ---------------------------------------------------------------------------


def joined(spark, sf):
    f = ensemble_forecasts(spark, sf).withColumnRenamed("value", "load").drop("variable")
    o = ensemble_observations(spark, sf).withColumnRenamed("value", "load").drop("variable")
    return align.build_verification(f, o, ["load"])


JOINED = """ver AS (
  SELECT f.forecast_issue_time, f.forecast_target_time, o.observation_time, f.lead_hours, f.model, f.latitude, f.longitude,
         CAST(NULL AS DOUBLE) AS elevation, f.location_id, f.value AS forecast_load, o.value AS observed_load, f.value - o.value AS load_error,
         CAST(month(f.forecast_target_time) AS INT) AS month, 'DJF' AS season
  FROM ens_forecasts f LEFT JOIN ens_observations o
    ON f.forecast_target_time = o.observation_time AND f.location_id IS NOT DISTINCT FROM o.location_id)"""


@query(
    "jn01_build_verification",
    "JN-01",
    "JN-03",
    "PRJ-01",
    "PRJ-02",
    sql=on_ensemble("SELECT * FROM ver", "latitude longitude forecast_load observed_load load_error", JOINED),
)
def _(spark, sf):
    return joined(spark, sf)


@query(
    "jn01_bucketed_tables",
    "JN-01",
    "JN-03",
    sql=on_ensemble("SELECT * FROM ver", "latitude longitude forecast_load observed_load load_error", JOINED),
)
def _(spark, sf):
    name = uuid.uuid4().hex
    f = ensemble_forecasts(spark, sf).withColumnRenamed("value", "load").drop("variable")
    o = ensemble_observations(spark, sf).withColumnRenamed("value", "load").drop("variable")
    f = bucketed.store_bucketed(f, f"forecasts_{name}", "forecast_target_time", 8)
    o = bucketed.store_bucketed(o, f"observations_{name}", "observation_time", 8)
    return bucketed.build_from_bucketed(f, o, ["load"])


@query(
    "jn02_align_by_coordinates",
    "JN-02",
    sql=on_ensemble(
        "SELECT f.forecast_target_time, f.model, f.latitude, f.longitude, f.value AS forecast_load, o.value AS observed_load "
        "FROM ens_forecasts f LEFT JOIN ens_observations o ON f.forecast_target_time = o.observation_time "
        "AND f.latitude = o.latitude AND f.longitude = o.longitude",
        "latitude longitude forecast_load observed_load",
    ),
)
def _(spark, sf):
    level = lambda df: df.withColumnRenamed("value", "load").drop("variable", "location_id").withColumn("elevation", F.lit(0.0))
    out = align.align(level(ensemble_forecasts(spark, sf)), level(ensemble_observations(spark, sf)), ["load"])
    return out.select("forecast_target_time", "model", "latitude", "longitude", "forecast_load", "observed_load")


@query(
    "jn02_null_elevation",
    "JN-02",
    sql=on_ensemble(
        "SELECT f.forecast_target_time, f.model, f.latitude, f.longitude, CASE WHEN f.latitude >= 52 THEN CAST(10.0 AS DOUBLE) END AS elevation, "
        "f.value AS forecast_load, o.value AS observed_load FROM ens_forecasts f LEFT JOIN ens_observations o "
        "ON f.forecast_target_time = o.observation_time AND f.latitude = o.latitude AND f.longitude = o.longitude",
        "latitude longitude elevation forecast_load observed_load",
    ),
)
def _(spark, sf):
    # Elevations are known in the north only; elsewhere they are null on both sides.
    height = F.when(F.col("latitude") >= 52, F.lit(10.0))
    level = lambda df: df.withColumnRenamed("value", "load").drop("variable", "location_id").withColumn("elevation", height)
    out = align.align(level(ensemble_forecasts(spark, sf)), level(ensemble_observations(spark, sf)), ["load"], point_keys=True)
    return out.select("forecast_target_time", "model", "latitude", "longitude", "elevation", "forecast_load", "observed_load")


def aligned_long(spark, sf):
    return align.align_long(ensemble_forecasts(spark, sf), ensemble_observations(spark, sf))


LONG = """al AS (
  SELECT f.*, o.value AS observation_value, f.value - o.value AS error,
         CASE WHEN o.value IS NULL THEN 'forecast_only' ELSE 'matched' END AS match_status
  FROM ens_forecasts f LEFT JOIN ens_observations o
    ON f.forecast_target_time = o.observation_time AND f.variable = o.variable AND f.location_id = o.location_id)"""


@query(
    "jn04_align_long",
    "JN-04",
    sql=on_ensemble(
        "SELECT forecast_issue_time, forecast_target_time, lead_hours, model, latitude, longitude, location_id, variable, "
        "observation_value, value AS forecast_value, error, abs(error) AS abs_error, match_status FROM al",
        "latitude longitude observation_value forecast_value error abs_error",
        LONG,
    ),
)
def _(spark, sf):
    return aligned_long(spark, sf)


@query(
    "jn04_alignment_summary",
    "JN-04",
    sql=on_ensemble(
        "SELECT count(*) AS total_rows, count(error) AS matched_rows, count(*) - count(error) AS forecast_only, CAST(0 AS BIGINT) AS observation_only, "
        "avg(abs(error)) AS mae, sqrt(avg(error * error)) AS rmse, avg(error) AS bias, count(error) / CAST(count(*) AS DOUBLE) AS coverage_fraction FROM al",
        "mae rmse bias coverage_fraction",
        LONG,
    ),
)
def _(spark, sf):
    return align.alignment_summary(aligned_long(spark, sf))


@query(
    "jn13_lead_rmse_wide",
    "JN-13",
    sql=on_verification(
        "SELECT lead_hours, sqrt(avg(qty_error * qty_error)) AS qty_rmse, sqrt(avg(price_error * price_error)) AS price_rmse "
        "FROM verification WHERE lead_hours >= 0 GROUP BY lead_hours",
        "qty_rmse price_rmse",
    ),
)
def _(spark, sf):
    return metrics.combined_lead_table(verification(spark, sf), VARIABLES)


# --- projections ---------------------------------------------------------------------


@query(
    "prj01_canonical_projection",
    "PRJ-01",
    "PRJ-05",
    sql=on_shipments(
        "SELECT forecast_issue_time, forecast_target_time, observation_time, lead_hours, model, latitude, longitude, CAST(NULL AS DOUBLE) AS elevation, "
        "location_id, forecast_qty, CAST(NULL AS DOUBLE) AS forecast_wind, observed_qty, CAST(NULL AS DOUBLE) AS observed_wind, qty_error, "
        "CAST(NULL AS DOUBLE) AS wind_error FROM shipments",
        "latitude longitude",
    ),
)
def _(spark, sf):
    bare = errors.repair_lead_hours(shipments(spark, sf).drop("lead_hours"))
    return errors.canonical(bare, ["qty", "wind"])


@query(
    "prj05_lead_hours_repaired",
    "PRJ-05",
    sql=on_shipments("SELECT order_id, line_id, lead_hours FROM shipments"),
)
def _(spark, sf):
    # Leads of early targets arrive in days; each wrong row is put right.
    days = F.when(F.col("forecast_target_time") < "1998-01-01", F.col("lead_hours") / 24).otherwise(F.col("lead_hours"))
    broken = shipments(spark, sf).withColumn("lead_hours", days.cast("int"))
    return errors.repair_lead_hours(broken).select("order_id", "line_id", "lead_hours")


@query(
    "prj03_circular_errors",
    "PRJ-03",
    sql=on_verification(
        "SELECT order_id, line_id, d - 360.0 * floor(d / 360.0) - 180.0 AS wind_direction_10m_error FROM "
        "(SELECT order_id, line_id, forecast_qty * 7.0 - observed_qty * 7.0 + 180.0 AS d FROM verification)",
        "wind_direction_10m_error",
    ),
)
def _(spark, sf):
    v = verification(spark, sf)
    angle = v.withColumns(
        {"forecast_wind_direction_10m": F.col("forecast_qty") * 7.0, "observed_wind_direction_10m": F.col("observed_qty") * 7.0}
    )
    out = errors.add_errors(angle, ["wind_direction_10m"], circular=True)
    return out.select("order_id", "line_id", "wind_direction_10m_error")


@query(
    "prj06_calendar",
    "PRJ-06",
    sql=on_verification(
        "SELECT season, CAST(year(forecast_target_time) AS INT) AS year, month, count(*) AS n FROM verification GROUP BY ALL"
    ),
)
def _(spark, sf):
    v = verification(spark, sf)
    dims = {"season": season_of("forecast_target_time"), "year": F.year("forecast_target_time"), "month": F.month("forecast_target_time")}
    return v.withColumns(dims).groupBy("season", "year", "month").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prj12_filter_metrics",
    "PRJ-12",
    sql=on_verification("SELECT * FROM m WHERE variable = 'qty' AND metric_name IN ('mae', 'bias') AND model IN ('AF', 'RO')", M, ML),
)
def _(spark, sf):
    return filter_metrics(by_model_lead_stored(spark, sf), ["qty"], ["mae", "bias"], ["AF", "RO"])


@query(
    "prj15_types_and_units",
    "PRJ-15",
    sql=(
        "SELECT p_type AS variable, CAST(NULL AS VARCHAR) AS variable_type, 'units' AS unit, count(*) AS n FROM part GROUP BY p_type "
        "UNION ALL SELECT concat('temperature_2m_', p_type), 'temperature', 'units', count(*) FROM part GROUP BY p_type "
        "UNION ALL SELECT 'precipitation_error', 'precipitation', 'mm/h', count(*) FROM part"
    ),
)
def _(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet").select("p_type")
    spelled = F.array(F.col("p_type"), F.concat(F.lit("temperature_2m_"), "p_type"), F.lit("precipitation_error"))
    counted = parts.select(F.explode(spelled).alias("variable")).groupBy("variable").agg(F.count(F.lit(1)).alias("n"))
    kind, unit = names.variable_type(F.col("variable")), names.variable_units(F.col("variable"))
    return counted.select("variable", kind.alias("variable_type"), unit.alias("unit"), "n")


@query(
    "prj16_wide_to_long",
    "PRJ-16",
    sql=on_verification(
        "SELECT order_id, line_id, model, 'qty' AS variable, forecast_qty AS value FROM verification "
        "UNION ALL SELECT order_id, line_id, model, 'price', forecast_price FROM verification",
        "value",
    ),
)
def _(spark, sf):
    v = verification(spark, sf).withColumnsRenamed({"forecast_qty": "qty", "forecast_price": "price"})
    return errors.to_long(v, ["order_id", "line_id", "model"], VARIABLES)


@query(
    "prj16_nested_runs_to_long",
    "PRJ-16",
    sql=on_ensemble(
        "SELECT model, location_id, 'load' AS variable, forecast_target_time AS valid_time, value FROM ens_forecasts", "value"
    ),
)
def _(spark, sf):
    # One run document per model, location and day: times and a map of value arrays.
    f = ensemble_forecasts(spark, sf).withColumn("day", F.to_date("forecast_target_time"))
    stamp = F.date_format("forecast_target_time", "yyyy-MM-dd'T'HH:mm:ss")
    pairs = F.array_sort(F.collect_list(F.struct(stamp.alias("t"), F.col("value").alias("v"))))
    docs = f.groupBy("model", "location_id", "day").agg(pairs.alias("p"))
    runs = docs.select(
        "model",
        "location_id",
        F.col("p.t").alias("times"),
        F.create_map(F.lit("load"), F.col("p.v")).alias("variables"),
    )
    return errors.runs_to_long(runs, ["model", "location_id"])


# --- quantiles and extremes ----------------------------------------------------------


def _quantile_sql(keys: str, percentiles, source: str, value: str = "price_error", where: str = "TRUE") -> str:
    shown = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return " UNION ALL ".join(
        f"SELECT {shown}CAST({p} AS INT) AS percentile, quantile_cont({value}, {p / 100}) AS value FROM {source} "
        f"WHERE {value} IS NOT NULL AND {where} {group}"
        for p in percentiles
    )


@query("agg21_error_quantiles", "AGG-21", sql=on_verification(_quantile_sql("", (5, 10, 25, 50, 75, 90, 95), "verification"), "value"))
def _(spark, sf):
    return extremes.error_quantiles(verification(spark, sf), "price")


@query(
    "agg21_error_quantiles_of_model",
    "AGG-21",
    sql=on_verification(_quantile_sql("", (5, 10, 25, 50, 75, 90, 95), "verification", where="model = 'AF'"), "value"),
)
def _(spark, sf):
    return extremes.error_quantiles(verification(spark, sf), "price", model="AF")


@query("agg22_lead_quantiles", "AGG-22", sql=on_verification(_quantile_sql("lead_hours", (10, 25, 50, 75, 90), "verification"), "value"))
def _(spark, sf):
    return extremes.lead_time_quantiles(verification(spark, sf), "price")


@query(
    "agg23_extreme_frequency",
    "AGG-23",
    sql=on_verification(
        "SELECT model, count(*) AS total, count(*) FILTER (WHERE abs(qty_error) >= 30) AS extreme_count, "
        "count(*) FILTER (WHERE abs(qty_error) >= 30) / CAST(count(*) AS DOUBLE) AS frequency, "
        "avg(abs(qty_error)) FILTER (WHERE abs(qty_error) >= 30) AS mean_error_when_extreme FROM verification WHERE qty_error IS NOT NULL GROUP BY model",
        "frequency mean_error_when_extreme",
    ),
)
def _(spark, sf):
    return extremes.extreme_frequency(verification(spark, sf), "qty", 30.0, by=["model"])


@query(
    "prj14_extreme_misses",
    "PRJ-14",
    sql=on_verification(
        "SELECT price_error, lead_hours, model, abs(price_error) AS abs_error FROM verification WHERE abs(price_error) >= 10000",
        "price_error abs_error",
    ),
)
def _(spark, sf):
    return extremes.extreme_misses(verification(spark, sf), "price", 10000.0)


@query(
    "prj14_under_forecasts",
    "PRJ-14",
    sql=on_verification("SELECT qty_error, lead_hours, model, abs(qty_error) AS abs_error FROM verification WHERE qty_error <= -40"),
)
def _(spark, sf):
    return extremes.extreme_misses(verification(spark, sf), "qty", 40.0, "under")


@query(
    "srt01_top_errors",
    "SRT-01",
    sql=on_verification(
        "SELECT price_error, lead_hours, model, order_id, line_id, abs(price_error) AS abs_error FROM verification "
        "WHERE price_error IS NOT NULL ORDER BY abs_error DESC, order_id, line_id LIMIT 50",
        "price_error abs_error",
    ),
)
def _(spark, sf):
    return extremes.top_errors(verification(spark, sf), "price", 50, tiebreak=("order_id", "line_id"))


@query("srt06_first_leads", "SRT-06", sql=on_verification("SELECT DISTINCT lead_hours FROM verification ORDER BY lead_hours LIMIT 5"))
def _(spark, sf):
    return extremes.first_leads(verification(spark, sf))


@query(
    "ano04_error_quantiles_all_variables",
    "ANO-04",
    sql=on_verification(
        " UNION ALL ".join(
            f"SELECT '{v}' AS variable, * FROM ({_quantile_sql('', (5, 10, 25, 50, 75, 90, 95), 'verification', v + '_error')}) AS q_{v}" for v in VARIABLES
        ),
        "value",
    ),
)
def _(spark, sf):
    long = errors.errors_to_long(verification(spark, sf), ["model"], VARIABLES)
    return extremes.analysis_quantiles(long)


# --- distributions -------------------------------------------------------------------


@query(
    "agg24_histogram",
    "AGG-24",
    sql=on_verification(
        "SELECT bin, lo + (bin - 1) * w AS left_edge, lo + (bin - 1) * w + w AS right_edge, count(*) AS count FROM ("
        "SELECT CAST(least(floor((price_error - lo) / w) + 1, 50) AS INT) AS bin, lo, w FROM verification, "
        "(SELECT min(price_error) AS lo, (max(price_error) - min(price_error)) / 50.0::DOUBLE AS w FROM verification) AS b "
        "WHERE price_error IS NOT NULL) AS h GROUP BY bin, lo, w",
        "left_edge right_edge",
    ),
)
def _(spark, sf):
    return distributions.histogram(verification(spark, sf), "price_error")


@query(
    "agg24_distribution_summary",
    "AGG-24",
    sql=on_verification(
        "SELECT model, avg(price_error) AS mean, stddev_samp(price_error) AS std, count(price_error) AS n, quantile_cont(price_error, 0.1) AS p10, "
        "quantile_cont(price_error, 0.25) AS p25, quantile_cont(price_error, 0.5) AS median, quantile_cont(price_error, 0.75) AS p75, "
        "quantile_cont(price_error, 0.9) AS p90 FROM verification WHERE price_error IS NOT NULL GROUP BY model",
        "mean std p10 p25 median p75 p90",
    ),
)
def _(spark, sf):
    return distributions.distribution_summary(verification(spark, sf), "price", ["model"])


@query(
    "agg25_box_statistics",
    "AGG-25",
    sql=on_verification(
        "SELECT lead_hours, q1, median, q3, least(min(price_error) FILTER (WHERE inside), q1) AS whisker_low, "
        "greatest(max(price_error) FILTER (WHERE inside), q3) AS whisker_high, count(*) FILTER (WHERE NOT inside) AS outliers, count(*) AS n FROM ("
        "SELECT v.lead_hours, price_error, q1, median, q3, price_error BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside "
        "FROM verification v JOIN q ON v.lead_hours = q.lead_hours WHERE price_error IS NOT NULL) AS f GROUP BY lead_hours, q1, median, q3",
        "q1 median q3 whisker_low whisker_high",
        "q AS (SELECT lead_hours, quantile_cont(price_error, 0.25) AS q1, quantile_cont(price_error, 0.5) AS median, "
        "quantile_cont(price_error, 0.75) AS q3 FROM verification GROUP BY lead_hours)",
    ),
)
def _(spark, sf):
    return distributions.box_statistics(verification(spark, sf), "price")


@query(
    "agg44_variation_flag",
    "AGG-44",
    sql=on_verification(
        "SELECT lead_hours, count(qty_error) AS n, count(qty_error) > 0 AND NOT coalesce(count(qty_error) > 1 AND stddev_pop(qty_error) < 1e-9 "
        "AND max(abs(qty_error)) < 1e-9, FALSE) AS has_variation FROM verification GROUP BY lead_hours"
    ),
)
def _(spark, sf):
    return distributions.variation_flag(verification(spark, sf), "qty_error", ["lead_hours"])


# --- degradation ---------------------------------------------------------------------


@query(
    "agg39_degradation_rates",
    "AGG-39",
    sql=on_verification(
        "SELECT variable, metric_name, model, CASE WHEN count(metric_value) >= 3 THEN regr_slope(metric_value, lead_hours) END AS degradation_rate, "
        "count(metric_value) AS n_points FROM m GROUP BY variable, metric_name, model",
        "degradation_rate",
        ML,
    ),
)
def _(spark, sf):
    return degradation.degradation_rate(by_model_lead_stored(spark, sf))


@query(
    "agg39_degradation_rate_in_range",
    "AGG-39",
    sql=on_verification(
        "SELECT variable, metric_name, model, CASE WHEN count(metric_value) >= 3 THEN regr_slope(metric_value, lead_hours) END AS degradation_rate, "
        "count(metric_value) AS n_points FROM m WHERE lead_hours BETWEEN 24 AND 168 GROUP BY variable, metric_name, model",
        "degradation_rate",
        ML,
    ),
)
def _(spark, sf):
    return degradation.degradation_rate(by_model_lead_stored(spark, sf), lead_range=(24, 168))


@query(
    "agg38_seasonal_degradation",
    "AGG-38",
    sql=on_verification(
        "SELECT variable, season, CASE WHEN count(metric_value) >= 3 THEN regr_slope(metric_value, lead_hours) END AS degradation_rate, "
        "count(metric_value) AS n_points FROM m WHERE metric_name = 'mae' GROUP BY variable, season",
        "degradation_rate",
        SL,
    ),
)
def _(spark, sf):
    return degradation.seasonal_degradation(by_season_lead_stored(spark, sf))


@query(
    "agg40_half_skill_lead",
    "AGG-40",
    sql=on_verification(
        "SELECT variable, metric_name, model, min_error, min(lead_hours) FILTER (WHERE min_error > 0 AND n >= 2 AND metric_value >= 2 * min_error) "
        "AS half_skill_lead_hours FROM (SELECT *, min(metric_value) OVER w AS min_error, count(*) OVER w AS n FROM m "
        "WINDOW w AS (PARTITION BY variable, metric_name, model)) AS x GROUP BY variable, metric_name, model, min_error",
        "min_error",
        ML,
    ),
)
def _(spark, sf):
    return degradation.half_skill_lead(by_model_lead_stored(spark, sf))


@query(
    "agg41_skill_against_reference",
    "AGG-41",
    sql=on_verification(
        "SELECT a.variable, a.metric_name, a.model, 1 - a.e / nullif(b.e, 0) AS skill_score FROM "
        "(SELECT variable, metric_name, model, avg(metric_value) AS e FROM m GROUP BY ALL) AS a JOIN "
        "(SELECT variable, metric_name, avg(metric_value) AS e FROM m WHERE model = 'AF' GROUP BY ALL) AS b "
        "ON a.variable = b.variable AND a.metric_name = b.metric_name WHERE a.model <> 'AF'",
        "skill_score",
        ML,
    ),
)
def _(spark, sf):
    return degradation.skill_against(by_model_lead_stored(spark, sf), "AF")


@query(
    "agg43_lead_series",
    "AGG-43",
    sql=on_verification(
        "SELECT variable, metric_name, model, lead_hours, metric_value, sample_size FROM m WHERE metric_name IN ('mae', 'rmse')", M, ML
    ),
)
def _(spark, sf):
    return degradation.lead_series(by_model_lead_stored(spark, sf), names=["mae", "rmse"])


@query(
    "win04_degradation_profile",
    "WIN-04",
    sql=on_verification(
        "SELECT variable, metric_name, model, count(*) FILTER (WHERE falls) = 0 AS is_monotonic, "
        "coalesce(string_agg(CAST(lead_hours AS VARCHAR), ',' ORDER BY lead_hours) FILTER (WHERE falls), '') AS instability_points, count(*) AS n_points FROM "
        "(SELECT *, metric_value < lag(metric_value) OVER (PARTITION BY variable, metric_name, model ORDER BY lead_hours) AS falls "
        "FROM m WHERE metric_value IS NOT NULL) AS x GROUP BY variable, metric_name, model",
        "",
        ML,
    ),
)
def _(spark, sf):
    out = degradation.degradation_profile(by_model_lead_stored(spark, sf))
    return out.withColumn("instability_points", F.array_join(F.col("instability_points").cast("array<string>"), ","))


@query(
    "win04_degradation_points",
    "WIN-04",
    sql=on_verification(
        "SELECT variable, metric_name, model, lead_hours, metric_value, coalesce(metric_value >= lag(metric_value) OVER "
        "(PARTITION BY variable, metric_name, model ORDER BY lead_hours), FALSE) AS is_monotonic_with_prev FROM m",
        M,
        ML,
    ),
)
def _(spark, sf):
    return degradation.degradation_points(by_model_lead_stored(spark, sf))


# --- seasons and months --------------------------------------------------------------


@query(
    "agg35_rmse_by_lead",
    "AGG-35",
    sql=on_verification(
        " UNION ALL ".join(
            f"SELECT lead_hours, '{v}' AS variable, count({v}_error) AS count, sqrt(avg({v}_error * {v}_error)) AS rmse FROM verification "
            f"WHERE lead_hours >= 0 GROUP BY lead_hours HAVING count({v}_error) > 0"
            for v in VARIABLES
        ),
        "rmse",
    ),
)
def _(spark, sf):
    return metrics.rmse_by_lead(verification(spark, sf), VARIABLES)


@query(
    "agg35_errors_by_season",
    "AGG-35",
    sql=on_verification(
        " UNION ALL ".join(
            f"SELECT season, '{v}' AS variable, count({v}_error) AS count, avg(abs({v}_error)) AS mae, avg({v}_error) AS bias FROM verification GROUP BY season"
            for v in VARIABLES
        ),
        "mae bias",
    ),
)
def _(spark, sf):
    return metrics.errors_by_season(verification(spark, sf), VARIABLES)


_SEASONS = "(VALUES ('DJF'), ('MAM'), ('JJA'), ('SON')) AS s(season)"


@query(
    "agg36_seasonal_bias",
    "AGG-36",
    "AGG-42",
    sql=on_verification(
        f"SELECT v.variable, s.season, avg(metric_value) AS bias, CAST(sum(sample_size) AS BIGINT) AS sample_size FROM "
        f"(SELECT DISTINCT variable FROM m) AS v CROSS JOIN {_SEASONS} "
        "LEFT JOIN m ON m.variable = v.variable AND m.season = s.season AND m.metric_name = 'bias' GROUP BY v.variable, s.season",
        "bias",
        SL,
    ),
)
def _(spark, sf):
    return seasonal.seasonal_bias(by_season_lead_stored(spark, sf))


@query(
    "agg36_seasonal_skill",
    "AGG-36",
    sql=on_verification(
        "SELECT v.variable, s.season, k.metric_name, avg(metric_value) AS metric_value, CAST(sum(sample_size) AS BIGINT) AS sample_size FROM "
        f"(SELECT DISTINCT variable FROM m) AS v CROSS JOIN {_SEASONS} CROSS JOIN (VALUES ('mae'), ('rmse'), ('bias')) AS k(metric_name) "
        "LEFT JOIN m ON m.variable = v.variable AND m.season = s.season AND m.metric_name = k.metric_name GROUP BY v.variable, s.season, k.metric_name",
        M,
        SL,
    ),
)
def _(spark, sf):
    return seasonal.seasonal_skill(by_season_lead_stored(spark, sf))


@query(
    "agg37_monthly_skill",
    "AGG-37",
    sql=on_verification(
        "SELECT variable, month, metric_name, avg(metric_value) AS metric_value, CAST(sum(sample_size) AS BIGINT) AS sample_size FROM m "
        "WHERE metric_name <> 'std' GROUP BY variable, month, metric_name",
        M,
        MM,
    ),
)
def _(spark, sf):
    return seasonal.monthly_skill(by_month_model_stored(spark, sf))


@query(
    "agg42_monthly_chart",
    "AGG-42",
    sql=on_verification(
        "SELECT v.variable, CAST(k.month AS INT) AS month, avg(metric_value) AS metric_value, CAST(sum(sample_size) AS BIGINT) AS sample_size FROM "
        "(SELECT DISTINCT variable FROM m) AS v CROSS JOIN range(1, 13) AS k(month) "
        "LEFT JOIN m ON m.variable = v.variable AND m.month = k.month AND m.metric_name = 'rmse' GROUP BY v.variable, k.month",
        M,
        MM,
    ),
)
def _(spark, sf):
    return seasonal.monthly_chart(by_month_model_stored(spark, sf), "rmse")


@query(
    "agg42_season_lead_series",
    "AGG-42",
    sql=on_verification(
        "SELECT variable, season, lead_hours, avg(metric_value) AS metric_value, CAST(sum(sample_size) AS BIGINT) AS sample_size FROM m "
        "WHERE metric_name = 'mae' GROUP BY variable, season, lead_hours",
        M,
        SL,
    ),
)
def _(spark, sf):
    return seasonal.season_lead_series(by_season_lead_stored(spark, sf))


# --- anomalies -----------------------------------------------------------------------


@query(
    "ano01_high_error_groups",
    "ANO-01",
    sql=on_verification(
        "SELECT * FROM (SELECT g.variable, g.metric_name, g.lead_hours, g.e AS group_mean, (g.e - o.mu) / o.sd AS z_score FROM "
        "(SELECT variable, metric_name, lead_hours, avg(metric_value) AS e FROM m GROUP BY ALL) AS g JOIN "
        "(SELECT variable, metric_name, avg(metric_value) AS mu, stddev_samp(metric_value) AS sd FROM m GROUP BY ALL) AS o "
        "ON g.variable = o.variable AND g.metric_name = o.metric_name WHERE o.sd > 0) AS z WHERE abs(z_score) > 1.5",
        "group_mean z_score",
        ML,
    ),
)
def _(spark, sf):
    return anomalies.high_error_groups(by_model_lead_stored(spark, sf), n_sigma=1.5)


@query(
    "ano02_seasonal_bias_anomalies",
    "ANO-02",
    sql=on_verification(
        "SELECT * FROM (SELECT variable, season, bias, (bias - avg(bias) OVER w) / stddev_samp(bias) OVER w AS z_score FROM "
        "(SELECT variable, season, avg(metric_value) AS bias FROM m WHERE metric_name = 'bias' GROUP BY variable, season) AS s "
        "WINDOW w AS (PARTITION BY variable)) AS z WHERE abs(z_score) > 1.0",
        "bias z_score",
        SL,
    ),
)
def _(spark, sf):
    return anomalies.seasonal_bias_anomalies(by_season_lead_stored(spark, sf), 1.0)


@query(
    "ano03_iqr_outliers",
    "ANO-03",
    sql=on_verification(
        "SELECT m.* FROM m JOIN (SELECT variable, metric_name, quantile_cont(metric_value, 0.25) AS q1, quantile_cont(metric_value, 0.75) AS q3 "
        "FROM m GROUP BY variable, metric_name) AS q ON m.variable = q.variable AND m.metric_name = q.metric_name "
        "WHERE metric_value < q1 - 1.5 * (q3 - q1) OR metric_value > q3 + 1.5 * (q3 - q1)",
        M,
        ML,
    ),
)
def _(spark, sf):
    return anomalies.iqr_outliers(by_model_lead_stored(spark, sf))


# --- pivots --------------------------------------------------------------------------


@query(
    "srt02_pivot_metrics",
    "SRT-02",
    sql=on_verification(
        "SELECT model, lead_hours, "
        + ", ".join(
            f"max(metric_value) FILTER (WHERE variable = '{v}' AND metric_name = '{k}') AS {v}_{k}" for v in VARIABLES for k in ("mae", "rmse", "bias")
        )
        + " FROM m GROUP BY model, lead_hours",
        " ".join(f"{v}_{k}" for v in VARIABLES for k in ("mae", "rmse", "bias")),
        ML,
    ),
)
def _(spark, sf):
    values = [f"{v}_{k}" for v in VARIABLES for k in ("mae", "rmse", "bias")]
    return pivot_metrics(by_model_lead_stored(spark, sf), ["model", "lead_hours"], ["variable", "metric_name"], values)
