"""Queries: sources, sinks, set operations, dedup, month chunks, planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, temporal
from ..operators import align, planning, quality, sketches
from ..operators.metrics import grouped_metrics
from ..session import scratch_path
from ..sinks import datasets, metricstore, upsert
from ..sources import raw_json, tables, variant_json
from .q_events import by_model_stored
from .q_metrics import M, _sets_sql, by_model_lead_stored
from .q_quality import RANGES, validation_sql
from .registry import (
    CATALOG,
    ENSEMBLE_CTE,
    SQL_OPERATORS,
    VARIABLES,
    contingency_sql,
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

def _folder(name, spark, write) -> str:
    """A fresh folder that `write` has filled."""
    path = scratch_path(spark, name)
    write(path)
    return path


def forecast_rows(spark, sf):
    wide = verification(spark, sf).withColumnsRenamed({"forecast_qty": "qty", "forecast_price": "price"})
    cols = ["forecast_issue_time", "forecast_target_time", "lead_hours", "model", "latitude", "longitude", "location_id"]
    return wide.select(*cols, F.lit(None).cast("double").alias("elevation"), *VARIABLES, "order_id", "line_id")


def _forecast_root(spark, sf):
    rows = forecast_rows(spark, sf).drop("order_id", "line_id")
    return _folder("forecasts", spark, lambda p: datasets.write_verification(rows, p))


def _observation_root(spark, sf):
    rows = ensemble_observations(spark, sf).withColumnRenamed("value", "load").drop("variable")

    def write(path):
        with_elevation = rows.withColumn("elevation", F.lit(None).cast("double"))
        upsert.upsert_observations(with_elevation, path)

    return _folder("observations", spark, write)


# --- sources -------------------------------------------------------------------------


@query(
    "src01_load_forecasts",
    "SRC-01",
    sql=on_verification(
        "SELECT forecast_issue_time, forecast_target_time, lead_hours, model, latitude, longitude, location_id, forecast_qty AS qty, forecast_price AS price "
        "FROM verification WHERE model = 'AF' AND forecast_target_time BETWEEN TIMESTAMP '1997-03-15 00:00:00' AND TIMESTAMP '1998-02-10 23:59:59'",
        "latitude longitude price",
    ),
)
def _(spark, sf):
    rows = tables.load_forecasts(spark, _forecast_root(spark, sf), "AF", "1997-03-15", "1998-02-10", VARIABLES)
    return rows.drop("elevation")


@query(
    "src02_load_observations",
    "SRC-02",
    sql=on_ensemble(
        "SELECT observation_time, latitude, longitude, location_id, value AS load FROM ens_observations "
        "WHERE observation_time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 23:59:59'",
        "latitude longitude load",
    ),
)
def _(spark, sf):
    return tables.load_observations(spark, _observation_root(spark, sf), "2024-01-05", "2024-01-20", ["load"]).drop("elevation")


@query(
    "src03_read_verification_paths",
    "SRC-03",
    sql=on_verification("SELECT model, season, count(*) AS n, avg(forecast_price) AS mean_price FROM verification GROUP BY model, season", "mean_price"),
)
def _(spark, sf):
    root = _folder("by-season", spark, lambda p: verification(spark, sf).write.partitionBy("season").parquet(p))
    # Two folders and a glob; the season is in the folder name only.
    read = tables.union_null_filled(
        [
            tables.read_tables(spark, [f"{root}/season=DJF", f"{root}/season=MAM"]),
            tables.read_tables(spark, f"{root}/season=[JS]*"),
        ]
    )
    calendar = temporal.with_calendar(read.drop("season"), ["season"])
    return calendar.groupBy("model", "season").agg(F.count(F.lit(1)).alias("n"), F.avg("forecast_price").alias("mean_price"))


@query(
    "src04_read_metrics_with_differing_dims",
    "SRC-04",
    sql=on_verification(
        "SELECT CAST(NULL AS VARCHAR) AS season, model, variable, metric_name, metric_value, sample_size FROM "
        f"({metric_sql('model')}) AS a UNION ALL SELECT season, NULL, variable, metric_name, metric_value, sample_size FROM ({metric_sql('season')}) AS b",
        "metric_value",
    ),
)
def _(spark, sf):
    def write(path):
        for dim in ("model", "season"):
            grouped_metrics(verification(spark, sf), [dim], VARIABLES).write.parquet(f"{path}/{dim}")

    root = _folder("metric-files", spark, write)
    read = tables.read_tables(spark, [f"{root}/model", f"{root}/season"])
    return read.select("season", "model", "variable", "metric_name", "metric_value", "sample_size")


@query(
    "src05_partition_inventory",
    "SRC-05",
    sql=on_verification(
        "SELECT model, CAST(year(forecast_target_time) AS INT) AS year, month, count(*) AS row_count FROM verification GROUP BY ALL"
    ),
)
def _(spark, sf):
    return tables.partition_inventory(spark.read.parquet(_forecast_root(spark, sf)))


@query(
    "src05_footer_inventory",
    "SRC-05",
    sql=on_verification(
        "SELECT model, CAST(year(forecast_target_time) AS INT) AS year, month, count(*) AS row_count FROM verification GROUP BY ALL"
    ),
)
def _(spark, sf):
    return tables.footer_inventory(spark, _forecast_root(spark, sf))


def _documents(spark, sf):
    """Raw hourly documents, one per location and day, written as JSON and read back with a schema."""

    def write(path):
        o = ensemble_observations(spark, sf)
        stamp = F.date_format("observation_time", "yyyy-MM-dd'T'HH:mm")
        pairs = F.array_sort(F.collect_list(F.struct(stamp.alias("t"), F.col("value").alias("v"))))
        # A location has four slots a day, which bounds each document's arrays.
        docs = o.groupBy("location_id", "latitude", "longitude", F.to_date("observation_time").alias("day")).agg(pairs.alias("p"))
        hourly = F.struct(F.col("p.t").alias("time"), F.col("p.v").alias("load"))
        docs.select("latitude", "longitude", F.lit(10.0).alias("elevation"), hourly.alias("hourly"), F.col("location_id").alias("request_id")).write.json(path)

    root = _folder("observation-json", spark, write)
    extra = raw_json.T.StructField("request_id", raw_json.T.StringType())
    return raw_json.read_responses(spark, root, ["load", "wind"], [extra])


def _requests(spark, sf):
    """Where each location was asked for: its name and a point a little off the served one."""
    o = ensemble_observations(spark, sf).select("location_id", "latitude", "longitude").distinct()
    name = F.concat(F.lit("Site No. "), F.substring("location_id", 4, 3))
    columns = raw_json.request_columns(name, F.col("latitude") + 0.05, F.col("longitude") - 0.05, names.slug(name))
    return o.select(F.col("location_id").alias("request_id"), *columns)


@query(
    "src06_json_observations",
    "SRC-06",
    "SRC-10",
    "DQ-13",
    "DQ-14",
    sql=on_ensemble(
        "SELECT location_id AS request_id, latitude, longitude, CAST(10.0 AS DOUBLE) AS elevation, observation_time, value AS load, CAST(NULL AS DOUBLE) AS wind "
        "FROM ens_observations",
        "latitude longitude load",
    ),
)
def _(spark, sf):
    good, _ = raw_json.split_documents(_documents(spark, sf))
    return raw_json.observations(good, ["load", "wind"])


@query(
    "src11_location_provenance",
    "SRC-11",
    "FN-07",
    "DQ-15",
    sql=on_ensemble(
        "SELECT concat('site_no__', substr(location_id, 4)) AS location_id, concat('Site No. ', substr(location_id, 4)) AS location_name, observation_time, value AS load, "
        "latitude + 0.05::DOUBLE AS requested_latitude, longitude - 0.05::DOUBLE AS requested_longitude, 2 * 6371.0088 * asin(sqrt(pow(sin(radians(latitude - (latitude + 0.05::DOUBLE)) / 2), 2) + "
        "cos(radians(latitude + 0.05::DOUBLE)) * cos(radians(latitude)) * pow(sin(radians(longitude - (longitude - 0.05::DOUBLE)) / 2), 2))) AS location_distance_km FROM ens_observations",
        "load requested_latitude requested_longitude location_distance_km",
    ),
)
def _(spark, sf):
    asked = raw_json.with_location(_documents(spark, sf), _requests(spark, sf))
    good, _ = raw_json.split_documents(asked, max_km=50.0)
    rows = raw_json.observations(good, ["load"])
    return rows.select(
        "location_id", "location_name", "observation_time", "load", "requested_latitude", "requested_longitude", "location_distance_km"
    )


@query(
    "dq15_rejected_documents",
    "DQ-15",
    "DQ-13",
    "DQ-14",
    sql=on_ensemble(
        "SELECT location_id AS request_id, 'too_far' AS reject_reason, count(DISTINCT CAST(observation_time AS DATE)) AS documents FROM ens_observations "
        "GROUP BY location_id"
    ),
)
def _(spark, sf):
    asked = raw_json.with_location(_documents(spark, sf), _requests(spark, sf))
    _, bad = raw_json.split_documents(asked, max_km=1.0)
    return bad.groupBy("request_id", "reject_reason").agg(F.count(F.lit(1)).alias("documents"))


def _run_folder(spark, sf):
    def write(path):
        f = ensemble_forecasts(spark, sf)
        stamp = F.date_format("forecast_target_time", "yyyy-MM-dd'T'HH:mm")
        pairs = F.array_sort(F.collect_list(F.struct(stamp.alias("t"), F.col("value").alias("v"))))
        docs = f.groupBy("model", "location_id", "latitude", "longitude", "forecast_issue_time").agg(pairs.alias("p"))
        issued = F.date_format("forecast_issue_time", "yyyy-MM-dd'T'HH:mm:ss").alias("issued")
        hourly = F.struct(F.col("p.t").alias("time"), F.col("p.v").alias("load")).alias("hourly")
        docs.select("latitude", "longitude", F.lit(10.0).alias("elevation"), hourly, "model", issued, "location_id").write.json(path)

    return _folder("run-json", spark, write)


def _run_documents(spark, sf):
    extra = [raw_json.T.StructField(n, raw_json.T.StringType()) for n in ("model", "issued", "location_id")]
    docs = raw_json.read_responses(spark, _run_folder(spark, sf), ["load"], extra)
    return docs.withColumn("forecast_issue_time", F.to_timestamp("issued")).drop("issued")


@query(
    "src07_json_forecasts",
    "SRC-07",
    sql=on_ensemble(
        "SELECT latitude, longitude, CAST(10.0 AS DOUBLE) AS elevation, model, location_id, forecast_issue_time, forecast_target_time, value AS load, lead_hours FROM ens_forecasts",
        "latitude longitude load",
    ),
)
def _(spark, sf):
    good, _ = raw_json.split_documents(_run_documents(spark, sf))
    return raw_json.forecasts(good, ["load"])


def _mixed_documents(spark, sf):
    """Documents of one folder that differ in their variables: every second location also has `gust`, others `wind` in place of `load`."""

    def write(path):
        o = ensemble_observations(spark, sf)
        stamp = F.date_format("observation_time", "yyyy-MM-dd'T'HH:mm")
        number = F.substring("location_id", 4, 3).cast("int")
        pairs = F.array_sort(F.collect_list(F.struct(stamp.alias("t"), F.col("value").alias("v"))))
        # A location has four slots a day, which bounds each document's arrays.
        docs = o.groupBy("location_id", "latitude", "longitude", F.to_date("observation_time").alias("day")).agg(pairs.alias("p"))
        load, gust, wind = F.when(number % 3 != 2, F.col("p.v")), F.when(number % 2 == 1, F.transform("p.v", lambda v: v * 2)), F.when(number % 3 == 2, F.col("p.v"))
        hourly = F.struct(F.col("p.t").alias("time"), load.alias("load"), gust.alias("gust"), wind.alias("wind"))
        # Fields that are null are left out of the JSON.
        docs.select("latitude", "longitude", F.lit(10.0).alias("elevation"), hourly.alias("hourly"), F.col("location_id").alias("request_id")).write.json(path)

    return _folder("mixed-json", spark, write)


_NUMBER = "CAST(substr(location_id, 4) AS INT)"
_MIXED = {
    "load": f"CASE WHEN {_NUMBER} % 3 <> 2 THEN value END",
    "gust": f"CASE WHEN {_NUMBER} % 2 = 1 THEN value * 2 END",
    "wind": f"CASE WHEN {_NUMBER} % 3 = 2 THEN value END",
}


@query(
    "src06_variant_observations",
    "SRC-06",
    "SRC-10",
    sql=on_ensemble(
        "SELECT location_id AS request_id, latitude, longitude, CAST(10.0 AS DOUBLE) AS elevation, observation_time, "
        + ", ".join(f"{sql} AS {v}" for v, sql in _MIXED.items())
        + " FROM ens_observations",
        "latitude longitude load gust wind",
    ),
)
def _(spark, sf):
    docs, arrays = variant_json.read_responses(spark, _mixed_documents(spark, sf))
    good, _ = raw_json.split_documents(docs)
    return raw_json.observations(good, arrays)


@query(
    "src06_variant_hours",
    "SRC-06",
    sql=on_ensemble(
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT latitude, longitude, CAST(10.0 AS DOUBLE) AS elevation, location_id AS request_id, '{v}' AS variable, CAST(0 AS INT) AS lead_day, "
            f"observation_time AS time, {sql} AS value FROM ens_observations"
            for v, sql in _MIXED.items()
        )
        + ") AS h WHERE value IS NOT NULL",
        "latitude longitude value",
    ),
)
def _(spark, sf):
    return variant_json.long_hours(variant_json.read_documents(spark, _mixed_documents(spark, sf)), "request_id")


@query(
    "src07_variant_forecasts",
    "SRC-07",
    sql=on_ensemble(
        "SELECT latitude, longitude, CAST(10.0 AS DOUBLE) AS elevation, model, location_id, forecast_issue_time, forecast_target_time, value AS load, lead_hours FROM ens_forecasts",
        "latitude longitude load",
    ),
)
def _(spark, sf):
    docs, arrays = variant_json.read_responses(spark, _run_folder(spark, sf))
    good, _ = raw_json.split_documents(docs.withColumn("forecast_issue_time", F.to_timestamp("issued")).drop("issued"))
    return raw_json.forecasts(good, arrays)


def _previous_folder(spark, sf):
    """Documents whose array names carry the lead day, in three spellings; day 0 is the plain name."""

    def write(path):
        f = ensemble_forecasts(spark, sf)
        stamp = F.date_format("forecast_target_time", "yyyy-MM-dd'T'HH:mm")
        pairs = F.array_sort(
            F.collect_list(F.struct(stamp.alias("t"), (F.col("lead_hours") / 24).cast("int").alias("d"), F.col("value").alias("v")))
        )
        day = F.to_date("forecast_target_time").alias("day")
        docs = f.groupBy("model", "location_id", "latitude", "longitude", day).agg(pairs.alias("p"))
        spelled = {0: "load", 1: "load_previous_day1", 2: "load_previous_day_2", 3: "load_day3"}
        at_day = lambda d: (lambda x: F.when(x["d"] == d, x["v"]) if d else x["v"])
        arrays = [F.transform("p", at_day(d)).alias(n) for d, n in spelled.items()]
        hourly = F.struct(F.col("p.t").alias("time"), *arrays).alias("hourly")
        docs.select("latitude", "longitude", F.lit(10.0).alias("elevation"), hourly, "model", "location_id").write.option("ignoreNullFields", False).json(path)

    return _folder("previous-json", spark, write)


def _previous_documents(spark, sf):
    extra = [raw_json.T.StructField(n, raw_json.T.StringType()) for n in ("model", "location_id")]
    fields = ["load", "load_previous_day1", "load_previous_day_2", "load_day3"]
    return raw_json.read_responses(spark, _previous_folder(spark, sf), fields, extra)


PREVIOUS_SQL = on_ensemble(
    " UNION ALL ".join(
        f"SELECT latitude, longitude, CAST(10.0 AS DOUBLE) AS elevation, model, location_id, forecast_target_time - INTERVAL {24 * d} HOUR AS forecast_issue_time, "
        f"forecast_target_time, CAST({24 * d} AS INT) AS lead_hours, {'value' if d == 0 else f'CASE WHEN lead_hours = {24 * d} THEN value END'} AS load FROM ens_forecasts"
        for d in range(4)
    ),
    "latitude longitude load",
)


@query("src08_json_previous_runs", "SRC-08", "SRC-09", sql=PREVIOUS_SQL)
def _(spark, sf):
    # Days 4 to 7 are in no document and give no rows.
    return raw_json.previous_runs(_previous_documents(spark, sf), ["load"], lead_days=range(0, 8))


@query("src08_variant_previous_runs", "SRC-08", "SRC-09", sql=PREVIOUS_SQL)
def _(spark, sf):
    docs, arrays = variant_json.read_responses(spark, _previous_folder(spark, sf))
    variables, days = variant_json.lead_days(arrays)
    return raw_json.previous_runs(docs, variables, days)


@query(
    "src13_union_null_filled",
    "SRC-13",
    "SET-01",
    sql=on_ensemble(
        "SELECT location_id, forecast_target_time AS t, model, value FROM ens_forecasts UNION ALL SELECT location_id, observation_time, NULL, value FROM ens_observations",
        "value",
    ),
)
def _(spark, sf):
    f = ensemble_forecasts(spark, sf).select("location_id", F.col("forecast_target_time").alias("t"), "model", "value")
    o = ensemble_observations(spark, sf).select("location_id", F.col("observation_time").alias("t"), "value")
    return tables.union_null_filled([f, o])


@query(
    "src14_at_coordinates",
    "SRC-14",
    sql=on_ensemble(
        "SELECT f.forecast_target_time, f.model, f.value AS forecast_load, o.value AS observed_load FROM ens_forecasts f LEFT JOIN ens_observations o "
        "ON f.forecast_target_time = o.observation_time AND o.latitude = 51.5 WHERE f.latitude = 51.5 AND f.longitude = 8.75",
        "forecast_load observed_load",
    ),
)
def _(spark, sf):
    pick = lambda df: tables.at_coordinates(df, 51.5, 8.75).withColumnRenamed("value", "load").drop("location_id", "variable")
    out = align.align(pick(ensemble_forecasts(spark, sf)), pick(ensemble_observations(spark, sf)), ["load"], point_keys=False)
    return out.select("forecast_target_time", "model", "forecast_load", "observed_load")


# --- sinks ---------------------------------------------------------------------------

_LAST = (
    "row_number() OVER (PARTITION BY forecast_issue_time, forecast_target_time, model, location_id ORDER BY order_id DESC, line_id DESC)"
)


@query(
    "snk01_upsert_forecasts",
    "SNK-01",
    "SNK-03",
    "SRT-03",
    sql=on_verification(
        "SELECT forecast_issue_time, forecast_target_time, model, location_id, order_id, line_id, CASE WHEN season = 'JJA' THEN forecast_qty + 1 ELSE forecast_qty END AS qty, "
        f"CAST(year(forecast_target_time) AS INT) AS year, month FROM (SELECT *, {_LAST} AS rn FROM verification) AS v WHERE rn = 1"
    ),
)
def _(spark, sf):
    path = scratch_path(spark, "upsert-forecasts")
    first = forecast_rows(spark, sf).drop("price", "elevation")
    upsert.upsert_forecasts(first, path, order_by=["order_id", "line_id"])
    # The summer is delivered again with corrected values.
    again = first.where(temporal.season_of("forecast_target_time") == "JJA").withColumn("qty", F.col("qty") + 1)
    upsert.upsert_forecasts(again, path, order_by=["order_id", "line_id"])
    return spark.read.parquet(path).drop("latitude", "longitude", "lead_hours")


@query(
    "snk02_upsert_observations",
    "SNK-02",
    "SNK-03",
    sql=on_ensemble(
        "SELECT location_id, observation_time, CASE WHEN observation_time >= TIMESTAMP '2024-01-16' THEN value * 2 ELSE value END AS load, "
        "CASE WHEN observation_time >= TIMESTAMP '2024-01-16' THEN CAST(1.5 AS DOUBLE) END AS wind FROM ens_observations",
        "load",
    ),
)
def _(spark, sf):
    path = scratch_path(spark, "upsert-observations")
    first = ensemble_observations(spark, sf).withColumnRenamed("value", "load").drop("variable")
    upsert.upsert_observations(first, path)
    late = first.where(F.col("observation_time") >= "2024-01-16").withColumns({"load": F.col("load") * 2, "wind": F.lit(1.5)})
    upsert.upsert_observations(late, path)
    read = spark.read.option("mergeSchema", True).parquet(path)
    return read.select("location_id", "observation_time", "load", "wind")


@query("snk04_write_metrics", "SNK-04", sql=on_verification(metric_sql("model, lead_hours"), "metric_value"))
def _(spark, sf):
    path = scratch_path(spark, "metrics")
    datasets.write_metrics(by_model_lead_stored(spark, sf), path, {"source": "verification"})
    return spark.read.parquet(path)


@query(
    "snk05_export_csv",
    "SNK-05",
    sql=on_verification(
        "SELECT model, lead_hours, variable, metric_name, metric_value, sample_size FROM "
        f"({metric_sql('model, lead_hours')}) AS m",
        "metric_value",
    ),
)
def _(spark, sf):
    path = scratch_path(spark, "csv")
    datasets.export_csv(by_model_lead_stored(spark, sf), path)
    schema = by_model_lead_stored(spark, sf).schema
    read = spark.read.schema(schema).option("header", True).csv(path)
    return read.select("model", "lead_hours", "variable", "metric_name", "metric_value", "sample_size")


@query("snk06_write_by_event", "SNK-06", sql=on_verification(contingency_sql("model")))
def _(spark, sf):
    path = scratch_path(spark, "events")
    datasets.write_by_event(by_model_stored(spark, sf), path)
    return spark.read.parquet(path)


@query(
    "snk07_ingest_log",
    "SNK-07",
    sql=on_ensemble(
        "SELECT 'forecasts' AS type, model, CAST(min(forecast_target_time) AS DATE) AS start_date, CAST(max(forecast_target_time) AS DATE) AS end_date, "
        "count(*) AS rows_downloaded, CAST(0 AS BIGINT) AS rows_skipped FROM ens_forecasts GROUP BY model"
    ),
)
def _(spark, sf):
    path = scratch_path(spark, "log")
    record = datasets.ingest_log(ensemble_forecasts(spark, sf), "forecasts", "forecast_target_time")
    datasets.append_log(record, path)
    return spark.read.schema(record.schema).json(path).drop("timestamp")


def _report(spark, sf):
    """All checks of the verification table, written; the issues and the folder."""
    path = scratch_path(spark, "report")
    issues = quality.validate_verification(verification(spark, sf), VARIABLES, RANGES)
    datasets.save_validation_report(issues, path)
    return issues, path


@query("snk08_validation_report", "SNK-08", sql=on_verification(validation_sql("verification")))
def _(spark, sf):
    issues, path = _report(spark, sf)
    return spark.read.schema(issues.schema).json(f"{path}/issues")


@query(
    "snk08_validation_totals",
    "SNK-08",
    sql=on_verification(
        f"SELECT severity, count(*) AS issues, CAST(sum(count) AS BIGINT) AS affected_rows FROM ({validation_sql('verification')}) AS i GROUP BY severity"
    ),
)
def _(spark, sf):
    issues, path = _report(spark, sf)
    return spark.read.schema(quality.severity_totals(issues).schema).json(f"{path}/totals")


@query("snk09_build_metrics", "SNK-09", sql=on_verification(_sets_sql(), M))
def _(spark, sf):
    path = scratch_path(spark, "metric-groups-all")
    datasets.build_metrics(verification(spark, sf), path, VARIABLES)
    return spark.read.parquet(path)


# Folders of the stored verification table here: a month has few rows.
BY_YEAR = ("model", "year")


def _delivered(spark, sf, refresh):
    """The verification table in two deliveries, and what `refresh` keeps beside it.

    The first one lacks a month and has another with wrong errors; the second brings both.
    """
    root, store = scratch_path(spark, "verification-parts"), scratch_path(spark, "metric-store")
    rows = verification(spark, sf).drop("season", "month")
    late = F.trunc("forecast_target_time", "MM")
    wrong = rows.where(late != "1995-06-01").withColumns(
        {f"{v}_error": F.when(late == "1996-03-01", F.col(f"{v}_error") + 7).otherwise(F.col(f"{v}_error")) for v in VARIABLES}
    )
    for delivery in (wrong, rows.where(late.isin("1995-06-01", "1996-03-01"))):
        touched = metricstore.append_verification(delivery, root, ["order_id", "line_id"], partitions=BY_YEAR)
        refresh(spark, root, store, touched, VARIABLES, BY_YEAR)
    return store


@query("snk09_incremental_metrics", "SNK-09", "AGG-08", sql=on_verification(_sets_sql(), M))
def _(spark, sf):
    return metricstore.stored_metrics(spark, _delivered(spark, sf, metricstore.refresh_moments), VARIABLES)


PERCENTILES = (0.0, 5.0, 25.0, 50.0, 75.0, 95.0, 100.0)


def _sketch_sql(key: str) -> str:
    each = " UNION ALL ".join(
        f"SELECT {key}, '{v}' AS variable, count({v}_error) AS n, min({v}_error) AS least, max({v}_error) AS most FROM verification GROUP BY {key} HAVING count({v}_error) > 0"
        for v in VARIABLES
    )
    at = ", ".join(f"({p})" for p in PERCENTILES)
    return (
        f"SELECT {key}, variable, n, CAST(p AS DOUBLE) AS percentile, CASE p WHEN 0 THEN least WHEN 100 THEN most END AS end_value, TRUE AS within "
        f"FROM ({each}) AS s, (VALUES {at}) AS q(p)"
    )


def _sketch_quantiles(spark, sf, key):
    """Quantiles of stored sketches by `key`: exact ends, and whether each lies within the rank error among all rows."""
    store = _delivered(spark, sf, metricstore.refresh_sketches)
    found = stored("sketch-quantiles", spark, sf, lambda sp, _: sketches.sketch_quantiles(metricstore.stored_sketches(sp, store, [key]), PERCENTILES))
    errors = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"{v}_error").alias("e")) for v in VARIABLES])
    rows = verification(spark, sf).select(key, F.inline(errors))
    p, share = F.col("percentile") / 100, lambda test: F.count_if(test) / F.col("n")
    seen = rows.join(found, [key, "variable"]).groupBy(key, "variable", "n", "percentile", "value").agg(
        ((share(F.col("e") <= F.col("value")) >= p - sketches.RANK_ERROR) & (share(F.col("e") < F.col("value")) <= p + sketches.RANK_ERROR)).alias("within")
    )
    end = F.when(F.col("percentile").isin(0.0, 100.0), F.col("value")).alias("end_value")
    return seen.select(key, "variable", "n", "percentile", end, "within")


@query("agg21_stored_sketches", "AGG-21", sql=on_verification(_sketch_sql("model"), "end_value"))
def _(spark, sf):
    return _sketch_quantiles(spark, sf, "model")


@query("agg22_stored_sketches_by_lead", "AGG-22", sql=on_verification(_sketch_sql("lead_hours"), "end_value"))
def _(spark, sf):
    return _sketch_quantiles(spark, sf, "lead_hours")


@query(
    "snk10_build_events",
    "SNK-10",
    sql=on_verification(
        " UNION ALL ".join(
            f"SELECT '{name}' AS event_name, '{source}' AS source, model, CAST(forecast_target_time AS DATE) AS event_date, {source}_{v} AS value "
            f"FROM verification WHERE {source}_{v} {SQL_OPERATORS[op]} {t}"
            for name, (v, t, op) in CATALOG.items()
            for source in ("observed", "forecast")
        ),
        "value",
    ),
)
def _(spark, sf):
    path = scratch_path(spark, "event-rows")
    datasets.build_events(verification(spark, sf), path, CATALOG, only_events=True)
    return spark.read.parquet(path).select("event_name", "source", "model", "event_date", "value")


@query(
    "snk11_dataset_statistics",
    "SNK-11",
    sql="WITH "
    + ENSEMBLE_CTE
    + ", v AS (SELECT 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey "
    "WHERE datediff('day', o_orderdate, l_shipdate) >= 0) SELECT (SELECT count(*) FROM ens_forecasts) AS forecast_rows, "
    "(SELECT count(*) FROM ens_observations) AS observation_rows, count(*) AS verification_rows, 'cheap,high,low' AS event_datasets, "
    "'lead_hours,model,month,season' AS metric_groups FROM v",
)
def _(spark, sf):
    # Events and groupings are those that the stored tables hold.
    event_path, metric_path = scratch_path(spark, "event-rows"), scratch_path(spark, "metric-groups")
    datasets.build_events(verification(spark, sf), event_path, CATALOG, only_events=True)
    datasets.build_metrics(verification(spark, sf), metric_path, VARIABLES)
    row = datasets.dataset_statistics(
        ensemble_forecasts(spark, sf), ensemble_observations(spark, sf), verification(spark, sf), spark.read.parquet(event_path), spark.read.parquet(metric_path)
    )
    joined = {c: F.array_join(c, ",") for c in ("event_datasets", "metric_groups")}
    return row.withColumns(joined)


# --- sorts, dedup, set operations ----------------------------------------------------


@query(
    "srt03_keep_first",
    "SRT-03",
    sql=on_verification(
        "SELECT forecast_target_time, location_id, order_id, line_id, forecast_qty FROM (SELECT *, row_number() OVER "
        "(PARTITION BY forecast_target_time, location_id ORDER BY order_id, line_id) AS rn FROM verification) AS v WHERE rn = 1"
    ),
)
def _(spark, sf):
    rows = verification(spark, sf)
    first = F.min_by(F.struct("order_id", "line_id", "forecast_qty"), F.struct("order_id", "line_id")).alias("f")
    return rows.groupBy("forecast_target_time", "location_id").agg(first).select("forecast_target_time", "location_id", "f.*")


@query(
    "srt04_distinct_record_keys",
    "SRT-04",
    sql=on_ensemble(
        "SELECT DISTINCT model, forecast_issue_time, forecast_target_time, latitude, longitude, variable FROM ens_forecasts "
        "ORDER BY forecast_issue_time, forecast_target_time, variable",
        "latitude longitude",
    ),
)
def _(spark, sf):
    key = ["model", "forecast_issue_time", "forecast_target_time", "latitude", "longitude", "variable"]
    distinct = ensemble_forecasts(spark, sf).select(*key).distinct()
    return distinct.orderBy("forecast_issue_time", "forecast_target_time", "variable")


@query(
    "set02_union_of_keys",
    "SET-02",
    sql=on_ensemble(
        "SELECT forecast_target_time AS valid_time, location_id FROM ens_forecasts UNION SELECT observation_time, location_id FROM ens_observations"
    ),
)
def _(spark, sf):
    f = ensemble_forecasts(spark, sf).select(F.col("forecast_target_time").alias("valid_time"), "location_id")
    o = ensemble_observations(spark, sf).select(F.col("observation_time").alias("valid_time"), "location_id")
    return f.union(o).distinct()


@query(
    "set03_target_difference",
    "SET-03",
    sql=on_ensemble("SELECT forecast_target_time AS t, location_id FROM ens_forecasts EXCEPT SELECT observation_time, location_id FROM ens_observations"),
)
def _(spark, sf):
    f = ensemble_forecasts(spark, sf).select(F.col("forecast_target_time").alias("t"), "location_id")
    return f.subtract(ensemble_observations(spark, sf).select("observation_time", "location_id"))


@query(
    "set04_observations_with_forecast",
    "SET-04",
    sql=on_verification(
        "SELECT event_id FROM events WHERE CAST(ts AS DATE) IN (SELECT CAST(date_trunc('day', ts) AS DATE) FROM events WHERE value >= 400)"
    ),
)
def _(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("day", F.to_date("ts"))
    wanted = events.where("value >= 400").select("day").distinct()
    return events.join(wanted, "day", "left_semi").select("event_id")


# --- names and dates -----------------------------------------------------------------


@query("fn07_slug", "FN-07", sql="SELECT p_partkey, trim(regexp_replace(lower(concat(p_name, ' (', p_brand, ')')), '[^a-z0-9]', '_', 'g'), '_') AS slug FROM part")
def _(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet")
    label = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")"))
    return parts.select("p_partkey", names.slug(label).alias("slug"))


@query(
    "fn09_site_of_corner",
    "FN-09",
    sql=on_verification("SELECT location_id, count(*) AS n FROM verification GROUP BY location_id"),
)
def _(spark, sf):
    corner = F.concat_ws("__", "location_id", "model", F.concat(F.lit("c"), "month"))
    rows = verification(spark, sf).select(names.site_of_corner(corner).alias("location_id"))
    return rows.groupBy("location_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fn10_month_chunks",
    "FN-10",
    sql=(
        "SELECT o_custkey, greatest(m, lo) AS chunk_start, least(CAST(m + INTERVAL 2 MONTH - INTERVAL 1 DAY AS DATE), hi) AS chunk_end FROM ("
        "SELECT o_custkey, lo, hi, CAST(unnest(generate_series(date_trunc('month', lo), CAST(hi AS TIMESTAMP), INTERVAL 2 MONTH)) AS DATE) AS m FROM ("
        "SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders GROUP BY o_custkey) AS r) AS c"
    ),
)
def _(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    ranges = orders.groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    return ranges.select("o_custkey", F.inline(temporal.month_chunks("lo", "hi", 2)))


# --- completeness --------------------------------------------------------------------


@query(
    "dq17_run_overlap",
    "DQ-17",
    sql=on_verification(
        "SELECT latitude, longitude, forecast_target_time AS valid_time, 'qty' AS variable, string_agg(DISTINCT CAST(forecast_issue_time AS VARCHAR), ',' "
        "ORDER BY CAST(forecast_issue_time AS VARCHAR)) AS run_times, count(DISTINCT forecast_issue_time) AS num_runs, count(*) AS record_count "
        "FROM verification GROUP BY latitude, longitude, forecast_target_time HAVING count(DISTINCT forecast_issue_time) > 1",
        "latitude longitude",
    ),
)
def _(spark, sf):
    rows = verification(spark, sf).withColumnsRenamed({"forecast_target_time": "valid_time", "forecast_issue_time": "run_time"})
    out = align.run_overlap(rows.withColumn("variable", F.lit("qty")))
    stamps = F.transform("run_times", lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
    return out.withColumn("run_times", F.array_join(stamps, ","))


@query(
    "dq18_missing_runs",
    "DQ-18",
    sql=on_ensemble(
        "SELECT m.model, d + INTERVAL (h) HOUR AS forecast_issue_time FROM (SELECT DISTINCT model FROM ens_forecasts) AS m, "
        "generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) AS days(d), (VALUES (0), (6), (12), (18)) AS hours(h) "
        "WHERE NOT EXISTS (SELECT 1 FROM ens_forecasts f WHERE f.model = m.model AND f.forecast_issue_time = d + INTERVAL (h) HOUR)"
    ),
)
def _(spark, sf):
    f = ensemble_forecasts(spark, sf)
    expected = planning.expected_runs(f, "2024-01-01", "2024-01-31", default_hours=(0, 6, 12, 18))
    return planning.missing_runs(expected, f)


@query(
    "dq18_missing_leads",
    "DQ-18",
    sql=on_ensemble(
        "SELECT model, location_id, CAST(b + 24 AS INT) AS first_missing, CAST(lead_hours - 24 AS INT) AS last_missing, CAST((lead_hours - b) // 24 - 1 AS BIGINT) AS missing, "
        "forecast_issue_time FROM (SELECT *, coalesce(lag(lead_hours) OVER (PARTITION BY model, location_id, forecast_issue_time ORDER BY lead_hours), -24) AS b FROM ("
        "SELECT DISTINCT model, location_id, forecast_issue_time, lead_hours FROM ens_forecasts WHERE lead_hours <= CASE WHEN model = 'purchase' THEN 48 ELSE 168 END "
        "UNION ALL SELECT DISTINCT model, location_id, forecast_issue_time, CASE WHEN model = 'purchase' THEN 72 ELSE 192 END FROM ens_forecasts) AS l) AS g WHERE lead_hours - b > 24"
    ),
)
def _(spark, sf):
    run = ("model", "location_id", "forecast_issue_time")
    return planning.missing_leads(ensemble_forecasts(spark, sf), run, step=24, horizons={"purchase": 48}, default=168)


_PLAN = (
    "plan AS (SELECT l.location_id, m.model, CAST(s AS DATE) AS chunk_start, least(CAST(s + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE), DATE '1998-12-31') AS chunk_end "
    "FROM (SELECT DISTINCT location_id FROM verification) AS l, (VALUES ('AF'), ('RO')) AS m(model), "
    "generate_series(TIMESTAMP '1998-01-01', TIMESTAMP '1998-12-31', INTERVAL 1 MONTH) AS months(s))"
)


def _plan(spark, sf):
    places = verification(spark, sf).select(F.col("location_id").alias("name"), "latitude", "longitude").distinct()
    return planning.coverage_plan(places, ["AF", "RO"], "1998-01-01", "1998-12-31", kinds=["historical_forecast"])


@query(
    "dq19_coverage_gaps",
    "DQ-19",
    sql=on_verification(
        "SELECT location_id, model, chunk_start, chunk_end FROM plan WHERE NOT EXISTS (SELECT 1 FROM verification v WHERE v.location_id = plan.location_id "
        "AND v.model = plan.model AND date_trunc('month', v.forecast_target_time) = plan.chunk_start)",
        "",
        _PLAN,
    ),
)
def _(spark, sf):
    inventory = tables.partition_inventory(
        verification(spark, sf).withColumn("year", F.year("forecast_target_time")), ("location_id", "model", "year", "month")
    )
    return planning.uncovered(_plan(spark, sf), inventory).select("location_id", "model", "chunk_start", "chunk_end")


_TWO_MONTHS = (
    "plan2 AS (SELECT l.location_id, k.kind, k.model, CAST(s AS DATE) AS chunk_start, "
    "least(CAST(s + INTERVAL 2 MONTH - INTERVAL 1 DAY AS DATE), DATE '1998-12-31') AS chunk_end FROM (SELECT DISTINCT location_id FROM verification) AS l, "
    "(VALUES ('historical_forecast', 'AF'), ('historical_forecast', 'RO'), ('observations', NULL)) AS k(kind, model), "
    "generate_series(TIMESTAMP '1998-01-01', TIMESTAMP '1998-12-31', INTERVAL 2 MONTH) AS months(s)), "
    "stock AS (SELECT DISTINCT location_id, model, CAST(date_trunc('month', forecast_target_time) AS DATE) AS month FROM verification "
    "UNION SELECT DISTINCT location_id, NULL, CAST(date_trunc('month', observation_time) AS DATE) FROM verification "
    "WHERE observation_time IS NOT NULL AND month(observation_time) <> 2)"
)


@query(
    "dq19_two_month_chunks",
    "DQ-19",
    sql=on_verification(
        "SELECT location_id, kind, model, chunk_start, chunk_end, count(*) AS missing FROM (SELECT *, unnest([chunk_start, CAST(chunk_start + INTERVAL 1 MONTH AS DATE)]) AS m FROM plan2) AS p "
        "WHERE m <= chunk_end AND NOT EXISTS (SELECT 1 FROM stock WHERE stock.location_id = p.location_id AND stock.model IS NOT DISTINCT FROM p.model AND stock.month = p.m) "
        "GROUP BY ALL",
        "",
        _TWO_MONTHS,
    ),
)
def _(spark, sf):
    # The stock of observations lacks every February, the second month of a chunk.
    rows = verification(spark, sf)
    keys = ("location_id", "model", "year", "month")
    forecasts = tables.partition_inventory(rows.withColumn("year", F.year("forecast_target_time")), keys)
    seen = rows.where("observation_time IS NOT NULL AND month(observation_time) <> 2").withColumns(
        {"year": F.year("observation_time"), "month": F.month("observation_time"), "model": F.lit(None).cast("string")}
    )
    stock = forecasts.select(*keys).unionByName(seen.select(*keys).distinct())
    places = rows.select(F.col("location_id").alias("name"), "latitude", "longitude").distinct()
    plan = planning.coverage_plan(places, ["AF", "RO"], "1998-01-01", "1998-12-31", kinds=["historical_forecast", "observations"], months=2)
    gaps = planning.uncovered(plan, stock)
    return gaps.select("location_id", "kind", "model", "chunk_start", "chunk_end", F.size("missing_months").cast("bigint").alias("missing"))


@query(
    "jn15_remaining_tasks",
    "JN-15",
    sql=on_verification(
        "SELECT concat('histfc:', location_id, ':', model, ':', CAST(chunk_start AS VARCHAR), ':', CAST(chunk_end AS VARCHAR)) AS task_id FROM plan "
        "WHERE chunk_start >= DATE '1998-07-01' OR model = 'RO'",
        "",
        _PLAN,
    ),
)
def _(spark, sf):
    plan = _plan(spark, sf)
    # The first half of the year is done for AF and failed for RO.
    status = F.when(F.col("model") == "AF", "success").otherwise("error").alias("status")
    log = plan.where(F.col("chunk_start") < "1998-07-01").select("task_id", status)
    return planning.remaining_tasks(plan, log).select("task_id")
