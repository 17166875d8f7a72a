"""Queries: streaming forms, each run over all available input and equal to its batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sinks import upsert
from ..sources import raw_json
from ..streaming import jobs
from .q_tables import _folder
from .registry import ensemble_forecasts, ensemble_observations, on_ensemble, plain, query


def _events(spark, sf):
    """The event file as a stream, with event time as TIMESTAMP."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = jobs.read_files(spark, sf, schema, pattern="events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(spark, name):
    return scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")


def _drops(spark, sf, name, table):
    """A table as files in a folder that a stream picks up."""
    return _folder(f"drops-{name}", spark, lambda path: table.write.parquet(path))


@query(
    "str01_json_ingest",
    "STR-01",
    sql=on_ensemble("SELECT location_id, observation_time, value AS load FROM ens_observations", "load"),
)
def _(spark, sf):
    def write(path):
        o = ensemble_observations(spark, sf)
        stamp = F.date_format("observation_time", "yyyy-MM-dd'T'HH:mm")
        pairs = F.array_sort(F.collect_list(F.struct(stamp.alias("t"), F.col("value").alias("v"))))
        docs = o.groupBy("location_id", "latitude", "longitude", F.to_date("observation_time").alias("day")).agg(pairs.alias("p"))
        hourly = F.struct(F.col("p.t").alias("time"), F.col("p.v").alias("load")).alias("hourly")
        # Every document is dropped twice, as a retried delivery would.
        docs.select("latitude", "longitude", F.lit(0.0).alias("elevation"), hourly, "location_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery")).drop("delivery").write.json(path)

    folder = _folder("json-drops", spark, write)
    schema = raw_json.response_schema(["load"], [raw_json.T.StructField("location_id", raw_json.T.StringType())])
    stream = jobs.read_files(spark, folder, schema, "json")
    target, checkpoint = _run(spark, "json-ingest")

    def store(batch, batch_id):
        good, _ = raw_json.split_documents(batch)
        upsert.upsert_observations(raw_json.observations(good, ["load"]), target)

    jobs.run_batches(stream, store, checkpoint)
    return spark.read.parquet(target).select("location_id", "observation_time", "load")


@query(
    "str02_distinct_forecasts",
    "STR-02",
    sql=on_ensemble("SELECT DISTINCT forecast_issue_time, forecast_target_time, model, location_id FROM ens_forecasts"),
)
def _(spark, sf):
    twice = ensemble_forecasts(spark, sf).select("forecast_issue_time", "forecast_target_time", "model", "location_id")
    twice = twice.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    folder = _drops(spark, sf, "forecasts", twice)
    stream = jobs.read_files(spark, folder, twice.schema)
    out = jobs.distinct_forecasts(stream.drop("delivery"), "60 days")
    return jobs.run_append(out, *_run(spark, "distinct"))


@query(
    "str02_latest_forecasts",
    "STR-02",
    sql=on_ensemble(
        "SELECT forecast_issue_time, forecast_target_time, model, location_id, CASE WHEN lead_hours % 48 = 0 THEN value + 2 WHEN lead_hours % 72 = 0 THEN value + 1 ELSE value END AS load, "
        "CAST(CASE WHEN lead_hours % 48 = 0 THEN 3 WHEN lead_hours % 72 = 0 THEN 2 ELSE 1 END AS INT) AS delivery FROM ens_forecasts",
        "load",
    ),
)
def _(spark, sf):
    columns = ["forecast_issue_time", "forecast_target_time", "model", "location_id", (F.col("value")).alias("load")]
    first = ensemble_forecasts(spark, sf)
    deliver = lambda rows, n: rows.select(*columns).withColumns({"load": F.col("load") + (n - 1), "delivery": F.lit(n)})
    # The third delivery comes before the second, which corrects other rows too and comes after a restart.
    folder = _folder("forecast-deliveries", spark, lambda path: deliver(first, 1).write.parquet(path))
    deliver(first.where("lead_hours % 48 = 0"), 3).write.mode("append").parquet(folder)
    run = _run(spark, "latest")
    key = ["forecast_issue_time", "forecast_target_time", "model", "location_id"]
    out = jobs.latest_forecasts(jobs.read_files(spark, folder, spark.read.parquet(folder).schema), "delivery", "60 days")
    jobs.run_update(out, *run, key)
    deliver(first.where("lead_hours % 72 = 0"), 2).write.mode("append").parquet(folder)
    return jobs.run_update(out, *run, key)


def _window_sql(length: int, slide: int) -> str:
    """Sliding windows of `length` hours every `slide` hours over the raw events."""
    shifts = ", ".join(f"({k})" for k in range(length // slide))
    return (
        f"SELECT make_timestamp(CAST(s * 1000000 AS BIGINT)) AS window_start, make_timestamp(CAST((s + {length * 3600}) * 1000000 AS BIGINT)) AS window_end, event_type, avg(abs(e)) AS mae, "
        f"sqrt(avg(e * e)) AS rmse, avg(e) AS bias, count(e) AS sample_size FROM (SELECT event_type, value - 50.0 AS e, (floor(epoch(ts) / {slide * 3600}) - k) * {slide * 3600} AS s "
        f"FROM events, (VALUES {shifts}) AS v(k)) AS x GROUP BY s, event_type"
    )


@query("str03_tumbling_metrics", "STR-03", sql=plain(_window_sql(24, 24), "mae rmse bias"))
def _(spark, sf):
    rows = _events(spark, sf).withColumn("error", F.col("value") - 50.0)
    out = jobs.rolling_metrics(rows, "error", "ts", "24 hours", by=["event_type"])
    return jobs.run_update(out, *_run(spark, "tumbling"), ["window_start", "window_end", "event_type"])


@query("str03_sliding_metrics", "STR-03", sql=plain(_window_sql(24, 6), "mae rmse bias"))
def _(spark, sf):
    rows = _events(spark, sf).withColumn("error", F.col("value") - 50.0)
    out = jobs.rolling_metrics(rows, "error", "ts", "24 hours", "6 hours", ["event_type"])
    return jobs.run_update(out, *_run(spark, "sliding"), ["window_start", "window_end", "event_type"])


# Key of the rows that close both streams of a join.
CLOSING = "_closing"


def _aligned(spark, sf, name, observations):
    """All forecasts beside their observations; closing rows push the watermark past the last target, so that unmatched ones appear."""
    f = ensemble_forecasts(spark, sf).withColumnRenamed("value", "load").select("forecast_target_time", "model", "location_id", "load")
    o = observations.withColumnRenamed("value", "load").select("observation_time", "location_id", "load")
    f_drops, o_drops = _drops(spark, sf, f"{name}-forecasts", f), _drops(spark, sf, f"{name}-observations", o)
    fs, os = jobs.read_files(spark, f_drops, f.schema), jobs.read_files(spark, o_drops, o.schema)
    run = _run(spark, f"{name}-aligned")
    jobs.run_append(jobs.align_streams(fs, os, ["load"], "60 days"), *run)

    times = f.select(F.col("forecast_target_time").alias("t")).unionByName(o.select(F.col("observation_time").alias("t")))
    last = times.agg((F.coalesce(F.max("t"), F.timestamp_seconds(F.lit(0))) + F.expr("INTERVAL 61 DAYS")).alias("t"))
    for rows, folder, time in ((f, f_drops, "forecast_target_time"), (o, o_drops, "observation_time")):
        given = {time: F.col("t"), "location_id": F.lit(CLOSING)}
        last.select(*[given.get(c.name, F.lit(None)).cast(c.dataType).alias(c.name) for c in rows.schema]).write.mode("append").parquet(folder)
    out = jobs.run_append(jobs.align_streams(fs, os, ["load"], "60 days"), *run)
    return out.where(F.coalesce(F.col("location_id") != CLOSING, F.lit(True))).drop("observation_time")


@query(
    "str04_aligned_streams",
    "STR-04",
    sql=on_ensemble(
        "SELECT forecast_target_time, model, f.location_id, f.value AS forecast_load, o.value AS observed_load, f.value - o.value AS load_error FROM ens_forecasts f "
        "JOIN ens_observations o ON f.forecast_target_time = o.observation_time AND f.location_id = o.location_id",
        "forecast_load observed_load load_error",
    ),
)
def _(spark, sf):
    return _aligned(spark, sf, "join", ensemble_observations(spark, sf))


@query(
    "str04_outer_aligned_streams",
    "STR-04",
    sql=on_ensemble(
        "SELECT forecast_target_time, model, f.location_id, f.value AS forecast_load, o.value AS observed_load, f.value - o.value AS load_error FROM ens_forecasts f "
        "LEFT JOIN (SELECT * FROM ens_observations WHERE location_id <> 'loc3') AS o ON f.forecast_target_time = o.observation_time AND f.location_id = o.location_id",
        "forecast_load observed_load load_error",
    ),
)
def _(spark, sf):
    # A station that reports nothing: its forecasts have no partner.
    return _aligned(spark, sf, "outer-join", ensemble_observations(spark, sf).where("location_id <> 'loc3'"))


@query(
    "str05_reporting_sessions",
    "STR-05",
    "WIN-01",
    sql=(
        "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 90 MINUTE AS session_end, count(*) AS reports FROM (SELECT *, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM ("
        "SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 90 MINUTE THEN 0 ELSE 1 END AS is_new FROM events) AS a) AS b GROUP BY user_id, island HAVING max(ts) + INTERVAL 90 MINUTE <= (SELECT max(ts) FROM events)"
    ),
)
def _(spark, sf):
    # A spell is appended once the watermark has passed its end; spells still open stay in the state.
    sessions = jobs.report_sessions(_events(spark, sf), ["user_id"], "ts", late="0 seconds")
    return jobs.run_append(sessions, *_run(spark, "sessions"))


@query(
    "str05_open_and_closed_sessions",
    "STR-05",
    sql=(
        "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 90 MINUTE AS session_end, count(*) AS reports, max(ts) + INTERVAL 90 MINUTE > (SELECT max(ts) FROM events) AS is_open "
        "FROM (SELECT *, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM ("
        "SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 90 MINUTE THEN 0 ELSE 1 END AS is_new FROM events) AS a) AS b GROUP BY user_id, island"
    ),
)
def _(spark, sf):
    return jobs.run_sessions(_events(spark, sf), ["user_id"], "ts", *_run(spark, "open-sessions"), late="0 seconds")
