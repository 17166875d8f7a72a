from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillgauge.sinks import datasets, upsert
from skillgauge.sources import raw_json, tables
from skillgauge.streaming import jobs


def batch(spark, rows, extra=()):
    cols = "location_id string, model string, issue string, target string, temperature_2m double" + "".join(f", {c} double" for c in extra)
    df = spark.createDataFrame(rows, cols)
    return df.select("location_id", "model", F.to_timestamp("issue").alias("forecast_issue_time"), F.to_timestamp("target").alias("forecast_target_time"), F.lit(24).alias("lead_hours"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), F.lit(0.0).alias("elevation"), "temperature_2m", *extra)


JAN, FEB = ("2024-01-01 00:00:00", "2024-01-02 00:00:00"), ("2024-02-01 00:00:00", "2024-02-02 00:00:00")


def test_upsert_forecasts(spark, tmp_path):
    root = str(tmp_path / "f")
    first = batch(spark, [("s", "m", *JAN, 1.0), ("s", "m", *FEB, 2.0), ("s2", "m", *JAN, 3.0), ("s", "m2", *JAN, 4.0)])
    assert upsert.upsert_forecasts(first, root) == 4
    again = batch(spark, [("s", "m", *JAN, 9.0), ("s", "m", *JAN, 8.0)])
    assert upsert.upsert_forecasts(again, root) == 2
    got = {(r.location_id, r.model, r.month): r.temperature_2m for r in spark.read.parquet(root).collect()}
    assert got == {("s", "m", 1): 9.0, ("s", "m", 2): 2.0, ("s2", "m", 1): 3.0, ("s", "m2", 1): 4.0}
    before = sorted(map(str, spark.read.parquet(root).collect()))
    upsert.upsert_forecasts(again, root)
    assert sorted(map(str, spark.read.parquet(root).collect())) == before
    inventory = {(r.model, r.month): r.row_count for r in tables.partition_inventory(spark.read.parquet(root)).collect()}
    assert inventory == {("m", 1): 2, ("m", 2): 1, ("m2", 1): 1}


def test_load_forecasts_prunes_and_fails_on_unknown_model(spark, tmp_path):
    root = str(tmp_path / "f")
    upsert.upsert_forecasts(batch(spark, [("s", "m", *JAN, 1.0), ("s", "m", *FEB, float("nan"))]), root)
    df = tables.load_forecasts(spark, root, "m", "2024-02-02", "2024-02-02", ["temperature_2m"])
    assert [r.temperature_2m for r in df.collect()] == [None]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan and "GreaterThanOrEqual(forecast_target_time" in plan
    with pytest.raises(FileNotFoundError):
        tables.load_forecasts(spark, root, "nope", "2024-02-02", "2024-02-02", ["temperature_2m"])


def test_upsert_observations_unites_columns_and_uses_coordinates(spark, tmp_path):
    root = str(tmp_path / "o")
    rows = lambda v, wind=None: spark.createDataFrame([(1.0, 2.0, v), (1.0, 3.0, v)], "latitude double, longitude double, x double").withColumns({"observation_time": F.lit("2024-01-02 00:00:00").cast("timestamp"), "location_id": F.lit(None).cast("string"), **({"wind": F.lit(wind)} if wind else {})})
    upsert.upsert_observations(rows(1.0, 5.0), root)
    upsert.upsert_observations(rows(2.0).where("longitude = 2.0"), root)
    got = {r.longitude: (r.x, r.wind) for r in spark.read.parquet(root).collect()}
    assert got == {2.0: (2.0, None), 3.0: (1.0, 5.0)}


def test_keep_last_with_a_hot_key(spark):
    df = spark.range(20000).select((F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id"))).alias("k"), F.col("id").alias("seq"))
    out = upsert.keep_last(df, ["k"], ["seq"])
    assert out.where("k = 0").first().seq == 19999 and out.count() == df.select("k").distinct().count()


def write_docs(path, docs):
    path.mkdir(exist_ok=True)
    (path / "part.json").write_text("\n".join(json.dumps(d) for d in docs))
    return str(path)


def doc(**hourly):
    return {"latitude": 55.7, "longitude": 12.6, "elevation": 5.0, "hourly": hourly}


def test_json_documents(spark, tmp_path):
    ok = doc(time=["2024-01-01T00:00", "2024-01-01T01:00"], temperature_2m=[1.0, None])
    bad = [
        doc(time=["2024-01-01T00:00"], temperature_2m=[1.0, 2.0]),
        doc(time=["2024-01-01T00:00", "2024-01-01T00:00"], temperature_2m=[1.0, 2.0]),
        doc(time=["noon"], temperature_2m=[1.0]),
        doc(time=[], temperature_2m=[]),
        doc(temperature_2m=[1.0]),
    ]
    docs = raw_json.read_responses(spark, write_docs(tmp_path / "d", [ok, *bad]), ["temperature_2m", "precipitation"])
    good, rejected = raw_json.split_documents(docs)
    rows = raw_json.observations(good, ["temperature_2m", "precipitation", "wind"]).orderBy("observation_time").collect()
    assert [(str(r.observation_time), r.temperature_2m, r.precipitation, r.wind) for r in rows] == [("2024-01-01 00:00:00", 1.0, None, None), ("2024-01-01 01:00:00", None, None, None)]
    reasons = sorted(r.reject_reason for r in rejected.collect())
    assert reasons == ["array_length", "missing_time", "timestamps", "timestamps", "timestamps"]
    run = good.withColumns({"forecast_issue_time": F.lit("2023-12-31 18:00:00").cast("timestamp"), "model": F.lit("m")})
    assert sorted(r.lead_hours for r in raw_json.forecasts(run, ["temperature_2m"]).collect()) == [6, 7]


def test_previous_runs(spark, tmp_path):
    names = ["temperature_2m", "temperature_2m_previous_day1", "temperature_2m_previous_day_3", "precipitation_day1"]
    with_days = doc(time=["2024-01-05T00:00", "2024-01-05T01:00"], temperature_2m_previous_day1=[1.0, 2.0], temperature_2m_previous_day_3=[3.0, 4.0])
    plain = doc(time=["2024-01-05T00:00"], temperature_2m=[9.0])
    docs = raw_json.read_responses(spark, write_docs(tmp_path / "p", [with_days, plain]), names)
    rows = raw_json.previous_runs(docs, ["temperature_2m", "precipitation"], lead_days=(0, 1, 3, 5)).collect()
    got = sorted((r.lead_hours, str(r.forecast_issue_time), r.temperature_2m, r.precipitation) for r in rows)
    assert got == [
        (0, "2024-01-05 00:00:00", 9.0, None),
        (24, "2024-01-04 00:00:00", 1.0, None),
        (24, "2024-01-04 01:00:00", 2.0, None),
        (72, "2024-01-02 00:00:00", 3.0, None),
        (72, "2024-01-02 01:00:00", 4.0, None),
    ]


def test_metric_files_and_pivot(spark, tmp_path):
    df = spark.createDataFrame([("t", "mae", "a", 1.0, 5), ("t", "rmse", "a", 2.0, 5), ("t", "mae", "b", 3.0, 5)], "variable string, metric_name string, model string, metric_value double, sample_size int")
    datasets.write_metrics(df, str(tmp_path / "m"), {"run": "x"})
    datasets.write_metrics(df, str(tmp_path / "m"), {"run": "y"})
    runs = spark.read.json(str(tmp_path / "m_runs")).collect()
    assert sorted(r.run for r in runs) == ["x", "y"] and {r.row_count for r in runs} == {3} and runs[0].group_by == "model"
    read = tables.read_tables(spark, str(tmp_path / "m"))
    wide = {r.model: (r.mae, r.rmse) for r in tables.pivot_metrics(read, ["model"], ["metric_name"], ["mae", "rmse"]).collect()}
    assert wide == {"a": (1.0, 2.0), "b": (3.0, None)}
    assert tables.pivot_metrics(read, ["planet"], ["metric_name"], ["mae"]) is read
    assert tables.filter_metrics(read, models=["b"]).count() == 1
    with pytest.raises(FileNotFoundError):
        tables.read_tables(spark, [])


def test_stream_dedup_and_outer_join_release_late_rows(spark, tmp_path):
    cols = "forecast_target_time string, location_id string, x double"
    f = spark.createDataFrame([("2024-01-01 00:00:00", "s", 1.0), ("2024-01-02 00:00:00", "s", 2.0), ("2024-03-01 00:00:00", "s", 3.0)], cols).withColumn("forecast_target_time", F.to_timestamp("forecast_target_time"))
    o = spark.createDataFrame([("2024-01-02 00:00:00", "s", 5.0), ("2024-03-01 00:00:00", "s", 5.0)], cols.replace("forecast_target_time", "observation_time")).withColumn("observation_time", F.to_timestamp("observation_time"))
    f.write.parquet(str(tmp_path / "f"))
    o.write.parquet(str(tmp_path / "o"))
    fs, os = jobs.read_files(spark, str(tmp_path / "f"), f.schema), jobs.read_files(spark, str(tmp_path / "o"), o.schema)
    out = jobs.run_append(jobs.align_streams(fs, os, ["x"], "1 day"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {str(r.forecast_target_time)[:10]: r.x_error for r in out.collect()}
    assert got == {"2024-01-01": None, "2024-01-02": -3.0, "2024-03-01": -2.0}


def test_stream_update_equals_batch_after_two_drops(spark, tmp_path):
    schema = T.StructType([T.StructField("t", T.TimestampType()), T.StructField("e", T.DoubleType())])
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "ck"))
    day = lambda lo, hi: spark.range(lo, hi).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 1800).alias("t"), (F.col("id") % 7 - 3.0).alias("e"))
    run = lambda: jobs.run_update(jobs.rolling_metrics(jobs.read_files(spark, folder, schema), "e", "t", "6 hours"), out, check, ["window_start", "window_end"])
    day(0, 50).write.mode("append").parquet(folder)
    run()
    day(40, 120).write.mode("append").parquet(folder)
    streamed = {r.window_start: (round(r.mae, 9), r.sample_size) for r in run().collect()}
    both = day(0, 50).unionByName(day(40, 120))
    batch_result = {r.window_start: (round(r.mae, 9), r.sample_size) for r in jobs.rolling_metrics(both, "e", "t", "6 hours").collect()}
    assert streamed == batch_result
