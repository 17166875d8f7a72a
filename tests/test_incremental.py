"""Stored moments and sketches, the salted full outer join and documents without a schema."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillgauge.operators import align, blend, metrics, planning, quality, sketches
from skillgauge.session import scratch_path, settings
from skillgauge.sinks import bucketed, metricstore
from skillgauge.sources import raw_json, tables, variant_json
from skillgauge.streaming import jobs

VER = "forecast_issue_time timestamp, forecast_target_time timestamp, lead_hours int, model string, latitude double, longitude double, t_error double, w_error double"


def verification(spark, rows):
    df = spark.createDataFrame(rows, "m int, d int, model string, t_error double, w_error double")
    return df.selectExpr("make_timestamp(2024, m, 1, 0, 0, 0) AS forecast_issue_time", "make_timestamp(2024, m, d, 0, 0, 0) AS forecast_target_time", "(d - 1) * 24 AS lead_hours", "model", "1.0D AS latitude", "2.0D AS longitude", "t_error", "w_error")


def some_rows(seed, months):
    rng = np.random.default_rng(seed)
    return [(m, d, model, float(rng.normal(5e3, 1)), None if d % 3 == 0 else float(rng.normal())) for m in months for d in range(1, 20) for model in ("a", "b")]


def table(df):
    return {tuple(r[:-4]): r for r in df.select("grouping", "lead_hours", "season", "month", "model", "variable", "metric_name", "metric_value", "sample_size", "total_rows", "missing_count").collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][-3:] == b[k][-3:]
        x, y = a[k].metric_value, b[k].metric_value
        assert x == y if x is None or y is None else math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)


def test_appended_month_equals_the_full_build(spark):
    root, store = scratch_path(spark, "ver"), scratch_path(spark, "moments")
    first, late = some_rows(1, (1, 2, 3)), some_rows(2, (3, 4))
    for rows in (first, late):
        touched = metricstore.append_verification(verification(spark, rows), root)
        metricstore.refresh_moments(spark, root, store, touched, ["t", "w"])
    whole = verification(spark, [r for r in first if r[0] < 3] + late)
    sets = [[d] for d in ("lead_hours", "season", "month", "model")]
    same(table(metricstore.stored_metrics(spark, store, ["t", "w"])), table(metrics.metrics_by_grouping_sets(whole, sets, ["t", "w"])))


def test_refresh_opens_touched_partitions_only(spark):
    root = scratch_path(spark, "ver")
    metricstore.append_verification(verification(spark, some_rows(1, range(1, 7))), root)
    touched = verification(spark, [(4, 2, "b", 0.0, 0.0)]).selectExpr("model", "2024 AS year", "4 AS month")
    rows = metricstore.touched_rows(spark, root, touched)
    scan = rows._jdf.queryExecution().executedPlan().toString()
    filters = scan.split("PartitionFilters: [")[1].split("], PushedFilters")[0]
    assert "= b)" in filters and "(year#" in filters, filters
    assert {(r.model, r.year, r.month) for r in rows.select("model", "year", "month").collect()} == {("b", 2024, 4)}
    with pytest.raises(FileNotFoundError):
        metricstore.touched_rows(spark, scratch_path(spark, "none"), touched)


def test_grouping_sets_scan_the_table_once(spark):
    rows = verification(spark, some_rows(3, (1, 2)))
    path = scratch_path(spark, "rows")
    rows.write.parquet(path)
    out = metrics.metrics_by_grouping_sets(spark.read.parquet(path), [["model"], ["month"]], ["t"])
    assert not any(path in f for f in out.inputFiles())


@pytest.mark.parametrize("by", [[], ["model"], ["season", "lead_hours"]])
def test_sketches_stay_within_their_rank_error(spark, by):
    root, store = scratch_path(spark, "ver"), scratch_path(spark, "sketches")
    rows = some_rows(5, range(1, 9))
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        touched = metricstore.append_verification(verification(spark, part), root)
        metricstore.refresh_sketches(spark, root, store, touched, ["t", "w"])
    held = {}
    for r in verification(spark, rows).withColumn("season", F.when(F.month("forecast_target_time") < 3, "DJF").when(F.month("forecast_target_time") < 6, "MAM").otherwise("JJA")).collect():
        for v in ("t", "w"):
            if r[f"{v}_error"] is not None:
                held.setdefault((*[r[b] for b in by], v), []).append(r[f"{v}_error"])
    got = sketches.sketch_quantiles(metricstore.stored_sketches(spark, store, by), [0, 10, 50, 90, 100]).collect()
    assert {(*[r[b] for b in by], r.variable) for r in got} == held.keys() and len(got) == 5 * len(held)
    for r in got:
        values = np.sort(held[(*[r[b] for b in by], r.variable)])
        assert r.n == len(values)
        low, high = np.searchsorted(values, r.value, "left") / r.n, np.searchsorted(values, r.value, "right") / r.n
        assert low - sketches.RANK_ERROR <= r.percentile / 100 <= high + sketches.RANK_ERROR
        if r.percentile in (0, 100):
            assert r.value == values[0 if r.percentile == 0 else -1]


def test_hot_key_is_spread_and_rows_stay(spark):
    left = spark.createDataFrame([(1, i) for i in range(300)] + [(2, 0), (3, 1), (None, 2), (None, 3)], "k int, x int")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (4, "d"), (None, "e")], "k int, y string")
    plain = left.join(right, ["k"], "full_outer")
    for hot_rows in (10, 299, 10**6):
        got = align.salted_full_outer(left, right, ["k"], hot_rows)
        assert sorted(map(repr, got.select("k", "x", "y").collect())) == sorted(map(repr, plain.select("k", "x", "y").collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tasks = align.salted_full_outer(left, right, ["k"], 10).where("k = 1").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert tasks > 1


def test_full_outer_join_of_empty_tables(spark):
    left, right = (spark.createDataFrame([], f"k int, {c} int") for c in "xy")
    assert align.salted_full_outer(left, right, ["k"]).collect() == []
    some = spark.createDataFrame([(1, 5)], "k int, y int")
    assert [tuple(r) for r in align.salted_full_outer(left, some, ["k"]).select("k", "x", "y").collect()] == [(1, None, 5)]


DOCS = [
    {"latitude": 1, "longitude": 2.5, "elevation": 3, "site": "s1", "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "t": [1, 2.5]}},
    {"latitude": 2.0, "longitude": 2.0, "site": "s2", "hourly": {"time": ["2024-01-01T00:00"], "wind speed": [None], "t_previous_day2": [7], "t_day3": [8.5]}},
    {"latitude": 4.0, "longitude": 4.0, "hourly": {"time": []}},
]


def folder(spark, lines):
    path = scratch_path(spark, "docs")
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    return path


def test_documents_without_a_schema(spark):
    path = folder(spark, [json.dumps(d) for d in DOCS] + ["no json {", ""])
    docs, arrays = variant_json.read_responses(spark, path)
    assert arrays == ["t", "t_day3", "t_previous_day2", "wind speed"]
    given = raw_json.read_responses(spark, folder(spark, [json.dumps(d) for d in DOCS]), arrays, [raw_json.T.StructField("site", raw_json.T.StringType())])
    for name in ("t", "wind speed"):
        a, b = (raw_json.observations(d.where("hourly IS NOT NULL AND latitude IS NOT NULL"), [name]) for d in (docs, given))
        assert sorted(map(repr, a.select(sorted(a.columns)).collect())) == sorted(map(repr, b.select(sorted(b.columns)).collect()))
    assert variant_json.lead_days(arrays) == (["t", "wind speed"], [0, 2, 3])
    raw = variant_json.read_documents(spark, path)
    assert raw.where("doc IS NULL").select("raw").collect() == [("no json {",)]
    rows = sorted((r.variable, r.lead_day, r.value) for r in variant_json.long_hours(raw, "site").collect() if r.value is not None)
    assert rows == [("t", 0, 1.0), ("t", 0, 2.5), ("t", 2, 7.0), ("t", 3, 8.5)]
    leads = {(r.forecast_issue_time.day, r.lead_hours, r.t) for r in raw_json.previous_runs(docs.where("site = 's2'"), *variant_json.lead_days(arrays)).collect() if r.t is not None}
    assert leads == {(30, 48, 7.0), (29, 72, 8.5)}


def test_no_documents(spark):
    docs, arrays = variant_json.read_responses(spark, folder(spark, ["nothing"]))
    assert arrays == [] and docs.count() == 1
    assert variant_json.long_hours(variant_json.read_documents(spark, folder(spark, []))).collect() == []


def test_missing_leads_as_intervals(spark):
    rows = [("a", 1, h) for h in (0, 6, 12, 24)] + [("a", 2, 0), ("a", 2, None), ("a", 2, 7), ("a", 2, 600), ("b", 1, None)] + [("c", 1, h) for h in range(0, 31, 6)] + [("z", 1, 0)]
    df = spark.createDataFrame(rows, "model string, run int, lead_hours int")
    got = planning.missing_leads(df, ("model", "run"), 6, {"a": 30, "b": 12, "c": 30})
    assert sorted(map(tuple, got.collect())) == [("a", 1, 18, 18, 1), ("a", 1, 30, 30, 1), ("a", 2, 6, 30, 5), ("b", 1, 0, 12, 3)]
    # Every expected lead is either there or in one interval.
    there = {("a", 1): {0, 6, 12, 24}, ("a", 2): {0}, ("b", 1): set(), ("c", 1): set(range(0, 31, 6))}
    for r in got.collect():
        there[r.model, r.run] |= set(range(r.first_missing, r.last_missing + 1, 6))
    assert there == {("a", 1): set(range(0, 31, 6)), ("a", 2): set(range(0, 31, 6)), ("b", 1): {0, 6, 12}, ("c", 1): set(range(0, 31, 6))}
    assert planning.missing_leads(df.limit(0), ("model", "run"), 6, {"a": 30}).collect() == []
    assert planning.missing_leads(df, ("model", "run"), 6, {"a": 30}, 0).where("model = 'z'").collect() == []


def test_inventory_reads_footers(spark):
    path = scratch_path(spark, "parts")
    df = verification(spark, some_rows(1, (1, 2))).selectExpr("model", "2024 AS year", "month(forecast_target_time) AS month", "t_error")
    df.write.partitionBy("model", "year", "month").parquet(path)
    want = sorted(map(tuple, tables.partition_inventory(spark.read.parquet(path)).collect()))
    assert sorted(map(tuple, tables.footer_inventory(spark, path).collect())) == want
    assert sorted(map(tuple, tables.footer_inventory(spark, path, model="a").collect())) == [r for r in want if r[0] == "a"]
    with settings(spark, tables.FOOTERS):
        plan = tables.partition_inventory(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_checks_come_with_the_write(spark):
    rows = [(None, -3, 5.0), ("2024-01-01", 0, 60.0), ("2024-01-01", 900, None), ("2024-01-02", 1, 10.0)]
    df = spark.createDataFrame(rows, "o string, lead_hours int, forecast_t double").selectExpr("CAST(o AS timestamp) AS observation_time", "lead_hours", "forecast_t")
    path = scratch_path(spark, "written")
    got = quality.written_with_checks(df, lambda x: x.write.parquet(path), ["t"], {"t": (0.0, 50.0)})
    parts = [quality.check_missing_observations(df), quality.check_lead_times(df), quality.check_value_ranges(df, ["t"], {"t": (0.0, 50.0)})]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, quality.all_issues(parts).collect()))
    assert spark.read.parquet(path).count() == 4
    empty = quality.written_with_checks(df.limit(0), lambda x: x.write.mode("overwrite").parquet(path), ["t"], {"t": (0.0, 50.0)})
    assert {r.severity for r in empty.collect()} == {"info"}


def test_bucketed_tables_join_without_an_exchange(spark):
    f = spark.createDataFrame([("s1", 1, 1.0), ("s1", 2, 2.0), (None, 1, 3.0), ("s2", 1, 4.0)], "location_id string, h int, t double")
    f = f.selectExpr("timestamp_seconds(0) AS forecast_issue_time", "timestamp_seconds(h * 3600) AS forecast_target_time", "h AS lead_hours", "'m' AS model", "location_id", "1D AS latitude", "1D AS longitude", "CAST(NULL AS double) AS elevation", "t")
    o = f.where("t < 4").selectExpr("forecast_target_time AS observation_time", "location_id", "t - 1 AS t")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        left = bucketed.store_bucketed(f, "bucketed_f", "forecast_target_time", 4)
        right = bucketed.store_bucketed(o, "bucketed_o", "observation_time", 4)
        out = bucketed.build_from_bucketed(left, right, ["t"])
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        want = align.build_verification(f, o, ["t"])
        assert sorted(map(repr, out.collect())) == sorted(map(repr, want.select(out.columns).collect()))


def test_latest_rows_win_over_batches_and_restarts(spark):
    folder, path, checkpoint = (scratch_path(spark, n) for n in ("drops", "latest", "latest-checkpoint"))
    base = "timestamp_seconds(0) AS forecast_issue_time, timestamp_seconds(k * 3600) AS forecast_target_time, 'm' AS model, 's' AS location_id, v, n"
    drop = lambda rows: spark.createDataFrame(rows, "k int, v double, n int").selectExpr(*base.split(", ")).coalesce(1).write.mode("append").parquet(folder)
    key = ["forecast_issue_time", "forecast_target_time", "model", "location_id"]

    def run():
        stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
        out = jobs.run_update(jobs.latest_forecasts(stream, "n", "10 days"), path, checkpoint, key)
        return {r.forecast_target_time.hour: (r.v, r.n) for r in out.collect()}

    drop([(1, 1.0, 1), (2, 2.0, 1)])
    drop([(1, 5.0, 3), (1, 4.0, 2)])
    assert run() == {1: (5.0, 3), 2: (2.0, 1)}
    drop([(1, 9.0, 2), (2, 7.0, 4), (3, 1.0, 1)])
    assert run() == {1: (5.0, 3), 2: (7.0, 4), 3: (1.0, 1)}


def test_open_sessions_over_batches_and_restarts(spark):
    folder, path, checkpoint = (scratch_path(spark, n) for n in ("reports", "sessions", "sessions-checkpoint"))
    drop = lambda rows: spark.createDataFrame(rows, "k string, m int").selectExpr("k", "timestamp_seconds(m * 60) AS t").coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
        out = jobs.run_sessions(stream, ["k"], "t", path, checkpoint, "60 minutes", "0 seconds")
        minute = lambda t: int(t.timestamp() // 60)
        return sorted((r.k, minute(r.session_start), minute(r.session_end), r.reports, r.is_open) for r in out.selectExpr("k", "session_start", "session_end", "reports", "is_open").collect())

    drop([("a", 0), ("a", 30), ("b", 10)])
    assert run() == [("a", 0, 90, 2, True), ("b", 10, 70, 1, True)]
    drop([("a", 80), ("a", 20)])
    assert run() == [("a", 0, 140, 4, True), ("b", 10, 70, 1, False)]
    # Too late: its spell is closed and gone.
    drop([("b", 5), ("c", 500)])
    assert run() == [("a", 0, 140, 4, False), ("b", 10, 70, 1, False), ("c", 500, 560, 1, True)]


@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.37, 0.7, 1.0])
def test_positional_split_takes_the_first_rows(spark, fraction):
    rng = np.random.default_rng(8)
    keys = sorted({(int(i), int(t), f"loc{s}", int(h)) for i, t, s, h in rng.integers(0, 4, (90, 4))})
    df = spark.createDataFrame([keys[k] for k in rng.permutation(len(keys))], "i int, t int, location_id string, lead_hours int")
    targets = df.selectExpr("timestamp_seconds(i * 3600) AS forecast_issue_time", "timestamp_seconds(t * 3600) AS forecast_target_time", "location_id", "lead_hours", "i", "t")
    got = blend.with_split(targets, fraction, "positional")
    train = sorted((r.i, r.t, r.location_id, r.lead_hours) for r in got.collect() if r.is_train)
    assert train == keys[: math.floor(len(keys) * fraction)]
    assert blend.with_split(targets.limit(0), 0.5, "positional").collect() == []
