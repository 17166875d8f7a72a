from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillgauge.operators import distributions, extremes
from skillgauge.operators.quantiles import approximate_quantiles, exact_quantiles, nearest_rank_time

PERCENTILES = [0, 1, 5, 25, 50, 75, 90, 99, 100]


@pytest.fixture(scope="module")
def data():
    r = random.Random(11)
    groups = {
        "hot": [r.gauss(0, 3) for _ in range(3000)] + [0.0] * 1500,
        "outlier": [1e12, -1e12] + [r.uniform(100, 101) for _ in range(500)],
        "one": [4.25],
        "two": [1.0, 2.0],
        "tiny": [r.uniform(-1e-12, 1e-12) for _ in range(50)],
        "constant": [7.0] * 40,
    }
    return groups


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("hot", None), (None, 1.0), ("empty", None)]
    return spark.createDataFrame(rows, "g string, x double").repartition(7).cache()


def test_equals_numpy(frame, data):
    got = {(r.g, r.percentile): r.value for r in exact_quantiles(frame, "x", PERCENTILES, ["g"]).collect()}
    assert {g for g, _ in got} == set(data)
    for g, values in data.items():
        for p in PERCENTILES:
            assert got[(g, p)] == pytest.approx(np.percentile(values, p), rel=1e-12, abs=1e-15), (g, p)


def test_without_groups(frame, data):
    everything = [v for vs in data.values() for v in vs] + [1.0]
    got = {r.percentile: r.value for r in exact_quantiles(frame, "x", PERCENTILES).collect()}
    for p in PERCENTILES:
        assert got[p] == pytest.approx(np.percentile(everything, p), rel=1e-12)


def test_sketch_is_close(frame, data):
    got = {r.percentile: r.value for r in approximate_quantiles(frame.where("g = 'hot'"), "x", [5, 50, 95]).collect()}
    for p, v in got.items():
        assert v == pytest.approx(np.percentile(data["hot"], p), abs=0.02)


@pytest.mark.parametrize("fraction", [0.0, 0.3, 0.5, 0.75, 1.0])
def test_nearest_rank_over_months(spark, fraction):
    r = random.Random(5)
    hours = sorted(r.randrange(0, 24 * 400) for _ in range(999))
    df = spark.createDataFrame([(h,) for h in hours], "h int").withColumn("t", F.timestamp_seconds(F.col("h") * 3600))
    cutoff = nearest_rank_time(df, "t", fraction).select(F.unix_seconds("cutoff")).first()[0] // 3600
    assert cutoff == hours[round((len(hours) - 1) * fraction)]


def test_box_and_histogram(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(24, v) for v in values], "lead_hours int, x_error double")
    box = distributions.box_statistics(df, "x").first()
    assert (box.q1, box.median, box.q3, box.whisker_low, box.whisker_high, box.outliers, box.n) == (2.0, 3.0, 4.0, 1.0, 4.0, 1, 5)
    counts = distributions.histogram(df, "x_error", 9)
    assert {r.bin: r["count"] for r in counts.collect()} == {1: 4, 9: 1}
    edged = distributions.histogram(spark.createDataFrame([(-12.0,), (12.0,), (12.5,), (0.0,)], "x double"), "x", 48, -12, 12)
    assert {r.bin: r["count"] for r in edged.collect()} == {1: 1, 25: 1, 48: 1}


def test_extremes(spark):
    rows = [(-9.0, 6, "a"), (3.0, 6, "a"), (8.0, 12, "b"), (None, 12, "b"), (7.0, None, "b")]
    df = spark.createDataFrame(rows, "x_error double, lead_hours int, model string")
    assert [r.abs_error for r in extremes.top_errors(df, "x", 2).collect()] == [9.0, 8.0]
    assert extremes.extreme_misses(df, "x", 8.0).count() == 2
    assert extremes.extreme_misses(df, "x", 8.0, "under").count() == 1
    assert extremes.extreme_misses(df, "x", 8.0, "over", model="a").count() == 0
    with pytest.raises(ValueError):
        extremes.extreme_misses(df, "x", 8.0, "sideways")
    freq = extremes.extreme_frequency(df, "x", 8.0).first()
    assert (freq.total, freq.extreme_count, freq.frequency, freq.mean_error_when_extreme) == (4, 2, 0.5, 8.5)
