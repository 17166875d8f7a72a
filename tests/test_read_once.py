"""Operators read their input once, however many parts of the result derive from it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_interpolate import cell, site

from skillgauge.operators import interpolate, quality, sites
from skillgauge.sinks import datasets


class Counted:
    """A table of which every row that is read adds one."""

    def __init__(self, df):
        seen = self.seen = df.sparkSession.sparkContext.accumulator(0)
        passed = F.udf(lambda _: seen.add(1) or True, "boolean").asNondeterministic()
        self.rows, self.df = df.count(), df.where(passed(F.lit(1)))

    def reads(self):
        return self.seen.value / self.rows


@pytest.mark.parametrize("method", interpolate.METHODS)
def test_interpolation(spark, method):
    grid = Counted(cell(spark, times=(0, 24)))
    out = interpolate.interpolate_to_sites(grid.df, site(spark, 55.6, 12.7), ["x"], method, keep_native=False)
    assert out.count() == 2 and grid.reads() == 1


def test_interpolation_takes_the_least_of_repeated_nodes(spark):
    grid = cell(spark).unionByName(cell(spark, (11.0, 5.0, 31.0, 41.0)))
    out = interpolate.interpolate_to_sites(grid, site(spark, 55.625, 12.625), ["x"])
    assert [r.x for r in out.collect()] == pytest.approx([21.25])


def test_site_errors(spark):
    grid = Counted(cell(spark, times=(0, 24)))
    seen = cell(spark, times=(0, 24)).select(
        (F.col("latitude") + 0.05).alias("latitude"), (F.col("longitude") + 0.05).alias("longitude"), F.col("forecast_target_time").alias("observation_time"), "x"
    )
    seen = Counted(seen)
    assert sites.site_error_table(grid.df, seen.df, ["x"]).count() == 8
    assert grid.reads() == 1 and seen.reads() == 1


def test_checks_and_their_report(spark, tmp_path):
    rows = cell(spark, times=(0, 24, 48)).withColumns(
        {"observation_time": F.col("forecast_target_time"), "forecast_temperature_2m": F.col("x") * 5, "observed_temperature_2m": F.col("x")}
    )
    rows = rows.unionByName(rows.where("x = 40").withColumn("observation_time", F.lit(None).cast("timestamp")))
    table = Counted(rows)
    datasets.save_validation_report(quality.validate_verification(table.df, ["temperature_2m"]), str(tmp_path))
    assert table.reads() == 1
    found = {r.check: r["count"] for r in spark.read.json(f"{tmp_path}/issues").collect()}
    # A copy without an observation shares its provenance, as do all nodes of a location.
    assert found["missing_observations"] == 3 and found["provenance_uniqueness"] == 12 and found["duplicate_observations"] == 0
    assert found["value_ranges"] == rows.where("forecast_temperature_2m > 60").count()
    total = sum(r.issues for r in spark.read.json(f"{tmp_path}/totals").collect())
    assert total == len(found) == 6
