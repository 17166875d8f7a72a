"""Queries give all of their operator's result, not the part that is easy to say in SQL."""

from __future__ import annotations

import os

import duckdb
import pytest

from codegen import generated_code
from skillgauge.plans import load_all

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


@pytest.fixture(scope="module", autouse=True)
def compiled(spark):
    generated_code(spark, True)
    yield
    generated_code(spark, False)


def both(spark, name):
    """Rows of a query and of its SQL, columns by name."""
    q, con = load_all()[name], duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{table}'")
    theirs = con.execute(q.sql)
    names = [d[0] for d in theirs.description]
    mine = q.run(spark, SF)
    assert sorted(mine.columns) == sorted(names)
    key = lambda row: tuple(map(repr, row))
    return names, sorted(map(tuple, mine.select(*names).collect()), key=key), sorted(theirs.fetchall(), key=key)


def test_joined_streams_keep_unmatched_forecasts(spark):
    names, mine, theirs = both(spark, "str04_outer_aligned_streams")
    assert mine == theirs
    observed, place = names.index("observed_load"), names.index("location_id")
    assert {r[place] for r in mine if r[observed] is None} == {"loc3"}


@pytest.mark.parametrize("name", [
        "snk08_validation_report",
        "snk08_validation_totals",
        "snk09_build_metrics",
        "snk09_incremental_metrics",
        "snk11_dataset_statistics",
        "agg12_evaluations_by_variable",
        "agg21_stored_sketches",
        "agg33_gain_overview",
        "dq02_validate_all",
        "dq03_duplicate_observation_rows",
        "dq12_validate_skill_scores",
        "meta06_weights_with_recent_skill",
        "meta09_contributors",
        "meta12_member_values",
        "meta13_factors_of_blend",
        "meta14_evaluate_blend",
        "src06_variant_hours",
        "str02_latest_forecasts",
    ],
)
def test_whole_outputs_equal_sql(spark, name):
    _, mine, theirs = both(spark, name)
    assert mine and mine == theirs
