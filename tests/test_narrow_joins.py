"""Shipments are joined as narrow rows, in either order, and interpolation stores nodes only."""

from __future__ import annotations

import datetime as dt

import pytest

from skillgauge.operators import interpolate
from skillgauge.plans import load_all, registry
from skillgauge.sources import driver_views


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    orders = [(1, day(0)), (2, day(5)), (2, day(6)), (3, None), (None, day(1))]
    parts = [(1, 5, 100.0), (2, 10, 200.0), (2, 11, 210.0), (None, 7, 1.0)]
    lines = [
        (o, p, s, i, float(1 + i % 7), 90.0 + i, None if i == 40 else "A", "F", day(i % 9))
        for i, (o, p, s) in enumerate((o, p, s) for o in (1, 2, 3, 4, None) for p in (1, 2, 9, None) for s in (0, 1, 4, 5, 17, 26, 999, None))
    ]
    spark.createDataFrame(orders, "o_orderkey bigint, o_orderdate timestamp").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(parts, "p_partkey bigint, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    schema = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(lines, schema).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_either_order_of_joins_gives_the_same_rows(spark, tables):
    one, other = (driver_views.shipments(spark, tables, first) for first in (False, True))
    assert one.columns == other.columns and one.count() > 50
    assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()
    places = {(r.location_id, r.latitude, r.longitude) for r in one.collect()}
    assert {("loc6", 55.5, 12.25), ("loc19", 55.75, 13.0), ("loc17", 55.25, 13.0), (None, None, None)} <= places


@pytest.mark.parametrize("name", ["bilinear_to_sites", "int04_idw_to_sites", "int04_nearest_to_sites"])
def test_interpolation_stores_no_forecast_rows(spark, tables, monkeypatch, name):
    names = []
    for module in (interpolate, registry):
        write = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, n, write=write: names.append(n) or write(df, n))
    load_all()[name].run(spark, tables).collect()
    assert sorted(names) == ["grid-nodes", "grid-points"]
    assert spark.conf.get("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold") != interpolate.HASHED_JOINS["spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"]
