"""Site errors of rows that hold forecast and truth: the same as from two tables, read once, and only sums are stored."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from test_read_once import Counted

from skillgauge.operators import interpolate, sites
from skillgauge.plans import load_all, q_spatial, registry

ROW = "model string, forecast_target_time timestamp, latitude double, longitude double, x double, x_obs double"


def paired(spark):
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    rows = [
        (m, day(t), 55.0 + 0.25 * i, 12.0 + 0.25 * j, float((7 * i + 3 * j + t + c) % 11), float((i + 2 * j + t * c) % 5))
        for m in ("a", "b", None) for t in range(3) for i in range(3) for j in range(3) for c in range(4)
    ]
    rows += [("a", day(1), 55.0, 12.0, None, None), ("a", day(1), None, 12.0, 1.0, 2.0), ("b", None, 55.0, 12.25, 0.5, 1.0), ("c", day(7), 55.25, 12.0, 3.0, None)]
    df = spark.createDataFrame(rows, ROW)
    return df.withColumns({
        "forecast_issue_time": F.col("forecast_target_time"), "lead_hours": F.lit(0), "observation_time": F.col("forecast_target_time"),
        "site_lat": F.col("latitude") + 0.1, "site_lon": F.col("longitude") + 0.07,
    })


def test_same_as_from_two_tables(spark):
    rows = paired(spark)
    counted = Counted(rows)
    one = sites.paired_site_error_table(counted.df, ["x"])
    daily = rows.groupBy("observation_time", "site_lat", "site_lon").agg(F.avg("x_obs").alias("x"))
    two = sites.site_error_table(rows.drop("x_obs"), daily.withColumnsRenamed({"site_lat": "latitude", "site_lon": "longitude"}), ["x"])
    assert one.columns == two.columns and one.count() > 40 and counted.reads() == 1
    short = lambda df: df.withColumns({c: F.round(c, 9) for c in ("site_distance_km", "x_native_error", "x_interp_error")})
    assert short(one).exceptAll(short(two)).isEmpty() and short(two).exceptAll(short(one)).isEmpty()


def test_the_queries_store_no_shipment(spark, monkeypatch, tmp_path):
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write([(1, day(0))], "o_orderkey bigint, o_orderdate timestamp", "orders")
    write([(1, 5, 100.0)], "p_partkey bigint, p_size int, p_retailprice double", "part")
    schema = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    write([(1, 1, s, i, 1.0 + i, 90.0 + i, "A", "F", day(1)) for s in range(20) for i in range(30)], schema, "lineitem")
    held = {}
    for module in (interpolate, sites, registry):
        keep = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, n, keep=keep: held.setdefault(n, keep(df, n)))
    load_all()["agg29_month_lead_grid"].run(spark, str(tmp_path)).collect()
    assert q_spatial and max(df.count() for df in held.values()) < 100
