from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from skillgauge.operators.nearest import k_nearest, nearest_point


def haversine(a, b, radius=6371.0):
    (la1, lo1), (la2, lo2) = a, b
    x = math.sin(math.radians(la2 - la1) / 2) ** 2
    x += math.cos(math.radians(la1)) * math.cos(math.radians(la2)) * math.sin(math.radians(lo2 - lo1) / 2) ** 2
    return 2 * radius * math.asin(min(1.0, math.sqrt(x)))


def frame(spark, rows):
    return spark.createDataFrame(rows, "latitude double, longitude double")


def brute(target, points, k):
    ranked = sorted((haversine(target, p), *p) for p in set(points))
    return [d for d, *_ in ranked[:k]]


SCENES = {
    "globe": lambda r: ([(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(400)], [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(60)]),
    # A regional grid and stations on the other side of the world.
    "regional": lambda r: ([(50 + i * 0.5, 5 + j * 0.5) for i in range(12) for j in range(12)], [(r.uniform(-60, 0), r.uniform(100, 180)) for _ in range(30)]),
    "poles": lambda r: ([(90.0, 0.0), (-90.0, 10.0)] + [(r.choice((-1, 1)) * r.uniform(80, 90), r.uniform(-180, 180)) for _ in range(100)], [(r.choice((-1, 1)) * r.uniform(85, 90), r.uniform(-180, 180)) for _ in range(40)] + [(90.0, 180.0)]),
    "date line": lambda r: ([(r.uniform(-20, 20), r.choice((-1, 1)) * r.uniform(170, 180)) for _ in range(150)], [(r.uniform(-20, 20), r.choice((-1, 1)) * r.uniform(178, 180)) for _ in range(40)] + [(0.0, 180.0), (0.0, -180.0)]),
}


@pytest.mark.parametrize("scene", SCENES)
@pytest.mark.parametrize("k", [1, 4])
def test_equals_brute_force(spark, scene, k):
    points, targets = SCENES[scene](random.Random(7))
    found = k_nearest(frame(spark, targets), frame(spark, points), k).collect()
    by_target = {}
    for row in sorted(found, key=lambda r: r["rank"]):
        by_target.setdefault((row["latitude"], row["longitude"]), []).append(row["distance_km"])
    assert set(by_target) == set(targets)
    for target, distances in by_target.items():
        assert distances == pytest.approx(brute(target, points, k), abs=1e-6)


def test_stays_inside_groups_and_skips_empty_ones(spark):
    points = spark.createDataFrame([("a", 0.0, 0.0), ("b", 10.0, 10.0)], "g string, latitude double, longitude double")
    targets = spark.createDataFrame([("a", 10.0, 10.0), ("b", 9.0, 9.0), ("c", 1.0, 1.0)], "g string, latitude double, longitude double")
    rows = {r["g"]: (r["point_latitude"], r["point_longitude"]) for r in nearest_point(targets, points, ["g"]).collect()}
    assert rows == {"a": (0.0, 0.0), "b": (10.0, 10.0)}


def test_fewer_points_than_k(spark):
    out = k_nearest(frame(spark, [(0.0, 0.0)]), frame(spark, [(1.0, 1.0), (2.0, 2.0)]), 4)
    assert [r["rank"] for r in out.orderBy("rank").collect()] == [1, 2]


def test_no_cross_product_in_the_plan(spark):
    points = spark.range(500).select((F.rand(1) * 180 - 90).alias("latitude"), (F.rand(2) * 360 - 180).alias("longitude"))
    plan = nearest_point(points, points)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
