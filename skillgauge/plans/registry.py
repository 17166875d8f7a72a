"""Named queries over the driver tables, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure, materialize
from ..sources import driver_views
from ..sources.driver_views import ENSEMBLE_CTE, SHIPMENTS_CTE, VERIFICATION_CTE

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, *ids: str, sql: str | None = None):
    """Register a query; the last bits of doubles are cut on both sides, because sums differ in order."""

    def register(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")

        @functools.wraps(run)
        def rounded_run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(run(configure(spark), sf_dir))

        REGISTRY[name] = Query(name, ids, rounded_run, sql)
        return run

    return register


def rounded(df: DataFrame) -> DataFrame:
    """Every double column at 31 significant bits (over nine digits), and below 1 at multiples of 2**-30.

    Sums differ between engines in their last bits. Both steps are sums and
    products that every engine rounds alike, and no decimal or dyadic result lies
    half way between two steps.
    """
    new = {f.name: _steps(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.withColumns(new) if new else df


# Factor and summand whose rounding cuts a double to 31 bits, and to multiples of 2**-30.
FACTOR, SUMMAND = 4194305.0, 6291456.0


def _steps(x):
    long = x * F.lit(FACTOR)
    significant = long - (long - x)
    small = (x + F.lit(SUMMAND)) - F.lit(SUMMAND)
    return F.when(F.abs(x) < 1, small + F.lit(0.0)).when(F.abs(x) < 1e300, significant).otherwise(x)


def _rounding(body: str, doubles: str) -> str:
    if not doubles:
        return body
    f, s = (f"CAST({v} AS DOUBLE)" for v in (FACTOR, SUMMAND))
    replaced = ", ".join(
        f"CASE WHEN abs({c}) < 1 THEN ((CAST({c} AS DOUBLE) + {s}) - {s}) + 0.0 WHEN abs({c}) < 1e300 "
        f"THEN {c} * {f} - ({c} * {f} - {c}) ELSE {c} END AS {c}"
        for c in doubles.split()
    )
    return f"SELECT * REPLACE ({replaced}) FROM ({body}) AS t"


def on_verification(body: str, doubles: str = "", ctes: str = "") -> str:
    return _rounding(f"WITH {VERIFICATION_CTE}{', ' + ctes if ctes else ''} {body}", doubles)


def on_shipments(body: str, doubles: str = "", ctes: str = "") -> str:
    return _rounding(f"WITH {SHIPMENTS_CTE}{', ' + ctes if ctes else ''} {body}", doubles)


def on_ensemble(body: str, doubles: str = "", ctes: str = "") -> str:
    return _rounding(f"WITH {ENSEMBLE_CTE}{', ' + ctes if ctes else ''} {body}", doubles)


def on_both(body: str, doubles: str = "", ctes: str = "") -> str:
    return _rounding(f"WITH {VERIFICATION_CTE}, {ENSEMBLE_CTE}{', ' + ctes if ctes else ''} {body}", doubles)


def plain(body: str, doubles: str = "") -> str:
    return _rounding(body, doubles)


verification = driver_views.verification
shipments = driver_views.shipments
ensemble_forecasts = driver_views.ensemble_forecasts
ensemble_observations = driver_views.ensemble_observations

def stored(name: str, spark: SparkSession, sf_dir: str, build: Run) -> DataFrame:
    """A table that a query reads more than once (a skill store, say), written for this run and read back."""
    return materialize(build(spark, sf_dir), name)


VARIABLES = ("qty", "price")
# Events of the driver-table views.
CATALOG = {"high": ("qty", 40.0, "ge"), "low": ("qty", 5.0, "le"), "cheap": ("price", 1000.0, "lt")}
SQL_OPERATORS = {"ge": ">=", "le": "<=", "lt": "<", "gt": ">", "eq": "=", "ne": "<>"}


def metric_sql(dims: str, source: str = "verification", variables=VARIABLES, where: str = "TRUE") -> str:
    """Long metrics by `dims` (comma separated), as a subquery body."""
    keys = f"{dims}, " if dims else ""
    group = f"GROUP BY {dims}" if dims else ""
    parts = []
    for v in variables:
        e = f"{v}_error"
        for name, expr in (
            ("mae", f"avg(abs({e}))"),
            ("rmse", f"sqrt(avg({e} * {e}))"),
            ("bias", f"avg({e})"),
            ("std", f"stddev_samp({e})"),
        ):
            parts.append(
                f"SELECT {keys}'{v}' AS variable, '{name}' AS metric_name, {expr} AS metric_value, "
                f"count({e}) AS sample_size, count(*) AS total_rows, count(*) - count({e}) AS missing_count "
                f"FROM {source} WHERE {where} {group}"
            )
    return " UNION ALL ".join(parts)


def contingency_sql(dims: str, names=tuple(CATALOG), source: str = "verification") -> str:
    keys = f"{dims}, " if dims else ""
    group = f"GROUP BY {dims}" if dims else ""
    parts = []
    for name in names:
        v, t, op = CATALOG[name]
        f, o = f"forecast_{v} {SQL_OPERATORS[op]} {t}", f"observed_{v} {SQL_OPERATORS[op]} {t}"
        pair = f"forecast_{v} IS NOT NULL AND observed_{v} IS NOT NULL"
        parts.append(
            f"SELECT {keys}'{name}' AS event_name, '{v}' AS variable, CAST({t} AS DOUBLE) AS threshold, '{op}' AS operator, "
            f"count(*) FILTER (WHERE {pair} AND {f} AND {o}) AS hits, "
            f"count(*) FILTER (WHERE {pair} AND NOT ({f}) AND {o}) AS misses, "
            f"count(*) FILTER (WHERE {pair} AND {f} AND NOT ({o})) AS false_alarms, "
            f"count(*) FILTER (WHERE {pair} AND NOT ({f}) AND NOT ({o})) AS correct_negatives, "
            f"count(*) FILTER (WHERE NOT ({pair})) AS excluded_nan, "
            f"count(*) FILTER (WHERE {pair}) AS sample_size, count(*) AS total_rows "
            f"FROM {source} {group}"
        )
    return " UNION ALL ".join(parts)
