"""Queries: data-quality checks, gaps, locations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import locations, quality, sequence
from ..operators.events import contingency, skill_scores
from ..session import scratch_path
from .q_events import SCORE_SQL, _double
from .q_metrics import JOINED, by_model_lead_stored, joined
from .registry import (
    CATALOG,
    VARIABLES,
    contingency_sql,
    ensemble_observations,
    metric_sql,
    on_ensemble,
    on_shipments,
    on_verification,
    query,
    shipments,
    verification,
)

RANGES = {"qty": (2.0, 49.0), "price": (0.0, 50000.0)}
HAVERSINE = (
    "2 * {r} * asin(sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)))"
)


def haversine_sql(lat1: str, lat2: str, lon1: str, lon2: str, radius: float) -> str:
    return HAVERSINE.format(a=lat1, b=lat2, c=lon1, d=lon2, r=radius)


@query(
    "dq01_provenance_violations",
    "DQ-01",
    sql=on_shipments(
        "SELECT CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicate_rows, CAST(sum(off) AS BIGINT) AS inconsistent_leads, "
        "CAST(sum(neg) AS BIGINT) AS negative_leads FROM (SELECT count(*) AS n, count(*) FILTER (WHERE lead_hours < 0) AS neg, "
        "count(*) FILTER (WHERE abs(lead_hours - datediff('hour', forecast_issue_time, forecast_target_time)) > 1) AS off FROM shipments "
        "GROUP BY forecast_issue_time, forecast_target_time, model, location_id) AS g"
    ),
)
def _(spark, sf):
    return quality.provenance_violations(shipments(spark, sf))


def _issue_sql(check: str, severity: str, bad: str, good: str, body: str, n: str = "n") -> str:
    """One issue of a one-row `body`: its severity, message and count."""
    return (
        f"SELECT '{check}' AS \"check\", {severity} AS severity, CASE WHEN {n} > 0 THEN {bad} ELSE '{good}' END AS message, CAST({n} AS BIGINT) AS count FROM ({body}) AS h"
    )


def _if_any(level: str, n: str = "n") -> str:
    return f"CASE WHEN {n} > 0 THEN '{level}' ELSE 'info' END"


def _provenance_sql(source: str, key: str) -> str:
    body = f"SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n FROM (SELECT count(*) AS c FROM {source} GROUP BY {key}) AS g"
    return _issue_sql("provenance_uniqueness", _if_any("error"), "concat(n, ' rows share the provenance key of an earlier row')", "every forecast row has its own provenance key", body)


def _missing_sql(source: str) -> str:
    severity = "CASE WHEN n * 100.0 / t > 50 THEN 'error' WHEN n * 100.0 / t > 10 THEN 'warning' ELSE 'info' END"
    bad = "printf('%d of %d forecasts (%.1f%%) have no observation', n, t, n * 100.0::DOUBLE / t)"
    return _issue_sql("missing_observations", severity, bad, "every forecast has an observation", f"SELECT count(*) FILTER (WHERE observation_time IS NULL) AS n, count(*) AS t FROM {source}")


def _leads_sql(source: str) -> str:
    body = f"SELECT count(*) FILTER (WHERE lead_hours < 0) AS low, count(*) FILTER (WHERE lead_hours > 720) AS high FROM {source}"
    bad = "printf('%d lead_hours below 0, %d above 720', low, high)"
    return _issue_sql("lead_times", _if_any("error", "low + high"), bad, "all lead_hours are in range", body, "low + high")


def _gaps_sql(source: str) -> str:
    body = (
        "SELECT count(*) AS n, count(DISTINCT (latitude, longitude)) AS keys FROM (SELECT latitude, longitude, "
        "datediff('minute', lag(observation_time) OVER (PARTITION BY latitude, longitude ORDER BY observation_time), observation_time) AS gap "
        f"FROM (SELECT DISTINCT latitude, longitude, observation_time FROM {source} WHERE observation_time IS NOT NULL) AS p) AS q WHERE gap > 90"
    )
    return _issue_sql("timestamp_gaps", _if_any("warning"), "printf('%d gaps over 1.5 h at %d location(s)', n, keys)", "no observation gaps", body)


def _ranges_sql(source: str) -> str:
    columns = [(f"{side}_{v}", lo, hi) for v, (lo, hi) in RANGES.items() for side in ("forecast", "observed")]
    body = "SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS k{i}" for i, (c, lo, hi) in enumerate(columns)) + f" FROM {source}"
    n = " + ".join(f"k{i}" for i in range(len(columns)))
    named = ", ".join(f"CASE WHEN k{i} > 0 THEN concat(k{i}, ' in {c} outside [{lo}, {hi}]') END" for i, (c, lo, hi) in enumerate(columns))
    return _issue_sql("value_ranges", _if_any("error", n), f"concat('implausible values: ', concat_ws('; ', {named}))", "all values are physically plausible", body, n)


def _copies_sql(source: str, columns: str = "*") -> str:
    return (
        "SELECT 'duplicate_observations' AS \"check\", CASE WHEN n > 0 THEN 'error' WHEN r > 100 THEN 'warning' ELSE 'info' END AS severity, "
        "CASE WHEN n > 0 THEN concat(n, ' matched rows are exact copies') WHEN r > 100 THEN printf('%.0f forecasts per distinct observation time', r) "
        "ELSE 'no duplicate observations' END AS message, CAST(n AS BIGINT) AS count FROM (SELECT CAST(coalesce(sum(c) FILTER (WHERE c > 1), 0) AS BIGINT) AS n, "
        f"(SELECT count(*) FROM {source}) / CAST(count(DISTINCT observation_time) AS DOUBLE) AS r "
        f"FROM (SELECT {columns}, count(*) AS c FROM {source} WHERE observation_time IS NOT NULL GROUP BY ALL) AS g) AS h"
    )


PROVENANCE = "forecast_issue_time, forecast_target_time, model"


def validation_sql(source: str) -> str:
    """All six checks of the verification table."""
    parts = (_provenance_sql(source, f"{PROVENANCE}, location_id"), _missing_sql(source), _leads_sql(source), _gaps_sql(source), _ranges_sql(source), _copies_sql(source))
    return " UNION ALL ".join(f"SELECT * FROM ({p}) AS i{k}" for k, p in enumerate(parts))


@query("dq02_provenance_duplicates_without_location", "DQ-02", "WIN-05", sql=on_verification(_provenance_sql("verification", PROVENANCE)))
def _(spark, sf):
    return quality.check_provenance(verification(spark, sf), PROVENANCE.split(", "))


@query("dq02_validate_all", "DQ-02", "DQ-03", "DQ-04", "DQ-06", "DQ-07", "WIN-01", sql=on_verification(validation_sql("verification")))
def _(spark, sf):
    return quality.validate_verification(verification(spark, sf), VARIABLES, RANGES)


_NARROW = "forecast_target_time, model, location_id, observation_time, forecast_qty"


@query("dq03_duplicate_observations", "DQ-03", sql=on_verification(_copies_sql("verification", _NARROW)))
def _(spark, sf):
    return quality.check_duplicate_observations(verification(spark, sf).select(*_NARROW.split(", ")))


@query(
    "dq03_duplicate_observation_rows",
    "DQ-03",
    sql=on_verification(_copies_sql("twice"), ctes="twice AS (SELECT * FROM verification UNION ALL SELECT * FROM verification WHERE lead_hours < 240)"),
)
def _(spark, sf):
    # All columns are compared; rows of short leads are there twice.
    rows = verification(spark, sf)
    return quality.check_duplicate_observations(rows.unionByName(rows.where("lead_hours < 240")))


@query("dq04_missing_observations", "DQ-04", sql=on_ensemble(_missing_sql("ver"), "", JOINED))
def _(spark, sf):
    return quality.check_missing_observations(joined(spark, sf))


@query("dq06_lead_times", "DQ-06", sql=on_shipments(_leads_sql("shipments")))
def _(spark, sf):
    return quality.check_lead_times(shipments(spark, sf))


@query(
    "dq07_value_ranges",
    "DQ-07",
    sql=on_verification(
        " UNION ALL ".join(
            f"SELECT '{s}_{v}' AS column_name, CAST({lo} AS DOUBLE) AS low, CAST({hi} AS DOUBLE) AS high, "
            f"count(*) FILTER (WHERE {s}_{v} < {lo} OR {s}_{v} > {hi}) AS violations FROM verification"
            for v, (lo, hi) in RANGES.items()
            for s in ("forecast", "observed")
        )
    ),
)
def _(spark, sf):
    return quality.range_violations(verification(spark, sf), VARIABLES, RANGES)


def _issues_sql(*items: tuple[str, str, str, str, str]) -> str:
    """Issues from (check, level, bad message, good message, one-row body with n)."""
    return " UNION ALL ".join(_issue_sql(c, _if_any(level), bad, good, body) for c, level, bad, good, body in items)


@query(
    "dq08_validate_metrics",
    "DQ-08",
    "DQ-09",
    "WIN-05",
    sql=on_verification(
        _issues_sql(
            ("empty_output", "warning", "'the metric table is empty'", "the metric table has rows", "SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS n FROM m"),
            ("negative_sample_size", "error", "concat(n, ' rows have a negative sample_size')", "no negative sample sizes", "SELECT count(*) FILTER (WHERE sample_size < 0) AS n FROM m"),
            ("nan_heavy_group", "warning", "concat(n, ' groups miss more than 10% of their errors')", "no sparse groups", "SELECT count(*) FILTER (WHERE sample_size < 0.9 * total_rows) AS n FROM m"),
            (
                "duplicate_key",
                "error",
                "concat(n, ' rows repeat an aggregation key')",
                "no repeated keys",
                "SELECT coalesce(sum(c - 1), 0) AS n FROM (SELECT count(*) AS c FROM m GROUP BY model, lead_hours, variable, metric_name) AS g",
            ),
            (
                "absurd_rmse",
                "error",
                "concat(n, ' RMSE values are absurd')",
                "no absurd RMSE values",
                "SELECT count(*) FILTER (WHERE mae <> 0 AND rmse > 100 * mae) + count(*) FILTER (WHERE rmse > 10000) AS n FROM (SELECT "
                "max(metric_value) FILTER (WHERE metric_name = 'rmse') AS rmse, max(metric_value) FILTER (WHERE metric_name = 'mae') AS mae "
                "FROM m GROUP BY model, lead_hours, variable) AS g",
            ),
        ),
        "",
        f"m AS ({metric_sql('model, lead_hours')})",
    ),
)
def _(spark, sf):
    return quality.validate_metrics(by_model_lead_stored(spark, sf))


@query(
    "dq10_validate_contingency",
    "DQ-10",
    "DQ-11",
    sql=on_verification(
        _issues_sql(
            (
                "negative_count",
                "error",
                "concat(n, ' rows have a negative count')",
                "no negative counts",
                "SELECT count(*) FILTER (WHERE least(hits, misses, false_alarms, correct_negatives, excluded_nan) < 0) AS n FROM c",
            ),
            (
                "count_overflow",
                "error",
                "concat(n, ' rows count more pairs than rows')",
                "no count overflow",
                "SELECT count(*) FILTER (WHERE hits + misses + false_alarms + correct_negatives + excluded_nan > total_rows) AS n FROM c",
            ),
            ("nan_heavy_group", "warning", "concat(n, ' groups exclude over half of their rows')", "no heavy exclusion", "SELECT count(*) FILTER (WHERE excluded_nan > 0.5 * total_rows) AS n FROM c"),
            (
                "empty_event_bucket",
                "warning",
                "concat(n, ' groups have no valid pair')",
                "no empty groups",
                "SELECT count(*) FILTER (WHERE total_rows > 0 AND hits + misses + false_alarms + correct_negatives = 0) AS n FROM c",
            ),
        ),
        "",
        f"c AS ({contingency_sql('lead_hours, model')})",
    ),
)
def _(spark, sf):
    table = contingency(verification(spark, sf), list(CATALOG), ["lead_hours", "model"], CATALOG)
    return quality.validate_contingency(table)


_DQ12 = " UNION ALL ".join(
    f"SELECT '{n}' AS metric_name, {_double(x)} AS metric_value, total_rows, excluded_nan AS missing_count FROM c" for n, x in SCORE_SQL.items()
)


@query(
    "dq12_validate_skill_scores",
    "DQ-12",
    sql=on_verification(
        "SELECT 'info' AS severity, concat('undefined_', metric_name) AS \"check\", concat(count(*), ' groups have an undefined ', metric_name) AS message, count(*) AS count FROM s WHERE metric_value IS NULL GROUP BY metric_name "
        "UNION ALL SELECT 'warning', 'nan_heavy_group', concat(n, ' groups miss over half of their rows'), n FROM (SELECT count(*) FILTER (WHERE missing_count > 0.5 * total_rows) AS n FROM s) AS h WHERE n > 0",
        "",
        f"c AS ({contingency_sql('lead_hours, model')}), s AS ({_DQ12})",
    ),
)
def _(spark, sf):
    scores = skill_scores(contingency(verification(spark, sf), list(CATALOG), ["lead_hours", "model"], CATALOG))
    return quality.validate_skill_scores(scores)


@query(
    "dq16_row_rules",
    "DQ-16",
    sql=on_shipments(
        "SELECT 'negative_lead' AS rule, count(*) FILTER (WHERE lead_hours < 0) AS violations FROM shipments "
        "UNION ALL SELECT 'target_before_issue', count(*) FILTER (WHERE forecast_target_time < forecast_issue_time) FROM shipments "
        "UNION ALL SELECT 'latitude_range', count(*) FILTER (WHERE NOT latitude BETWEEN -90 AND 90) FROM shipments "
        "UNION ALL SELECT 'longitude_range', count(*) FILTER (WHERE NOT longitude BETWEEN -180 AND 180) FROM shipments"
    ),
)
def _(spark, sf):
    return quality.row_rule_counts(shipments(spark, sf))


@query(
    "dq16_quarantined_rows",
    "DQ-16",
    sql=on_shipments("SELECT 'negative_lead' AS violated_rule, model, count(*) AS n FROM shipments WHERE lead_hours < 0 GROUP BY model"),
)
def _(spark, sf):
    _, bad = quality.split_rows(shipments(spark, sf).drop("lead_hours"))
    return bad.groupBy("violated_rule", "model").agg(F.count(F.lit(1)).alias("n"))


@query(
    "snk08_severity_totals",
    "SNK-08",
    sql=on_shipments(
        "SELECT severity, count(*) AS issues, CAST(sum(n) AS BIGINT) AS affected_rows FROM ("
        "SELECT CASE WHEN n > 0 THEN 'error' ELSE 'info' END AS severity, n FROM (SELECT count(*) FILTER (WHERE lead_hours < 0 OR lead_hours > 720) AS n FROM shipments) AS a "
        "UNION ALL SELECT CASE WHEN n * 100.0 / t > 50 THEN 'error' WHEN n * 100.0 / t > 10 THEN 'warning' ELSE 'info' END, n FROM "
        "(SELECT count(*) FILTER (WHERE observation_time IS NULL) AS n, count(*) AS t FROM shipments) AS b) AS u GROUP BY severity"
    ),
)
def _(spark, sf):
    s = shipments(spark, sf)
    return quality.severity_totals(quality.all_issues([quality.check_lead_times(s), quality.check_missing_observations(s)]))


@query(
    "dq07_checks_beside_write",
    "DQ-04",
    "DQ-06",
    "DQ-07",
    sql=on_shipments(" UNION ALL ".join(f"SELECT * FROM ({p('shipments')}) AS i{k}" for k, p in enumerate((_missing_sql, _leads_sql, _ranges_sql)))),
)
def _(spark, sf):
    path = scratch_path(spark, "checked")
    return quality.written_with_checks(shipments(spark, sf), lambda rows: rows.write.parquet(path), VARIABLES, RANGES)


# --- gaps and persistence ------------------------------------------------------------

_POINTS = "p AS (SELECT DISTINCT latitude, longitude, observation_time FROM verification WHERE observation_time IS NOT NULL)"


@query(
    "win01_timestamp_gaps",
    "WIN-01",
    sql=on_verification(
        "SELECT * FROM (SELECT *, datediff('second', previous_time, observation_time) / 3600.0::DOUBLE AS gap_hours FROM (SELECT *, "
        "lag(observation_time) OVER (PARTITION BY latitude, longitude ORDER BY observation_time) AS previous_time FROM p) AS q) AS g WHERE gap_hours > 1.5",
        "latitude longitude gap_hours",
        _POINTS,
    ),
)
def _(spark, sf):
    return sequence.time_gaps(verification(spark, sf))


@query(
    "win01_gap_summary",
    "WIN-01",
    sql=on_verification(
        "SELECT count(*) AS gaps, count(DISTINCT (latitude, longitude)) AS keys_with_gaps, max(h) AS longest_gap_hours FROM (SELECT *, "
        "datediff('second', lag(observation_time) OVER (PARTITION BY latitude, longitude ORDER BY observation_time), observation_time) / 3600.0::DOUBLE AS h FROM p) AS q WHERE h > 1.5",
        "longest_gap_hours",
        _POINTS,
    ),
)
def _(spark, sf):
    return sequence.gap_summary(verification(spark, sf))


@query(
    "win07_persistence",
    "WIN-07",
    sql=on_ensemble(
        "SELECT location_id, observation_time AS forecast_target_time, value AS observed_value, lag(value) OVER w AS persistence_forecast, "
        "lag(observation_time) OVER w AS previous_time, lag(value) OVER w - value AS error FROM ens_observations "
        "WINDOW w AS (PARTITION BY location_id ORDER BY observation_time)",
        "observed_value persistence_forecast error",
    ),
)
def _(spark, sf):
    return sequence.persistence(ensemble_observations(spark, sf), ["location_id"], "value")


# --- locations -----------------------------------------------------------------------


@query(
    "jn10_unmatched_location_ids",
    "JN-10",
    "SET-03",
    sql=on_verification(
        "SELECT DISTINCT concat('loc', CAST(l_suppkey % 20 AS VARCHAR)) AS location_id FROM lineitem "
        "EXCEPT SELECT concat('loc', CAST(user_id % 10 AS VARCHAR)) FROM events"
    ),
)
def _(spark, sf):
    return locations.unmatched_location_ids(shipments(spark, sf), ensemble_observations(spark, sf))


def _shifted(df):
    return df.withColumns({"latitude": F.col("latitude") + 0.1, "longitude": F.col("longitude") + 0.07})


_NEAREST_BY_ID = (
    "SELECT location_id, f.latitude, f.longitude, min(" + haversine_sql("f.latitude", "o.latitude", "f.longitude", "o.longitude", 6371.0088) + ") AS distance_km "
    "FROM (SELECT DISTINCT location_id, latitude + 0.1::DOUBLE AS latitude, longitude + 0.07::DOUBLE AS longitude FROM shipments) AS f "
    "JOIN (SELECT DISTINCT location_id, latitude, longitude FROM shipments) AS o USING (location_id) GROUP BY location_id, f.latitude, f.longitude"
)


@query("jn11_nearest_within_location", "JN-11", sql=on_shipments(_NEAREST_BY_ID, "latitude longitude distance_km"))
def _(spark, sf):
    s = shipments(spark, sf)
    return locations.nearest_observation_distance(_shifted(s), s).select("location_id", "latitude", "longitude", "distance_km")


@query(
    "dq05_location_audit",
    "DQ-05",
    "SET-05",
    sql=on_shipments(
        "SELECT (SELECT count(*) FROM (SELECT DISTINCT latitude, longitude FROM shipments) AS a) AS forecast_locations, "
        "(SELECT count(*) FROM (SELECT DISTINCT latitude, longitude FROM shipments) AS b) AS observation_locations, "
        f"max(distance_km) AS max_nearest_distance_km, TRUE AS has_location_id FROM ({_NEAREST_BY_ID}) AS n",
        "max_nearest_distance_km",
    ),
)
def _(spark, sf):
    s = shipments(spark, sf)
    return locations.location_audit(_shifted(s), s)


@query("set05_unique_locations", "SET-05", sql=on_shipments("SELECT DISTINCT latitude, longitude FROM shipments WHERE latitude IS NOT NULL", "latitude longitude"))
def _(spark, sf):
    return locations.unique_locations(shipments(spark, sf))

