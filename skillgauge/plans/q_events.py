"""Queries: event flags, contingency tables, scores, climatology, thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import SCORES, score
from ..functions.thresholds import OPERATORS, meets
from ..operators import events
from .registry import CATALOG, SQL_OPERATORS, contingency_sql, on_verification, query, stored, verification

SCORE_SQL = {
    "hit_rate": "hits / nullif(hits + misses, 0)",
    "false_alarm_rate": "false_alarms / nullif(false_alarms + correct_negatives, 0)",
    "precision": "hits / nullif(hits + false_alarms, 0)",
    "csi": "hits / nullif(hits + misses + false_alarms, 0)",
    "miss_rate": "misses / nullif(hits + misses, 0)",
    "accuracy": "(hits + correct_negatives) / nullif(hits + misses + false_alarms + correct_negatives, 0)",
    "odds_ratio": "(hits * correct_negatives) / nullif(misses * false_alarms, 0)",
}


def _double(expression: str) -> str:
    """The ratio in floating point, whatever integer division means."""
    for name in ("correct_negatives", "false_alarms", "misses", "hits"):
        expression = expression.replace(name, f"@{name[0]}@")
    for name in ("correct_negatives", "false_alarms", "misses", "hits"):
        expression = expression.replace(f"@{name[0]}@", f"CAST({name} AS DOUBLE)")
    return expression


def _flag(side: str, variable: str, threshold: float, op: str) -> str:
    return f"coalesce({side}_{variable} {SQL_OPERATORS[op]} {threshold}, FALSE)"


def by_model_stored(spark, sf):
    build = lambda sp, d: events.contingency(verification(sp, d), list(CATALOG), ["model"], CATALOG)
    return stored("contingency-model", spark, sf, build)


@query(
    "prj07_event_flags",
    "PRJ-07",
    "PRJ-10",
    sql=on_verification(
        f"SELECT order_id, line_id, {_flag('forecast', *CATALOG['high'])} AS event_forecast_high, "
        f"{_flag('observed', *CATALOG['high'])} AS event_observed_high FROM verification"
    ),
)
def _(spark, sf):
    flagged = events.event_flags(verification(spark, sf), "high", catalog=CATALOG)
    return flagged.select("order_id", "line_id", "event_forecast_high", "event_observed_high")


@query(
    "prj07_custom_event_flags",
    "PRJ-07",
    sql=on_verification(
        "SELECT order_id, line_id, coalesce(forecast_price > 2500, FALSE) AS event_forecast_dear, "
        "coalesce(observed_price > 2500, FALSE) AS event_observed_dear FROM verification"
    ),
)
def _(spark, sf):
    flagged = events.event_flags(verification(spark, sf), "dear", "price", 2500.0, "gt", CATALOG)
    return flagged.select("order_id", "line_id", "event_forecast_dear", "event_observed_dear")


@query(
    "prj08_threshold_operators",
    "PRJ-08",
    sql=on_verification(
        "SELECT model, "
        + ", ".join(f"count(*) FILTER (WHERE coalesce(observed_qty {SQL_OPERATORS[o]} 25, FALSE)) AS {o}_25" for o in OPERATORS)
        + " FROM verification GROUP BY model"
    ),
)
def _(spark, sf):
    counts = [F.count_if(meets(F.col("observed_qty"), 25.0, o)).alias(f"{o}_25") for o in OPERATORS]
    return verification(spark, sf).groupBy("model").agg(*counts)


@query(
    "prj10_event_catalog_counts",
    "PRJ-10",
    sql=on_verification(
        " UNION ALL ".join(
            f"SELECT '{n}' AS event_name, '{v}' AS variable, CAST({t} AS DOUBLE) AS threshold, '{o}' AS operator, "
            f"count(*) FILTER (WHERE {_flag('observed', v, t, o)}) AS observed_events FROM verification"
            for n, (v, t, o) in CATALOG.items()
        )
    ),
)
def _(spark, sf):
    catalog = events.event_catalog(verification(spark, sf), CATALOG)
    table = events.contingency(verification(spark, sf), list(CATALOG), (), CATALOG)
    observed = table.select("event_name", (F.col("hits") + F.col("misses")).alias("_pairs"))
    # Every row has a forecast, so events among complete pairs are all observed events.
    return catalog.join(observed, "event_name").withColumnRenamed("_pairs", "observed_events")


@query(
    "prj11_event_categories",
    "PRJ-11",
    sql=on_verification(
        "SELECT order_id, line_id, CASE WHEN forecast_qty >= 40 AND observed_qty >= 40 THEN 'Hit' WHEN observed_qty >= 40 THEN 'Miss' "
        "WHEN forecast_qty >= 40 THEN 'FalseAlarm' ELSE 'CorrectRejection' END AS event_category FROM verification "
        "WHERE forecast_qty IS NOT NULL AND observed_qty IS NOT NULL"
    ),
)
def _(spark, sf):
    return events.classify(verification(spark, sf), "qty", 40.0).select("order_id", "line_id", "event_category")


@query("confusion_by_model", "AGG-15", "AGG-16", sql=on_verification(contingency_sql("model")))
def _(spark, sf):
    return events.contingency(verification(spark, sf), list(CATALOG), ["model"], CATALOG)


@query("agg16_contingency_overall", "AGG-16", sql=on_verification(contingency_sql("")))
def _(spark, sf):
    return events.contingency(verification(spark, sf), list(CATALOG), (), CATALOG)


@query("agg16_contingency_by_lead_and_season", "AGG-16", sql=on_verification(contingency_sql("lead_hours, season")))
def _(spark, sf):
    return events.contingency(verification(spark, sf), list(CATALOG), ["lead_hours", "season"], CATALOG)


def _scores_sql(dims: str) -> str:
    shown = {
        "lead_hours": "CAST(NULL AS INT) AS lead_hours",
        "model": "CAST(NULL AS VARCHAR) AS model",
        "month": "CAST(NULL AS INT) AS month",
        "season": "CAST(NULL AS VARCHAR) AS season",
    }
    keys = ", ".join(d if d in dims else v for d, v in shown.items())
    return " UNION ALL ".join(
        f"SELECT {keys}, event_name, variable, '{n}' AS metric_name, {_double(x)} AS metric_value, sample_size, total_rows, "
        f"excluded_nan AS missing_count FROM c"
        for n, x in SCORE_SQL.items()
    )


_BY_MODEL = f"c AS ({contingency_sql('model')})"
_BY_LEAD = f"c AS ({contingency_sql('lead_hours')})"


@query("fn18_skill_scores_by_model", "FN-18", sql=on_verification(_scores_sql("model"), "metric_value", _BY_MODEL))
def _(spark, sf):
    return events.skill_scores(by_model_stored(spark, sf))


@query("fn18_skill_scores_by_lead", "FN-18", sql=on_verification(_scores_sql("lead_hours"), "metric_value", _BY_LEAD))
def _(spark, sf):
    return events.skill_scores(events.contingency(verification(spark, sf), list(CATALOG), ["lead_hours"], CATALOG))


@query(
    "fn11_to_fn17_scores_wide",
    "FN-11",
    "FN-12",
    "FN-13",
    "FN-14",
    "FN-15",
    "FN-16",
    "FN-17",
    sql=on_verification(
        "SELECT model, event_name, " + ", ".join(f"{_double(x)} AS {n}" for n, x in SCORE_SQL.items()) + " FROM c",
        " ".join(SCORE_SQL),
        _BY_MODEL,
    ),
)
def _(spark, sf):
    return by_model_stored(spark, sf).select("model", "event_name", *[score(n).alias(n) for n in SCORES])


@query(
    "agg46_model_comparison",
    "AGG-46",
    sql=on_verification(
        f"SELECT model, event_name, 'csi' AS metric_name, {_double(SCORE_SQL['csi'])} AS metric_value, sample_size FROM c WHERE event_name = 'high'",
        "metric_value",
        _BY_MODEL,
    ),
)
def _(spark, sf):
    return events.model_comparison(verification(spark, sf), "high", "csi", catalog=CATALOG)


@query(
    "srt05_best_model_by_csi",
    "SRT-05",
    sql=on_verification(
        f"SELECT event_name, 'csi' AS metric_name, model, metric_value FROM (SELECT event_name, model, {_double(SCORE_SQL['csi'])} AS metric_value, "
        f"row_number() OVER (PARTITION BY event_name ORDER BY {_double(SCORE_SQL['csi'])} DESC, model DESC) AS rn FROM c "
        f"WHERE {_double(SCORE_SQL['csi'])} IS NOT NULL) AS x WHERE rn = 1",
        "metric_value",
        _BY_MODEL,
    ),
)
def _(spark, sf):
    scores = events.skill_scores(by_model_stored(spark, sf)).where("metric_name = 'csi'")
    return events.best_model(scores)


def _climatology_sql(name: str, dims: str, extra: str = "TRUE") -> str:
    flag = _flag("observed", *CATALOG[name])
    return (
        f"SELECT {dims}, '{name}' AS event_name, avg(CAST({flag} AS DOUBLE)) AS climatology_prob, count(*) AS sample_size, "
        f"count(*) AS total_rows FROM verification WHERE {extra} GROUP BY {dims}"
    )


@query("agg17_climatology", "AGG-17", sql=on_verification(_climatology_sql("high", "month"), "climatology_prob"))
def _(spark, sf):
    return events.climatology(verification(spark, sf), "high", ["month"], CATALOG)


@query(
    "agg17_climatology_observed_only",
    "AGG-17",
    sql=on_verification(_climatology_sql("high", "season, model", "observed_qty IS NOT NULL"), "climatology_prob"),
)
def _(spark, sf):
    return events.climatology(verification(spark, sf), "high", ["season", "model"], CATALOG, exclude_missing=True)


@query(
    "jn09_climatology_skill",
    "JN-09",
    sql=on_verification(
        "SELECT model, event_name, f AS forecast_csi, k AS climatology_csi, 1 - (f - k) / nullif(1 - k, 0) AS relative_skill, "
        "(f - k) / nullif(1 - k, 0) AS csi_skill FROM (SELECT c.model, c.event_name, "
        f"{_double(SCORE_SQL['csi'])} AS f, CASE WHEN p > 0.5 THEN floor((hits + misses) * p) / "
        "nullif(CAST(hits + misses AS DOUBLE) + floor((false_alarms + correct_negatives) * p), 0) ELSE 0.0 END AS k FROM c "
        "JOIN (SELECT model, avg(CAST(observed_price < 1000 AS DOUBLE)) AS p FROM verification GROUP BY model) AS q ON c.model = q.model "
        "WHERE event_name = 'cheap') AS x",
        "forecast_csi climatology_csi relative_skill csi_skill",
        _BY_MODEL,
    ),
)
def _(spark, sf):
    base = events.climatology(verification(spark, sf), "cheap", ["model"], CATALOG)
    return events.climatology_skill(by_model_stored(spark, sf), base, ["model"])


THRESHOLDS = (5.0, 10.0, 20.0, 30.0, 40.0)


def _sweep_sql() -> str:
    pair = "forecast_qty IS NOT NULL AND observed_qty IS NOT NULL"
    parts = []
    for t in THRESHOLDS:
        parts.append(
            f"SELECT model, CAST({t} AS DOUBLE) AS threshold, count(*) FILTER (WHERE forecast_qty >= {t} AND observed_qty >= {t}) AS hits, "
            f"count(*) FILTER (WHERE forecast_qty < {t} AND observed_qty >= {t}) AS misses, "
            f"count(*) FILTER (WHERE forecast_qty >= {t} AND observed_qty < {t}) AS false_alarms, "
            f"count(*) FILTER (WHERE forecast_qty < {t} AND observed_qty < {t}) AS correct_negatives FROM verification WHERE {pair} GROUP BY model"
        )
    return f"c AS ({' UNION ALL '.join(parts)})"


@query(
    "agg18_threshold_sweep",
    "AGG-18",
    "AGG-19",
    sql=on_verification(
        f"SELECT *, {_double(SCORE_SQL['hit_rate'])} AS hit_rate, {_double(SCORE_SQL['false_alarm_rate'])} AS false_alarm_rate, "
        f"{_double(SCORE_SQL['csi'])} AS csi, 100.0::DOUBLE * (hits + misses) / (hits + misses + false_alarms + correct_negatives) AS observed_pct, "
        "100.0::DOUBLE * (hits + false_alarms) / (hits + misses + false_alarms + correct_negatives) AS forecast_pct FROM c",
        "hit_rate false_alarm_rate csi observed_pct forecast_pct",
        _sweep_sql(),
    ),
)
def _(spark, sf):
    return events.threshold_sweep(verification(spark, sf), "qty", THRESHOLDS, ["model"])


@query(
    "agg20_event_contingency",
    "AGG-20",
    sql=on_verification(
        "SELECT hits, misses, false_alarms, correct_negatives, hits + misses + false_alarms + correct_negatives AS total, "
        f"{_double(SCORE_SQL['hit_rate'])} AS hit_rate, {_double(SCORE_SQL['false_alarm_rate'])} AS false_alarm_rate, {_double(SCORE_SQL['csi'])} AS csi, season "
        f"FROM (SELECT * FROM c WHERE event_name = 'high') AS h",
        "hit_rate false_alarm_rate csi",
        f"c AS ({contingency_sql('season', ('high',))})",
    ),
)
def _(spark, sf):
    return events.event_contingency(verification(spark, sf), "qty", 40.0, ["season"])


@query(
    "snk10_event_rows",
    "SNK-10",
    sql=on_verification(
        " UNION ALL ".join(
            f"SELECT event_name, source, variable, threshold, count(*) AS n, count(*) FILTER (WHERE is_event) AS n_events, count(DISTINCT event_date) AS days FROM ("
            f"SELECT '{n}' AS event_name, '{s}' AS source, '{v}' AS variable, CAST({t} AS DOUBLE) AS threshold, {s}_{v} {SQL_OPERATORS[o]} {t} AS is_event, "
            f"CAST(forecast_target_time AS DATE) AS event_date FROM verification WHERE {s}_{v} IS NOT NULL) AS e_{n}_{s} GROUP BY ALL"
            for n, (v, t, o) in CATALOG.items()
            for s in ("forecast", "observed")
        )
    ),
)
def _(spark, sf):
    rows = events.event_rows(verification(spark, sf), CATALOG)
    return rows.groupBy("event_name", "source", "variable", "threshold").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_event").alias("n_events"), F.count_distinct("event_date").alias("days")
    )


@query(
    "snk10_combined_events",
    "SNK-10",
    sql=on_verification("SELECT order_id, line_id, forecast_qty, observed_qty FROM verification WHERE forecast_qty <= 5 OR observed_qty <= 5"),
)
def _(spark, sf):
    return events.combined_events(verification(spark, sf), "low", CATALOG).select("order_id", "line_id", "forecast_qty", "observed_qty")
