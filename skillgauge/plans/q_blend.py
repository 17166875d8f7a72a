"""Queries: skill store, weights, blends, agreement, confidence, regime rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement, blend, metrics, regime, skillstore, weighting
from ..session import literal_table, scratch_path
from .q_metrics import JOINED, RECORDS, joined, records
from .registry import ensemble_forecasts, ensemble_observations, on_ensemble, query, stored

CONTEXT_SCHEMA = "variable string, lead_hours int, season string, region string"


def _entries(spark, sf):
    rows = records(spark, sf).where("match_status <> 'observation_only'").withColumnRenamed("forecast_model", "model")
    evaluated = metrics.evaluations(rows, "lead_time", by=["model"])
    return skillstore.entries_from_evaluations(evaluated, updated_at=F.lit("2024-02-01").cast("timestamp"))


def entries(spark, sf):
    """The skill store is a stored table; every lookup reads it."""
    return stored("skill-entries", spark, sf, _entries)


_MID = "month(make_timestamp(CAST((epoch_us(min(valid_time)) + epoch_us(max(valid_time))) / 2 AS BIGINT)))"
_SEASON = f"CASE WHEN {_MID} IN (12,1,2) THEN 'DJF' WHEN {_MID} IN (3,4,5) THEN 'MAM' WHEN {_MID} IN (6,7,8) THEN 'JJA' ELSE 'SON' END"
ENTRIES = (
    RECORDS
    + ", en AS ("
    + " UNION ALL ".join(
        f"SELECT forecast_model AS model, 'load' AS variable, lead_hours, {_SEASON} AS season, '' AS region, '{k}' AS metric_type, {x} AS value, "
        "count(error) AS sample_size, count(error) / CAST(count(*) AS DOUBLE) AS coverage_fraction, count(error) >= 1 AS is_stable "
        "FROM rec WHERE match_status <> 'observation_only' GROUP BY forecast_model, lead_hours HAVING count(error) > 0"
        for k, x in (
            ("mae", "avg(abs(error))"),
            ("rmse", "sqrt(avg(error * error))"),
            ("bias", "avg(error)"),
            ("error_variance", "var_pop(error)"),
        )
    )
    + ")"
)


@query(
    "meta01_skill_entries",
    "META-01",
    sql=on_ensemble("SELECT * FROM en", "value coverage_fraction", ENTRIES),
)
def _(spark, sf):
    # Storing the same evaluations twice leaves one entry per key.
    twice = skillstore.upsert(entries(spark, sf), entries(spark, sf))
    return twice.drop("updated_at")


def contexts(spark, sf):
    """Every lead in its own and in an unseen season, an unseen lead, and no lead at all."""
    leads = entries(spark, sf).select("variable", "lead_hours").distinct()
    asked = F.array(F.col("lead_hours"), F.col("lead_hours") + 1000, F.lit(None).cast("int"))
    rows = leads.select("variable", F.explode(asked).alias("lead_hours"))
    return rows.select("variable", "lead_hours", F.explode(F.array(F.lit("DJF"), F.lit("JJA"))).alias("season"), F.lit("").alias("region")).distinct()


_LEVELS = "lv(level, l, s, r) AS (VALUES (1,1,1,1), (2,1,1,0), (3,1,0,1), (4,1,0,0), (5,0,1,1), (6,0,1,0), (7,0,0,1), (8,0,0,0))"


def _context_ctes(context_sql: str) -> str:
    return (
        ENTRIES
        + f", cx AS ({context_sql}), {_LEVELS}, mt AS (SELECT c.variable, c.lead_hours, c.season, c.region, e.model, level, e.metric_type, e.value, e.is_stable, e.coverage_fraction, "
        "e.lead_hours AS e_lead, e.season AS e_season FROM cx c, lv, en e WHERE e.variable = c.variable AND (l = 0 OR c.lead_hours IS NULL OR e.lead_hours = c.lead_hours) "
        "AND (s = 0 OR c.season = '' OR e.season = c.season) AND (r = 0 OR c.region = '' OR e.region = c.region)), "
        "sk AS (SELECT variable, lead_hours, season, region, model, CAST(level AS INT) AS level, count(*) AS entries, min(value) FILTER (WHERE metric_type = 'mae' AND is_stable) AS best_value, "
        "arg_min(value, e_lead) FILTER (WHERE metric_type = 'mae' AND is_stable) AS first_value, avg(coverage_fraction) AS mean_coverage, avg(CAST(is_stable AS DOUBLE)) AS stable_share "
        "FROM (SELECT *, min(level) OVER (PARTITION BY variable, lead_hours, season, region, model) AS lowest FROM mt) AS m WHERE level = lowest GROUP BY ALL)"
    )


_CONTEXTS_SQL = (
    "SELECT DISTINCT variable, lead_hours, season, '' AS region FROM (SELECT variable, unnest([lead_hours, lead_hours + 1000, NULL]) AS lead_hours FROM en) AS a, "
    "(VALUES ('DJF'), ('JJA')) AS b(season)"
)
SKILL = _context_ctes(_CONTEXTS_SQL)
_GLOBAL = "SELECT 'load' AS variable, CAST(NULL AS INT) AS lead_hours, '' AS season, '' AS region"


@query(
    "meta02_context_lookup",
    "META-02",
    sql=on_ensemble("SELECT * FROM sk", "best_value first_value mean_coverage stable_share", SKILL),
)
def _(spark, sf):
    return skillstore.skill_by_context(entries(spark, sf), contexts(spark, sf))


@query(
    "meta03_best_model",
    "META-03",
    sql=on_ensemble(
        "SELECT variable, lead_hours, season, region, arg_min(model, (best_value, model)) AS model, min(best_value) AS value FROM sk WHERE best_value IS NOT NULL GROUP BY ALL",
        "value",
        SKILL,
    ),
)
def _(spark, sf):
    return skillstore.best_model(skillstore.skill_by_context(entries(spark, sf), contexts(spark, sf)))


@query(
    "meta04_skill_ranking",
    "META-04",
    "WIN-06",
    sql=on_ensemble(
        "SELECT variable, lead_hours, season, region, model, first_value AS value, CAST(row_number() OVER (PARTITION BY variable, lead_hours, season, region "
        "ORDER BY first_value, model) AS INT) AS rank FROM sk WHERE first_value IS NOT NULL",
        "value",
        SKILL,
    ),
)
def _(spark, sf):
    return skillstore.ranking(skillstore.skill_by_context(entries(spark, sf), contexts(spark, sf)))


@query(
    "meta04_model_summary",
    "META-04",
    "META-19",
    sql=on_ensemble(
        "SELECT model, variable, count(*) AS entries, count(*) FILTER (WHERE is_stable) AS stable_entries, min(value) FILTER (WHERE metric_type = 'mae' AND is_stable) AS best_mae, "
        "avg(coverage_fraction) AS mean_coverage FROM en GROUP BY model, variable",
        "best_mae mean_coverage",
        ENTRIES,
    ),
)
def _(spark, sf):
    path = scratch_path(spark, "skill-store")
    skillstore.save(entries(spark, sf), path)
    return skillstore.model_summary(skillstore.load(spark, path))


def _weights_ctes(recent: str = "0.5") -> str:
    return (
        ", comp AS (SELECT *, coalesce(CASE WHEN best_value > 0 THEN least(min(best_value) OVER w / best_value, 1) ELSE 0 END, 0) AS hs, "
        f"{recent} AS rs, coalesce(least(mean_coverage, 1), 0) AS cs, coalesce(stable_share, 0) AS ss FROM sk WINDOW w AS (PARTITION BY variable, lead_hours, season, region)), "
        "sc AS (SELECT *, 0.4 * hs + 0.25 * rs + 0.2 * cs + 0.15 * ss AS score FROM comp), "
        "nm AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) "
        "ELSE 1.0 / count(*) OVER w END AS scaled FROM sc WINDOW w AS (PARTITION BY variable, lead_hours, season, region)), "
        "wt AS (SELECT variable, lead_hours, season, region, model, hs, rs, cs, ss, CASE WHEN sum(scaled) OVER w > 0 THEN scaled / sum(scaled) OVER w ELSE scaled END AS weight "
        "FROM nm WINDOW w AS (PARTITION BY variable, lead_hours, season, region))"
    )


_WEIGHT_COLUMNS = (
    "variable, lead_hours, season, region, model, weight, 0.4 * hs AS historical_skill_contribution, 0.25 * rs AS recent_skill_contribution, "
    "0.2 * cs AS coverage_contribution, 0.15 * ss AS stability_contribution, "
    + ", ".join(
        f"CASE WHEN {c} >= 0.8 THEN 'high' WHEN {c} >= 0.5 THEN 'middle' WHEN {c} > 0 THEN 'low' END AS {name}_grade"
        for c, name in (("hs", "historical_skill"), ("rs", "recent_skill"), ("cs", "coverage"), ("ss", "stability"))
    )
)
_WEIGHT_DOUBLES = "weight historical_skill_contribution recent_skill_contribution coverage_contribution stability_contribution"


def _with_grades(table):
    """The grades of the four components as columns of their own."""
    names = table.schema["grades"].dataType.names
    return table.select("*", *[F.col(f"grades.{n}").alias(f"{n}_grade") for n in names]).drop("grades")


@query(
    "meta08_weights_by_context",
    "META-05",
    "META-07",
    "META-08",
    sql=on_ensemble(f"SELECT {_WEIGHT_COLUMNS} FROM wt", _WEIGHT_DOUBLES, SKILL + _weights_ctes()),
)
def _(spark, sf):
    return _with_grades(weighting.model_weights(entries(spark, sf), contexts(spark, sf)))


_RECENT = (
    "coalesce((SELECT CASE WHEN r.m > 0 THEN least(r.b / r.m, 1) ELSE 0 END FROM (SELECT model, avg(value) AS m, (SELECT min(value) FROM en WHERE metric_type = 'mae' AND lead_hours <= 72) AS b "
    "FROM en WHERE metric_type = 'mae' AND lead_hours <= 72 GROUP BY model) AS r WHERE r.model = sk.model), 0)"
)


@query(
    "meta06_weights_with_recent_skill",
    "META-06",
    "META-08",
    sql=on_ensemble(f"SELECT {_WEIGHT_COLUMNS} FROM wt", _WEIGHT_DOUBLES, _context_ctes(_GLOBAL) + _weights_ctes(_RECENT)),
)
def _(spark, sf):
    recent = entries(spark, sf).where("lead_hours <= 72").select("model", "metric_type", "value")
    everywhere = literal_table(spark, [("load", None, "", "")], CONTEXT_SCHEMA)
    return _with_grades(weighting.model_weights(entries(spark, sf), everywhere, recent=recent))


def weights(spark, sf):
    """One weight per model over all leads and seasons."""

    def build(sp, d):
        everywhere = literal_table(sp, [("load", None, "", "")], CONTEXT_SCHEMA)
        return weighting.model_weights(entries(sp, d), everywhere).select("model", "weight")

    return stored("weights", spark, sf, build)


WEIGHTS = _context_ctes(_GLOBAL) + _weights_ctes()


def members(spark, sf):
    return ensemble_forecasts(spark, sf).withColumnRenamed("forecast_target_time", "valid_time").drop("forecast_issue_time", "location_id")


_KEY = "variable, lead_hours, latitude, longitude, forecast_target_time"
_SPREAD = (
    f"tg AS (SELECT {_KEY}, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, max(value) - min(value) AS rng, "
    f"string_agg(model, ',' ORDER BY model) AS names FROM ens_forecasts WHERE value IS NOT NULL GROUP BY {_KEY})"
)
_BLENDED = (
    WEIGHTS
    + f", bl AS (SELECT {', '.join('f.' + k for k in _KEY.split(', '))}, CASE WHEN sum(w.weight) = 0 THEN avg(f.value) ELSE sum(w.weight * f.value) / sum(w.weight) END AS value, "
    "count(*) AS n, avg(f.value) AS mean, stddev_samp(f.value) AS std, max(f.value) - min(f.value) AS rng, string_agg(f.model, ',' ORDER BY f.model) AS names FROM ens_forecasts f JOIN wt w ON f.model = w.model "
    f"GROUP BY {', '.join('f.' + k for k in _KEY.split(', '))})"
)
_POOL = "(SELECT count(DISTINCT model) FROM ens_forecasts)"
# Score of each confidence factor over targets with std, n and lead_hours; "load" is of no known kind.
_FACTORS = {
    "historical_error": "0.5",
    "model_agreement": "CASE WHEN std IS NULL THEN 0.5 WHEN std <= 0.5 THEN 0.95 WHEN std <= 1 THEN 0.8 WHEN std <= 2 THEN 0.6 WHEN std <= 5 THEN 0.4 ELSE 0.2 END",
    "coverage": f"CASE WHEN n * 1.0 / {_POOL} >= 1 THEN 1.0 WHEN n * 1.0 / {_POOL} >= 0.75 THEN 0.8 WHEN n * 1.0 / {_POOL} >= 0.5 THEN 0.6 "
    f"WHEN n * 1.0 / {_POOL} >= 0.25 THEN 0.4 ELSE 0.2 END",
    "lead_time": "CASE WHEN lead_hours <= 24 THEN 0.9 WHEN lead_hours <= 48 THEN 0.7 WHEN lead_hours <= 72 THEN 0.5 WHEN lead_hours <= 120 THEN 0.3 ELSE 0.1 END",
    "stability": "(SELECT CASE WHEN count(*) < 2 THEN 0.5 WHEN var_pop(weight) < 0.01 THEN 0.9 WHEN var_pop(weight) < 0.05 THEN 0.7 WHEN var_pop(weight) < 0.1 THEN 0.5 ELSE 0.3 END FROM wt)",
    "variable_volatility": "0.5",
}
_CONFIDENCE = " + ".join(f"{agreement.CONFIDENCE_WEIGHTS[name]} * ({score})" for name, score in _FACTORS.items())
_FACTOR_ROWS = " UNION ALL ".join(
    f"SELECT {_KEY}, '{name}' AS factor, CAST({score} AS DOUBLE) AS score FROM bl" for name, score in _FACTORS.items()
)
_GRADED = "CASE WHEN score > 0.7 THEN 'strong' WHEN score > 0.4 THEN 'moderate' ELSE 'weak' END AS grade"


def blended(spark, sf):
    return blend.blend(members(spark, sf), weights(spark, sf))


@query(
    "meta09_blend",
    "META-09",
    "META-10",
    "META-11",
    "META-13",
    sql=on_ensemble(
        "SELECT variable, lead_hours, latitude, longitude, forecast_target_time AS valid_time, value, std AS inter_model_std, rng AS inter_model_range, "
        "CASE WHEN n < 2 THEN 'insufficient' WHEN mean = 0 THEN CASE WHEN std > 10 THEN 'low' WHEN std > 1 THEN 'medium' ELSE 'high' END "
        "WHEN std / abs(mean) < 0.05 THEN 'high' WHEN std / abs(mean) < 0.2 THEN 'medium' ELSE 'low' END AS model_agreement, CAST(n AS INT) AS active_models, "
        f"CAST({_POOL} AS INT) AS total_models, n / CAST({_POOL} AS DOUBLE) AS coverage_fraction, CAST({_CONFIDENCE} AS DOUBLE) AS confidence_score, names AS contributors FROM bl",
        "latitude longitude value inter_model_std inter_model_range coverage_fraction confidence_score",
        _BLENDED,
    ),
)
def _(spark, sf):
    # Weights and values of contributors, and the factors of the score, have queries of their own.
    names = F.array_join(F.transform("contributors", lambda c: c["model"]), ",")
    return blended(spark, sf).withColumn("contributors", names).drop("confidence_factors")


@query(
    "meta09_contributors",
    "META-09",
    sql=on_ensemble(
        f"SELECT {', '.join('f.' + k for k in _KEY.split(', ')[:-1])}, f.forecast_target_time AS valid_time, f.model, w.weight, f.value FROM ens_forecasts f JOIN wt w ON f.model = w.model",
        "latitude longitude weight value",
        WEIGHTS,
    ),
)
def _(spark, sf):
    return blended(spark, sf).select("variable", "lead_hours", "latitude", "longitude", "valid_time", F.inline("contributors"))


@query(
    "meta13_factors_of_blend",
    "META-13",
    sql=on_ensemble(
        f"SELECT * EXCLUDE (forecast_target_time), forecast_target_time AS valid_time, {_GRADED} FROM ({_FACTOR_ROWS}) AS x", "latitude longitude score", _BLENDED
    ),
)
def _(spark, sf):
    return blended(spark, sf).select("variable", "lead_hours", "latitude", "longitude", "valid_time", F.inline("confidence_factors"))


@query(
    "meta12_ensemble_agreement",
    "META-12",
    "META-10",
    sql=on_ensemble(
        f"SELECT variable, lead_hours, latitude, longitude, forecast_target_time AS valid_time, CAST({_POOL} AS INT) AS total_models, CAST(n AS INT) AS models_with_values, std AS inter_model_std, "
        "CASE WHEN n >= 2 THEN rng END AS inter_model_range, CASE WHEN n >= 2 THEN CASE WHEN mean = 0 THEN least(rng / 10, 1) ELSE least(std / abs(mean) / 0.5, 1) END END AS disagreement_score, "
        "CASE WHEN n >= 2 THEN 1 - CASE WHEN mean = 0 THEN least(rng / 10, 1) ELSE least(std / abs(mean) / 0.5, 1) END END AS consensus_score, "
        "CASE WHEN n < 2 THEN 'insufficient' WHEN std <= 1 THEN 'high' WHEN std <= 3 THEN 'medium' ELSE 'low' END AS agreement_level, "
        "n >= 2 AND lead_hours > 72 AS is_long_lead, names AS model_values FROM tg",
        "latitude longitude inter_model_std inter_model_range disagreement_score consensus_score",
        _SPREAD,
    ),
)
def _(spark, sf):
    # The values themselves are in the next query.
    names = F.array_join(F.transform("model_values", lambda m: m["model"]), ",")
    return agreement.ensemble_agreement(members(spark, sf)).withColumn("model_values", names)


@query(
    "meta12_member_values",
    "META-12",
    sql=on_ensemble(
        "SELECT variable, lead_hours, latitude, longitude, forecast_target_time AS valid_time, model, value FROM ens_forecasts WHERE value IS NOT NULL", "latitude longitude value"
    ),
)
def _(spark, sf):
    return agreement.ensemble_agreement(members(spark, sf)).select("variable", "lead_hours", "latitude", "longitude", "valid_time", F.inline("model_values"))


@query(
    "meta13_confidence_factors",
    "META-13",
    sql=on_ensemble(
        f"SELECT lead_hours, factor, score, {_GRADED}, count(*) AS n FROM ("
        + " UNION ALL ".join(
            f"SELECT lead_hours, '{name}' AS factor, CAST({'0.5' if name == 'stability' else score} AS DOUBLE) AS score FROM tg" for name, score in _FACTORS.items()
        )
        + ") AS x GROUP BY lead_hours, factor, score",
        "score",
        _SPREAD,
    ),
)
def _(spark, sf):
    # Without weights their variance is unknown, and stability neutral.
    spread = agreement.ensemble_agreement(members(spark, sf)).withColumn("coverage_fraction", F.col("models_with_values") / F.col("total_models"))
    listed = agreement.with_confidence(spread).select("lead_hours", F.inline("confidence_factors"))
    return listed.groupBy("lead_hours", "factor", "score", "grade").agg(F.count(F.lit(1)).alias("n"))


def scored(spark, sf):
    """Blend and single models next to the observation of their target."""
    o = ensemble_observations(spark, sf).select("latitude", "longitude", F.col("observation_time").alias("valid_time"), F.col("value").alias("observed"))
    keep = ["variable", "lead_hours", "latitude", "longitude", "valid_time", "model", "value"]
    mixed = blended(spark, sf).withColumn("model", F.lit(blend.BLEND))
    both = members(spark, sf).select(*keep).unionByName(mixed.select(*keep))
    return both.join(o, ["latitude", "longitude", "valid_time"], "left")


_SCORED = (
    _BLENDED
    + ", al AS (SELECT variable, lead_hours, latitude, longitude, forecast_target_time, model, value FROM ens_forecasts UNION ALL "
    "SELECT variable, lead_hours, latitude, longitude, forecast_target_time, 'blend', value FROM bl), "
    "se AS (SELECT al.variable, al.lead_hours, al.model, al.value - o.value AS e FROM al LEFT JOIN ens_observations o "
    "ON al.latitude = o.latitude AND al.longitude = o.longitude AND al.forecast_target_time = o.observation_time)"
)


def _evaluation_sql(keys: str, source: str = "se") -> str:
    shown = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    stats = f"SELECT {shown}model, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, count(e) AS n, count(*) AS total, stddev_pop(abs(e)) AS sd FROM {source} GROUP BY {shown}model"
    return (
        f"SELECT {shown}blended_mae, blended_rmse, blended_coverage, best_single_model, best_single_mae, best_single_rmse, (blended_mae - best_single_mae) / best_single_mae * 100 AS mae_improvement_pct, "
        "(blended_rmse - best_single_rmse) / best_single_rmse * 100 AS rmse_improvement_pct, coalesce(blended_mae < best_single_mae, FALSE) AS improvement_over_best, blend_stability, sample_size, "
        "CASE WHEN best_single_mae > 0 THEN CASE WHEN blended_mae < best_single_mae THEN 'lower' WHEN blended_mae > best_single_mae THEN 'higher' WHEN blended_mae = best_single_mae THEN 'equal' END END AS mae_outcome FROM ("
        f"SELECT {shown}max(mae) FILTER (WHERE model = 'blend') AS blended_mae, max(rmse) FILTER (WHERE model = 'blend') AS blended_rmse, max(n / CAST(total AS DOUBLE)) FILTER (WHERE model = 'blend') AS blended_coverage, "
        "arg_min(model, (mae, model)) FILTER (WHERE model <> 'blend') AS best_single_model, min(mae) FILTER (WHERE model <> 'blend') AS best_single_mae, arg_min(rmse, (mae, model)) FILTER (WHERE model <> 'blend') AS best_single_rmse, "
        "max(CASE WHEN n >= 3 THEN CASE WHEN mae = 0 THEN 1 ELSE greatest(0, 1 - sd / mae) END END) FILTER (WHERE model = 'blend') AS blend_stability, max(n) FILTER (WHERE model = 'blend') AS sample_size "
        f"FROM ({stats}) AS s {group}) AS p"
    )


_EVAL = "blended_mae blended_rmse blended_coverage best_single_mae best_single_rmse mae_improvement_pct rmse_improvement_pct blend_stability"


@query("meta14_evaluate_blend", "META-14", sql=on_ensemble(_evaluation_sql(""), _EVAL, _SCORED))
def _(spark, sf):
    return blend.evaluate_blend(scored(spark, sf))


@query(
    "meta15_evaluate_by_lead_bin",
    "META-15",
    sql=on_ensemble(
        _evaluation_sql("bin_start, bin_lead", "sb"),
        _EVAL,
        _SCORED
        + ", sb AS (SELECT *, CAST(b AS INT) AS bin_start, CAST(m AS INT) AS bin_lead FROM se JOIN (VALUES (0, 24, 12), (25, 72, 48), (73, 120, 96), (121, 9999, 5060)) AS k(b, t, m) ON lead_hours BETWEEN b AND t)",
    ),
)
def _(spark, sf):
    return blend.evaluate_by_lead(scored(spark, sf))


@query("meta16_evaluate_by_variable", "META-16", sql=on_ensemble(_evaluation_sql("variable"), _EVAL, _SCORED))
def _(spark, sf):
    return blend.evaluate_by_variable(scored(spark, sf))


_SHARED = (
    JOINED
    + ", pm AS (SELECT forecast_issue_time, forecast_target_time, location_id, lead_hours, model, min(forecast_load) AS value, sum(observed_load) AS so, count(observed_load) AS no "
    "FROM ver WHERE forecast_load IS NOT NULL AND observed_load IS NOT NULL GROUP BY ALL), "
    "sh AS (SELECT forecast_issue_time, forecast_target_time, location_id, lead_hours, sum(so) / sum(no) AS observed, count(*) AS n, avg(value) AS mean_value FROM pm GROUP BY ALL "
    "HAVING count(*) = (SELECT count(DISTINCT model) FROM pm))"
)


@query(
    "jn08_shared_targets",
    "JN-08",
    sql=on_ensemble("SELECT forecast_issue_time, forecast_target_time, location_id, lead_hours, observed, mean_value FROM sh", "observed mean_value", _SHARED),
)
def _(spark, sf):
    shared = blend.shared_targets(joined(spark, sf), "load")
    mean = F.aggregate("members", F.lit(0.0), lambda acc, m: acc + m["value"]) / F.size("members")
    return shared.withColumn("mean_value", mean).drop("members")


def _holdout_sql(split: str) -> str:
    ctes = (
        _SHARED
        + f", sp AS ({split}), lg AS (SELECT sp.*, pm.model, pm.value FROM sp JOIN pm USING (forecast_issue_time, forecast_target_time, location_id, lead_hours)), "
        "tm AS (SELECT model, avg(abs(value - observed)) AS mae FROM lg WHERE is_train GROUP BY model), "
        "ts AS (SELECT model, 0.4 * CASE WHEN mae > 0 THEN least(min(mae) OVER () / mae, 1) ELSE 0 END AS score FROM tm), "
        "tn AS (SELECT model, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1.0 / count(*) OVER () END AS w FROM ts), "
        "tw AS (SELECT model, w / sum(w) OVER () AS weight FROM tn), "
        "se AS (SELECT 'load' AS variable, model, value - observed AS e FROM lg WHERE NOT is_train UNION ALL SELECT 'load', 'blend', sum(weight * value) - observed FROM lg JOIN tw USING (model) "
        "WHERE NOT is_train GROUP BY forecast_issue_time, forecast_target_time, location_id, lead_hours, observed)"
    )
    body = f"SELECT *, (SELECT count(*) FROM sp WHERE is_train) AS train_rows FROM ({_evaluation_sql('variable')}) AS r"
    return on_ensemble(body, _EVAL, ctes)


@query(
    "blend_holdout",
    "META-17",
    "JN-08",
    sql=_holdout_sql(
        "SELECT *, forecast_issue_time <= (SELECT forecast_issue_time FROM (SELECT forecast_issue_time, row_number() OVER (ORDER BY forecast_issue_time) - 1 AS pos, "
        "count(*) OVER () AS n FROM sh) AS q WHERE pos = CAST(round_even((n - 1) * 0.5, 0) AS BIGINT)) AS is_train FROM sh"
    ),
)
def _(spark, sf):
    return blend.blend_holdout(joined(spark, sf), "load")


@query(
    "meta17_blend_holdout_positional",
    "META-17",
    sql=_holdout_sql(
        "SELECT *, row_number() OVER (ORDER BY forecast_issue_time, forecast_target_time, location_id, lead_hours) - 1 < CAST(floor(count(*) OVER () * 0.7) AS BIGINT) AS is_train FROM sh"
    ),
)
def _(spark, sf):
    return blend.blend_holdout(joined(spark, sf), "load", train_fraction=0.7, split="positional")


RULES = [
    regime.rule("season", "DJF", "load", ["view", "click"], ["error"]),
    regime.rule("region", "north", "load", ["signup", "retired_model"], ["view"]),
    regime.rule("storm", "any", "load", ["purchase"]),
]


@query(
    "meta18_regime_selection",
    "META-18",
    "JN-14",
    sql=on_ensemble(
        "SELECT location_id AS context_id, season, region, CASE WHEN season = 'DJF' AND region = 'north' THEN 'click,view,signup' WHEN season = 'DJF' THEN 'click,view' WHEN region = 'north' THEN 'signup' "
        "ELSE (SELECT arg_min(model, (value, model)) FROM en WHERE metric_type = 'mae') END AS selected, "
        "CASE WHEN season = 'DJF' AND region = 'north' THEN 'error,view' WHEN season = 'DJF' THEN 'error' WHEN region = 'north' THEN 'view' ELSE '' END AS excluded, "
        "CAST(coalesce(season = 'DJF', FALSE)::INT + coalesce(region = 'north', FALSE)::INT AS INT) AS rules_applied FROM (SELECT DISTINCT location_id, CASE WHEN latitude >= 52.5 THEN 'north' WHEN latitude >= 51 THEN 'south' END AS region FROM ens_forecasts) AS l, "
        "(VALUES ('DJF'), ('JJA'), (NULL)) AS s(season)",
        "",
        ENTRIES,
    ),
)
def _(spark, sf):
    places = ensemble_forecasts(spark, sf).select("location_id", "latitude").distinct()
    asked = places.select(
        F.col("location_id").alias("context_id"),
        F.lit("load").alias("variable"),
        F.explode(F.array(F.lit("DJF"), F.lit("JJA"), F.lit(None))).alias("season"),
        F.when(F.col("latitude") >= 52.5, "north").when(F.col("latitude") >= 51, "south").alias("region"),
    )
    pool = ["click", "error", "purchase", "signup", "view"]
    out = regime.select_models(asked, regime.rule_table(spark, RULES), pool, entries(spark, sf))
    return out.select(
        "context_id",
        "season",
        "region",
        F.array_join("selected_models.model", ",").alias("selected"),
        F.array_join("excluded_models", ",").alias("excluded"),
        "rules_applied",
    )
