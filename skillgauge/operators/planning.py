"""Completeness: which runs and which location-months ought to be there and are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import slug
from ..functions.temporal import month_chunks
from ..schemas import FORECAST_HOURS, ISSUE, LEAD, MODEL, RUN_CYCLES


def expected_runs(models: DataFrame, start: str, end: str, cycles=RUN_CYCLES, default_hours=(0,), interval_days: int = 1) -> DataFrame:
    """Issue times every model should have: (model, forecast_issue_time).

    `models` has one row per model; its run hours come from `cycles`, otherwise
    from `default_hours`.
    """
    if interval_days < 1:
        raise ValueError("interval_days must be >= 1")
    hours = F.array(*[F.lit(h) for h in default_hours])
    known = F.create_map(*[x for m, hs in cycles.items() for x in (F.lit(m), F.array(*[F.lit(h) for h in hs]))]) if cycles else None
    if known is not None:
        hours = F.coalesce(F.try_element_at(known, F.col(MODEL)), hours)
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.make_interval(days=F.lit(interval_days)))
    rows = models.select(MODEL).distinct().select(MODEL, F.explode(days).alias("_day"), hours.alias("_hours"))
    rows = rows.select(MODEL, "_day", F.explode("_hours").alias("_hour"))
    return rows.select(MODEL, (F.col("_day").cast("timestamp") + F.make_dt_interval(hours=F.col("_hour"))).alias(ISSUE))


def missing_runs(expected: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Expected runs without a single loaded row."""
    return expected.join(forecasts.select(MODEL, ISSUE).distinct(), [MODEL, ISSUE], "left_anti")


def horizon_of(model: Column, horizons=FORECAST_HOURS, default: int | None = None) -> Column:
    """Hours that a model's runs reach ahead; null for a model that is not known and has no default."""
    known = F.create_map(*[F.lit(x) for pair in horizons.items() for x in pair])
    return F.coalesce(F.try_element_at(known, model), F.lit(default).cast("int"))


def missing_leads(forecasts: DataFrame, run=(MODEL, ISSUE), step: int = 1, horizons=FORECAST_HOURS, default: int | None = None) -> DataFrame:
    """Lead hours that a run should have and has not, as intervals: run, first_missing, last_missing, missing.

    A run should have the leads 0, step, 2 step ... up to its model's horizon. The gaps lie
    between neighbouring leads that are there, found by arithmetic, so expected leads are never spelled out.
    Leads off the step, outside the horizon or null count as absent, as do models without a horizon. A run's
    distinct leads, a few hundred at most, are ordered in one place; runs without any row are in `missing_runs`.
    """
    run, lead = list(run), F.col(LEAD)
    end = (F.floor(F.col("_horizon") / step) * step).cast("int")
    rows = forecasts.withColumn("_horizon", horizon_of(F.col(MODEL), horizons, default)).where(F.col("_horizon").isNotNull())
    there = F.when((lead >= 0) & (lead <= F.col("_horizon")) & (lead % step == 0), lead)
    held = rows.groupBy(*run, "_horizon", there.cast("int").alias("_lead")).agg(F.lit(1).alias("_one")).drop("_one")
    # Every run gets an end mark one step beyond its horizon; before its first lead lies -step.
    marks = held.select(*run, "_horizon").distinct().withColumn("_lead", end + step)
    both = held.where(F.col("_lead").isNotNull()).unionByName(marks)
    along = Window.partitionBy(*run).orderBy("_lead")
    gaps = both.withColumn("_before", F.coalesce(F.lag("_lead").over(along), F.lit(-step)))
    gaps = gaps.where(F.col("_lead") - F.col("_before") > step)
    return gaps.select(
        *run,
        (F.col("_before") + step).cast("int").alias("first_missing"),
        (F.col("_lead") - step).cast("int").alias("last_missing"),
        F.expr(f"CAST((_lead - _before) div {step} - 1 AS BIGINT)").alias("missing"),
    )


# Prefix of a task id per kind of data.
KIND_PREFIX = {"observations": "obs", "previous_runs": "prev", "historical_forecast": "histfc"}


def coverage_plan(
    locations: DataFrame, models: list[str], start: str, end: str, kinds=("observations", "previous_runs"), lead_days=tuple(range(1, 8)), months: int = 1
) -> DataFrame:
    """One task row per location, month chunk, kind and (except observations) model.

    `locations` has name, latitude, longitude.
    """
    unknown = set(kinds) - set(KIND_PREFIX)
    if unknown:
        raise ValueError(f"unknown kinds {sorted(unknown)}")
    wanted = []
    for kind in kinds:
        for model in [None] if kind == "observations" else models:
            wanted.append(F.struct(F.lit(kind).alias("kind"), F.lit(model).cast("string").alias(MODEL)))
    chunks = month_chunks(F.lit(start).cast("date"), F.lit(end).cast("date"), months)
    rows = locations.select("*", F.inline(chunks))
    rows = rows.select("*", F.inline(F.array(*wanted)))
    prefix = F.create_map(*[F.lit(x) for pair in KIND_PREFIX.items() for x in pair])
    days = F.when(F.col("kind") == "previous_runs", F.lit(",".join(map(str, lead_days))))
    task = F.concat_ws(
        ":", prefix[F.col("kind")], slug(F.col("name")), MODEL, F.col("chunk_start").cast("string"), F.col("chunk_end").cast("string"), days
    )
    return rows.withColumns({"location_id": slug(F.col("name")), "task_id": task})


def single_run_plan(locations: DataFrame, models: list[str], start: str, end: str, run_hours=(0,), interval_days: int = 1) -> DataFrame:
    """One task row per location, model and run time."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.make_interval(days=F.lit(interval_days)))
    runs = F.array(*[F.struct(F.lit(m).alias(MODEL), F.lit(h).alias("_hour")) for m in models for h in run_hours])
    rows = locations.select("*", F.explode(days).alias("_day")).select("*", F.inline(runs))
    issue = F.col("_day").cast("timestamp") + F.make_dt_interval(hours=F.col("_hour"))
    rows = rows.withColumns({"location_id": slug(F.col("name")), ISSUE: issue}).drop("_day", "_hour")
    stamp = F.date_format(ISSUE, "yyyy-MM-dd'T'HH:mm:ssXXX")
    return rows.withColumn("task_id", F.concat_ws(":", F.lit("single"), "location_id", MODEL, stamp))


def remaining_tasks(plan: DataFrame, log: DataFrame) -> DataFrame:
    """Tasks without a successful log record."""
    done = log.where((F.col("status") == "success") & F.col("task_id").isNotNull()).select("task_id").distinct()
    return plan.join(done, "task_id", "left_anti")


def uncovered(plan: DataFrame, inventory: DataFrame) -> DataFrame:
    """Tasks with a month that has no stored row, and those months (their first days) in `missing_months`.

    `inventory` has location_id, model, year, month; stored observations have a
    null model there, like the tasks that ask for them.
    """
    first = F.trunc("chunk_start", "month")
    months = plan.select("task_id", "location_id", MODEL, F.explode(F.sequence(first, F.col("chunk_end"), F.expr("INTERVAL 1 MONTH"))).alias("_month"))
    have = inventory.select(F.col("location_id").alias("_l"), F.col(MODEL).alias("_m"), F.make_date("year", "month", F.lit(1)).alias("_d")).distinct()
    on = (F.col("location_id") == F.col("_l")) & F.col(MODEL).eqNullSafe(F.col("_m")) & (F.col("_month") == F.col("_d"))
    missing = months.join(have, on, "left_anti").groupBy("task_id").agg(F.array_sort(F.collect_set("_month")).alias("missing_months"))
    return plan.join(missing, "task_id")
