"""Data-quality checks. Every check is a table of issues: severity, check, message, count."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.temporal import hours_between, lead_hours
from ..schemas import (
    ISSUE,
    LAT,
    LEAD,
    LOCATION,
    LON,
    MODEL,
    OBS_TIME,
    PLAUSIBLE_RANGES,
    TARGET,
    forecast_var,
    observed_var,
)
from ..session import literal_table, materialize
from .sequence import gap_summary

# Accepted lead range in hours and sanity limits of metric tables.
MIN_LEAD, MAX_LEAD = 0, 720
SPARSE_SHARE = 0.9
RMSE_TO_MAE = 100.0
RMSE_LIMIT_TEMPERATURE, RMSE_LIMIT_OTHER = 1000.0, 10000.0


def _issue(check: str, count: Column, severity: Column, bad: Column, good: str) -> Column:
    return F.struct(
        severity.alias("severity"),
        F.lit(check).alias("check"),
        F.when(count > 0, bad).otherwise(F.lit(good)).alias("message"),
        count.cast("bigint").alias("count"),
    )


def _level(count: Column, severity: str) -> Column:
    return F.when(count > 0, F.lit(severity)).otherwise(F.lit("info"))


def _issues(row: DataFrame, *issues: Column) -> DataFrame:
    return row.select(F.inline(F.array(*issues)))


def all_issues(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def provenance_key(df: DataFrame) -> list[str]:
    """Issue, target, model and, for data with locations, the location identity."""
    key = [ISSUE, TARGET, MODEL]
    if LOCATION in df.columns:
        return [*key, LOCATION]
    return [*key, *[c for c in (LAT, LON) if c in df.columns]]


def duplicate_rows(df: DataFrame, key, keep_first: bool = True) -> DataFrame:
    """One row `count`: rows beyond the first of their key, or all rows of repeated keys."""
    return _repeats(df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")), keep_first)


def _repeats(sizes: DataFrame, keep_first: bool = True) -> DataFrame:
    extra = F.col("_n") - 1 if keep_first else F.col("_n")
    return sizes.where(F.col("_n") > 1).agg(F.coalesce(F.sum(extra), F.lit(0)).alias("count"))


def check_provenance(df: DataFrame, key=None) -> DataFrame:
    return _issues(duplicate_rows(df, key or provenance_key(df)), _provenance_issue())


def _provenance_issue() -> Column:
    n = F.col("count")
    bad = F.concat(n.cast("string"), F.lit(" rows share the provenance key of an earlier row"))
    return _issue("provenance_uniqueness", n, _level(n, "error"), bad, "every forecast row has its own provenance key")


def provenance_violations(df: DataFrame, key=None) -> DataFrame:
    """One row: rows of repeated keys, inconsistent leads (more than 1 h off), negative leads."""
    expected = lead_hours(ISSUE, TARGET)
    rules = df.groupBy(*(key or provenance_key(df))).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.abs(F.col(LEAD) - expected) > 1).alias("_off"),
        F.count_if(F.col(LEAD) < 0).alias("_neg"),
    )
    return rules.agg(
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum("_off"), F.lit(0)).alias("inconsistent_leads"),
        F.coalesce(F.sum("_neg"), F.lit(0)).alias("negative_leads"),
    )


def require_provenance(df: DataFrame, key=None) -> DataFrame:
    """`df` unchanged, or an error naming the violations (one small row reaches the driver)."""
    row = provenance_violations(df, key).first()
    found = {k: v for k, v in row.asDict().items() if v}
    if found:
        raise ValueError(f"provenance violated: {found}")
    return df


def check_missing_observations(df: DataFrame) -> DataFrame:
    return _issues(df.agg(*_missing_counts()), _missing_issue())


def _missing_counts() -> list[Column]:
    return [*_counts(_missing_flags()), F.count(F.lit(1)).alias("total")]


def _missing_flags() -> dict[str, Column]:
    return {"missing": F.col(OBS_TIME).isNull()}


def _counts(flags: dict[str, Column]) -> list[Column]:
    return [F.count_if(flag).alias(name) for name, flag in flags.items()]


def _missing_issue() -> Column:
    n = F.col("missing")
    share = F.coalesce(F.try_divide(n * 100.0, F.col("total").cast("double")), F.lit(0.0))
    severity = F.when(share > 50, "error").when(share > 10, "warning").otherwise("info")
    bad = F.format_string("%d of %d forecasts (%.1f%%) have no observation", n, F.col("total"), share)
    return _issue("missing_observations", n, severity, bad, "every forecast has an observation")


def _row_hash(df: DataFrame) -> list[Column]:
    """128 bits of a whole row in two columns; which columns are null is hashed too, as the hash itself skips nulls."""
    parts = [F.col(c) for c in df.columns] + [F.isnull(c) for c in df.columns]
    return [F.xxhash64(*parts).alias("_h1"), F.xxhash64(F.lit(1), *parts).alias("_h2")]


def check_duplicate_observations(df: DataFrame) -> DataFrame:
    """Fully repeated matched rows are errors; otherwise more than 100 rows per observation time warns.

    Copies are known by 128-bit hashes of their rows, so no other column is shuffled.
    """
    return _copies(df.select(OBS_TIME, *_row_hash(df)).groupBy(OBS_TIME, "_h1", "_h2").agg(F.count(F.lit(1)).alias("_n")))


def _copies(rows: DataFrame) -> DataFrame:
    """The issue of `check_duplicate_observations` from counted rows, one for each row hash: observation time, `_n`."""
    per_time = rows.groupBy(OBS_TIME).agg(F.sum("_n").alias("_rows"), F.sum(F.when(F.col("_n") > 1, F.col("_n"))).alias("_d"))
    timed = F.col(OBS_TIME).isNotNull()
    row = per_time.agg(
        F.coalesce(F.sum(F.when(timed, F.col("_d"))), F.lit(0)).alias("n"),
        F.count_if(timed).alias("times"),
        F.sum("_rows").alias("total"),
    )
    n, ratio = F.col("n"), F.try_divide(F.col("total").cast("double"), F.col("times").cast("double"))
    severity = F.when(n > 0, "error").when(ratio > 100, "warning").otherwise("info")
    message = (
        F.when(n > 0, F.concat(n.cast("string"), F.lit(" matched rows are exact copies")))
        .when(ratio > 100, F.format_string("%.0f forecasts per distinct observation time", ratio))
        .otherwise("no duplicate observations")
    )
    return row.select(severity.alias("severity"), F.lit("duplicate_observations").alias("check"), message.alias("message"), n.alias("count"))


def check_lead_times(df: DataFrame) -> DataFrame:
    return _issues(df.agg(*_lead_counts()), _lead_issue())


def _lead_counts() -> list[Column]:
    return _counts(_lead_flags())


def _lead_flags() -> dict[str, Column]:
    return {"low": F.col(LEAD) < MIN_LEAD, "high": F.col(LEAD) > MAX_LEAD}


def _lead_issue() -> Column:
    n = F.col("low") + F.col("high")
    bad = F.format_string(f"%d lead_hours below {MIN_LEAD}, %d above {MAX_LEAD}", F.col("low"), F.col("high"))
    return _issue("lead_times", n, _level(n, "error"), bad, "all lead_hours are in range")


def check_timestamp_gaps(df: DataFrame) -> DataFrame:
    row = gap_summary(df)
    n = F.col("gaps")
    bad = F.format_string("%d gaps over 1.5 h at %d location(s)", n, F.col("keys_with_gaps"))
    return _issues(row, _issue("timestamp_gaps", n, _level(n, "warning"), bad, "no observation gaps"))


def _ranged_columns(df: DataFrame, variables, ranges) -> list[tuple[str, float, float]]:
    return [
        (side(v), *ranges[v])
        for v in variables
        if v in ranges
        for side in (forecast_var, observed_var)
        if side(v) in df.columns
    ]


def _range_counts(columns) -> list[Column]:
    return _counts(_range_flags(columns))


def _range_flags(columns) -> dict[str, Column]:
    return {f"_range{i}": (F.col(c) < lo) | (F.col(c) > hi) for i, (c, lo, hi) in enumerate(columns)}


def _range_issue(columns) -> Column:
    counts = [F.col(f"_range{i}") for i in range(len(columns))]
    n = sum(counts, F.lit(0))
    named = [
        F.when(k > 0, F.concat(k.cast("string"), F.lit(f" in {c} outside [{lo}, {hi}]")))
        for k, (c, lo, hi) in zip(counts, columns, strict=True)
    ]
    bad = F.concat(F.lit("implausible values: "), F.concat_ws("; ", *named))
    return _issue("value_ranges", n, _level(n, "error"), bad, "all values are physically plausible")


def range_violations(df: DataFrame, variables, ranges=PLAUSIBLE_RANGES) -> DataFrame:
    """Values outside their physical range per column, from one aggregate."""
    columns = _ranged_columns(df, variables, ranges)
    if not columns:
        raise ValueError("no variable with a known range")
    packed = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(float(lo)).alias("low"),
            F.lit(float(hi)).alias("high"),
            F.col(f"_range{i}").alias("violations"),
        )
        for i, (c, lo, hi) in enumerate(columns)
    ]
    return df.agg(*_range_counts(columns)).select(F.inline(F.array(*packed)))


def check_value_ranges(df: DataFrame, variables, ranges=PLAUSIBLE_RANGES) -> DataFrame:
    columns = _ranged_columns(df, variables, ranges)
    if not columns:
        raise ValueError("no variable with a known range")
    return _issues(df.agg(*_range_counts(columns)), _range_issue(columns))


def validate_verification(df: DataFrame, variables, ranges=PLAUSIBLE_RANGES, key=None) -> DataFrame:
    """All checks of the verification table as one issue table.

    All start from one grouping of keys, times, places, row hashes and the row-wise
    flags (which a row's hash fixes), so the table is read once and only those narrow
    columns are shuffled; the grouping is stored, as each check reads it.
    """
    columns = _ranged_columns(df, variables, ranges)
    flags = {**_missing_flags(), **_lead_flags(), **_range_flags(columns)}
    row_wise = [_missing_issue(), _lead_issue()]
    if columns:
        row_wise.append(_range_issue(columns))
    key = key or provenance_key(df)
    narrow = list(dict.fromkeys([*key, OBS_TIME, *[c for c in (LAT, LON, LOCATION) if c in df.columns]]))
    packed = F.array(*[F.coalesce(flag, F.lit(False)) for flag in flags.values()])
    grouped = df.select(*narrow, *_row_hash(df), packed.alias("_flags")).groupBy(*narrow, "_h1", "_h2", "_flags")
    rows = materialize(grouped.agg(F.count(F.lit(1)).alias("_n")), "counted-rows")
    named = [F.coalesce(F.sum(F.when(F.get("_flags", F.lit(i)), F.col("_n"))), F.lit(0)).alias(name) for i, name in enumerate(flags)]
    row = rows.agg(*named, F.coalesce(F.sum("_n"), F.lit(0)).alias("total"))
    parts = [
        _issues(_repeats(rows.groupBy(*key).agg(F.sum("_n").alias("_n"))), _provenance_issue()),
        _issues(row, *row_wise),
        _copies(rows),
        check_timestamp_gaps(rows),
    ]
    return all_issues(parts)


def written_with_checks(df: DataFrame, write: Callable[[DataFrame], None], variables, ranges=PLAUSIBLE_RANGES) -> DataFrame:
    """Hand `df` to `write` and collect the row-wise checks from the job that writes; returns their issues.

    Missing observations, lead times and value ranges are counted while the rows
    pass by, so checking costs no further read. Checks that compare rows with each other need a shuffle and stay
    in `validate_verification`. `write` must run one job over all rows: what it reads twice would be counted once only.
    """
    columns = _ranged_columns(df, variables, ranges)
    seen = Observation()
    write(df.observe(seen, *_missing_counts(), *_lead_counts(), *_range_counts(columns)))
    counts = seen.get
    row = literal_table(df.sparkSession, [tuple(counts.values())], ", ".join(f"{name} bigint" for name in counts))
    return _issues(row, _missing_issue(), _lead_issue(), *([_range_issue(columns)] if columns else []))


METRIC_FIXED = ("variable", "metric_name", "metric_value", "sample_size", "total_rows", "missing_count")


def validate_metrics(df: DataFrame) -> DataFrame:
    """Sanity of a long metric table: emptiness, sizes, repeated keys, sparse groups, absurd RMSE."""
    dims = [c for c in df.columns if c not in METRIC_FIXED]
    key = [*dims, "variable", "metric_name"]
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("sample_size") < 0).alias("negative"),
        F.count_if(F.col("sample_size") < SPARSE_SHARE * F.col("total_rows")).alias("sparse"),
    )
    rows, negative, sparse = F.col("rows"), F.col("negative"), F.col("sparse")
    empty = F.when(rows == 0, 1).otherwise(0)
    sizes = _issues(
        row,
        _issue("empty_output", empty, _level(empty, "warning"), F.lit("the metric table is empty"), "the metric table has rows"),
        _issue("negative_sample_size", negative, _level(negative, "error"), F.concat(negative.cast("string"), F.lit(" rows have a negative sample_size")), "no negative sample sizes"),
        _issue("nan_heavy_group", sparse, _level(sparse, "warning"), F.concat(sparse.cast("string"), F.lit(" groups miss more than 10% of their errors")), "no sparse groups"),
    )
    n = F.col("count")
    repeated = _issues(
        duplicate_rows(df, key),
        _issue("duplicate_key", n, _level(n, "error"), F.concat(n.cast("string"), F.lit(" rows repeat an aggregation key")), "no repeated keys"),
    )
    absurd = _issues(
        absurd_rmse(df),
        _issue("absurd_rmse", n, _level(n, "error"), F.concat(n.cast("string"), F.lit(" RMSE values are absurd")), "no absurd RMSE values"),
    )
    return all_issues([sizes, repeated, absurd])


def absurd_rmse(df: DataFrame) -> DataFrame:
    """One row `count`: groups with RMSE over 100 x MAE, plus RMSE values over the variable's limit."""
    dims = [c for c in df.columns if c not in METRIC_FIXED]
    metric = lambda name: F.max(F.when(F.col("metric_name") == name, F.col("metric_value")))
    pairs = df.groupBy(*dims, "variable").agg(metric("rmse").alias("rmse"), metric("mae").alias("mae"))
    limit = F.when(F.lower("variable").contains("temp"), RMSE_LIMIT_TEMPERATURE).otherwise(RMSE_LIMIT_OTHER)
    relative = (F.col("mae") != 0) & (F.col("rmse") > RMSE_TO_MAE * F.col("mae"))
    return pairs.agg((F.count_if(relative) + F.count_if(F.col("rmse") > limit)).alias("count"))


def validate_contingency(df: DataFrame) -> DataFrame:
    """Negative counts, counts above the total, heavy exclusion, empty groups."""
    counts = ("hits", "misses", "false_alarms", "correct_negatives")
    total = F.col("total_rows")
    used = sum((F.col(c) for c in counts), F.lit(0))
    negative = reduce(lambda a, b: a | b, [F.col(c) < 0 for c in (*counts, "excluded_nan")])
    row = df.agg(
        F.count_if(negative).alias("negative"),
        F.count_if(used + F.col("excluded_nan") > total).alias("overflow"),
        F.count_if((total > 0) & (F.col("excluded_nan") / total > 0.5)).alias("heavy"),
        F.count_if((total > 0) & (used == 0)).alias("empty"),
    )

    def issue(name, column, severity, bad, good):
        n = F.col(column)
        return _issue(name, n, _level(n, severity), F.concat(n.cast("string"), F.lit(bad)), good)

    return _issues(
        row,
        issue("negative_count", "negative", "error", " rows have a negative count", "no negative counts"),
        issue("count_overflow", "overflow", "error", " rows count more pairs than rows", "no count overflow"),
        issue("nan_heavy_group", "heavy", "warning", " groups exclude over half of their rows", "no heavy exclusion"),
        issue("empty_event_bucket", "empty", "warning", " groups have no valid pair", "no empty groups"),
    )


def validate_skill_scores(df: DataFrame) -> DataFrame:
    """Undefined scores per metric, and groups with more than half of their rows missing."""
    undefined = (
        df.where(F.col("metric_value").isNull())
        .groupBy("metric_name")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            F.lit("info").alias("severity"),
            F.concat(F.lit("undefined_"), "metric_name").alias("check"),
            F.concat(F.col("count").cast("string"), F.lit(" groups have an undefined "), "metric_name").alias("message"),
            "count",
        )
    )
    total = F.col("total_rows")
    row = df.agg(F.count_if((total > 0) & (F.col("missing_count") / total > 0.5)).alias("n"))
    n = F.col("n")
    heavy = _issues(row, _issue("nan_heavy_group", n, F.lit("warning"), F.concat(n.cast("string"), F.lit(" groups miss over half of their rows")), ""))
    return undefined.unionByName(heavy.where(F.col("count") > 0))


def severity_totals(issues: DataFrame) -> DataFrame:
    """Number of issues per severity; one row per severity that occurs."""
    return issues.groupBy("severity").agg(F.count(F.lit(1)).alias("issues"), F.sum("count").alias("affected_rows"))


def row_rules(df: DataFrame) -> dict[str, Column]:
    """Rule name -> violated? for single forecast rows; a missing lead is floored from the times."""
    filled = filled_lead(df)
    rules = {
        "negative_lead": filled < 0,
        "target_before_issue": F.col(TARGET) < F.col(ISSUE),
        "latitude_range": ~F.col(LAT).between(-90, 90),
        "longitude_range": ~F.col(LON).between(-180, 180),
    }
    return {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}


def filled_lead(df: DataFrame) -> Column:
    derived = F.floor(hours_between(ISSUE, TARGET)).cast("int")
    return F.coalesce(F.col(LEAD), derived) if LEAD in df.columns else derived


def row_rule_counts(df: DataFrame) -> DataFrame:
    """Violations per row rule."""
    rules = row_rules(df)
    row = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    packed = [F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules]
    return row.select(F.inline(F.array(*packed)))


def split_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) rows; quarantined rows carry their first violated rule."""
    reason = F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in row_rules(df).items()])
    marked = df.withColumns({LEAD: filled_lead(df), "violated_rule": reason})
    return marked.where(F.col("violated_rule").isNull()).drop("violated_rule"), marked.where(
        F.col("violated_rule").isNotNull()
    )
