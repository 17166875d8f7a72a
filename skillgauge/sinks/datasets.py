"""Metric, event, report and statistics outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.events import EventCatalog, event_rows
from ..operators.metrics import metrics_by_grouping_sets
from ..operators.quality import severity_totals
from ..schemas import EVENTS, METRICS

# Groupings that a dataset precomputes.
METRIC_GROUPS = (("lead_hours",), ("season",), ("month",), ("model",))


def write_verification(df: DataFrame, path: str) -> None:
    """Partitioned by model and target month; hot partitions are split over writers."""
    rows = df.withColumns({"year": F.year("forecast_target_time"), "month": F.month("forecast_target_time")})
    rows.hint("rebalance", "model", "year", "month").write.mode("overwrite").partitionBy("model", "year", "month").parquet(path)


def write_metrics(df: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """Metric rows by variable, and next to them one run record (time, rows, group-by, extras)."""
    df.write.mode("overwrite").partitionBy("variable").parquet(path)
    dims = [c for c in df.columns if c not in ("variable", "metric_name", "metric_value", "sample_size", "total_rows", "missing_count")]
    stored = df.sparkSession.read.parquet(path)
    extras = [F.lit(str(v)).alias(k) for k, v in (metadata or {}).items()]
    record = stored.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.current_timestamp().alias("written_at"), "row_count", F.lit(",".join(dims)).alias("group_by"), *extras
    )
    record.write.mode("append").json(f"{path.rstrip('/')}_runs")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_by_event(df: DataFrame, path: str) -> None:
    """Contingency, score or event tables in one folder per event."""
    df.write.mode("overwrite").partitionBy("event_name").parquet(path)


def ingest_log(batch: DataFrame, data_type: str, time_col: str, rows_skipped: int = 0) -> DataFrame:
    """One log record per model of a batch: date range and row count."""
    model = F.col("model") if "model" in batch.columns else F.lit(None).cast("string")
    return batch.groupBy(model.alias("model")).agg(
        F.to_date(F.min(time_col)).alias("start_date"),
        F.to_date(F.max(time_col)).alias("end_date"),
        F.count(F.lit(1)).alias("rows_downloaded"),
    ).select(
        F.current_timestamp().alias("timestamp"),
        F.lit(data_type).alias("type"),
        "model",
        "start_date",
        "end_date",
        "rows_downloaded",
        F.lit(rows_skipped).cast("bigint").alias("rows_skipped"),
    )


def append_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def save_validation_report(issues: DataFrame, path: str) -> None:
    """Issues and per-severity totals as JSON folders; the totals come from the written issues, so checks run once."""
    issues.write.mode("overwrite").json(f"{path}/issues")
    written = issues.sparkSession.read.schema(issues.schema).json(f"{path}/issues")
    severity_totals(written).write.mode("overwrite").json(f"{path}/totals")


def build_metrics(verification: DataFrame, path: str, variables, metrics=METRICS) -> None:
    """All precomputed groupings from one pass, stored by variable and grouping."""
    table = metrics_by_grouping_sets(verification, METRIC_GROUPS, variables, metrics)
    table.write.mode("overwrite").partitionBy("variable", "grouping").parquet(path)


def build_events(verification: DataFrame, path: str, catalog: EventCatalog = EVENTS, only_events: bool = False) -> None:
    """Event rows of every event and side, stored by both."""
    rows = event_rows(verification, catalog, only_events)
    rows.hint("rebalance", "event_name", "source").write.mode("overwrite").partitionBy("event_name", "source").parquet(path)


def dataset_statistics(forecasts: DataFrame, observations: DataFrame, verification: DataFrame, events: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: row counts of the three tables, names of stored events and metric groupings."""
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    names = lambda df, c: df.agg(F.array_sort(F.collect_set(c))).scalar()
    row = verification.agg(F.count(F.lit(1)).alias("verification_rows"))
    return row.select(
        count(forecasts).alias("forecast_rows"),
        count(observations).alias("observation_rows"),
        "verification_rows",
        names(events, "event_name").alias("event_datasets"),
        names(metrics, "grouping").alias("metric_groups"),
    )
