"""Structured Streaming forms of ingest, dedup, metrics, alignment and outage sessions.

The transformations take streaming (or static) DataFrames; `run_append` and
`run_update` drive them to the end of the available input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ISSUE, LOCATION, MODEL, OBS_TIME, TARGET
from ..session import materialize


def read_files(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", pattern: str | None = None) -> DataFrame:
    """Files of a folder as a stream; new drops are picked up by later triggers."""
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder)


def distinct_forecasts(stream: DataFrame, late: str = "2 days", key=(ISSUE, TARGET, MODEL, LOCATION)) -> DataFrame:
    """First row of each key among rows at most `late` behind, for append mode; `latest_forecasts` keeps the last."""
    return stream.withWatermark(TARGET, late).dropDuplicatesWithinWatermark(list(key))


def latest_forecasts(stream: DataFrame, order: str, late: str = "2 days", key=(ISSUE, TARGET, MODEL, LOCATION)) -> DataFrame:
    """The row of each key that is last by `order`, for update mode: a key appears again whenever a newer row of it has come.

    The state of a key is one row and goes once the watermark has passed its target. Run with
    `run_update`, which keeps what each key had last; a later row that comes before that wins, whatever batch or run it is in.
    """
    columns = [c for c in stream.columns if c not in key]
    whole = F.struct(*columns)
    # Of rows with equal order the greatest wins, so that every run agrees.
    last = F.max(F.struct(F.col(order).alias("_order"), whole.alias("_row"))).alias("_last")
    return stream.withWatermark(TARGET, late).groupBy(*key).agg(last).select(*key, "_last._row.*")


def rolling_metrics(stream: DataFrame, error: str, time: str, length: str, slide: str | None = None, by=(), late: str = "2 days") -> DataFrame:
    """MAE, RMSE, bias and count per (sliding) time window."""
    e = F.col(error)
    span = F.window(time, length, slide) if slide else F.window(time, length)
    grouped = stream.withWatermark(time, late).groupBy(span.alias("window"), *by)
    stats = grouped.agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("bias"),
        F.count(e).alias("sample_size"),
    )
    return stats.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "mae", "rmse", "bias", "sample_size"
    )


def align_streams(forecasts: DataFrame, observations: DataFrame, variables, late: str = "2 days") -> DataFrame:
    """Left outer join of two streams on target = observation time and location.

    Unmatched forecasts appear once the watermark has passed their target, so
    state never outlives the allowed lateness.
    """
    f = forecasts.withWatermark(TARGET, late)
    o = observations.select(
        OBS_TIME, F.col(LOCATION).alias("_o_location"), *[F.col(v).alias(f"observed_{v}") for v in variables]
    ).withWatermark(OBS_TIME, late)
    f = f.withColumnsRenamed({v: f"forecast_{v}" for v in variables})
    on = (F.col(LOCATION) == F.col("_o_location")) & (F.col(TARGET) == F.col(OBS_TIME))
    joined = f.join(o, on, "leftOuter").drop("_o_location")
    return joined.withColumns({f"{v}_error": F.col(f"forecast_{v}") - F.col(f"observed_{v}") for v in variables})


def report_sessions(stream: DataFrame, keys, time: str, gap: str = "90 minutes", late: str = "2 days") -> DataFrame:
    """Uninterrupted reporting spells per key; the time between two spells is an outage."""
    grouped = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), *keys)
    counted = grouped.agg(F.count(F.lit(1)).alias("reports"))
    return counted.select(*keys, F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), "reports")


def run_sessions(stream: DataFrame, keys, time: str, path: str, checkpoint: str, gap: str = "90 minutes", late: str = "2 days") -> DataFrame:
    """Reporting spells as they stand: closed ones for good, and those still open, flagged.

    Session windows allow no update mode, so spells are merged batch by batch. A batch's own spells
    join the open ones of the batch before; a spell is closed once the newest time seen is
    `late` past its end, and reports older than that are dropped, as the watermark would. Only open spells are carried on. Each
    batch writes folders of its own, so a repeated batch changes nothing and a restart goes on with the last.
    """
    keys, columns = list(keys), [*keys, "session_start", "session_end", "reports", "newest"]
    spark = stream.sparkSession

    def folder(kind: str, batch_id: int) -> str:
        return f"{path}/{kind}/batch_id={batch_id}"

    def store(batch: DataFrame, batch_id: int) -> None:
        span = F.session_window(time, gap)
        held = batch.where(F.col(time).isNotNull())
        old = spark.read.parquet(folder("open", batch_id - 1)) if batch_id else None
        seen = F.lit(None).cast("timestamp")
        if old is not None:
            seen = F.lit(old.agg(F.max("newest")).first()[0]).cast("timestamp")
            held = held.where(seen.isNull() | (F.col(time) + F.expr(f"INTERVAL {gap}") > seen - F.expr(f"INTERVAL {late}")))
        spells = held.groupBy(span.alias("s"), *keys).agg(F.count(F.lit(1)).alias("reports"), F.max(time).alias("newest"))
        spells = spells.select(*keys, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "reports", "newest")
        if old is not None:
            spells = spells.unionByName(old.where("reports IS NOT NULL").select(*columns))
        # A spell is an event at its start that lasts until its end; those that overlap are one.
        seconds = ((F.unix_micros("session_end") - F.unix_micros("session_start")) / 1_000_000).cast("decimal(18,6)")
        whole = F.session_window("session_start", F.make_interval(secs=seconds))
        merged = spells.groupBy(whole.alias("s"), *keys).agg(F.sum("reports").alias("reports"), F.max("newest").alias("newest"))
        merged = merged.select(*keys, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "reports", "newest")
        merged = materialize(merged, "spells")
        newest = F.greatest(seen, F.lit(merged.agg(F.max("newest")).first()[0]).cast("timestamp"))
        done = F.coalesce(F.col("session_end") <= newest - F.expr(f"INTERVAL {late}"), F.lit(False))
        merged.where(done).write.mode("overwrite").parquet(folder("closed", batch_id))
        # The newest time is kept in a row of its own, also where no spell is open.
        mark = spark.range(1).select(*[F.lit(None).cast(merged.schema[c].dataType).alias(c) for c in columns[:-1]], newest.alias("newest"))
        merged.where(~done).unionByName(mark).write.mode("overwrite").parquet(folder("open", batch_id))

    run_batches(stream, store, checkpoint)
    closed = spark.read.parquet(f"{path}/closed").drop("batch_id").withColumn("is_open", F.lit(False))
    opened = spark.read.parquet(f"{path}/open")
    last = opened.agg(F.max("batch_id")).scalar()
    opened = opened.where((F.col("batch_id") == last) & F.col("reports").isNotNull()).drop("batch_id").withColumn("is_open", F.lit(True))
    return closed.unionByName(opened).drop("newest")


def run_append(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run over all available input into Parquet; returns the stored rows."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_update(stream: DataFrame, path: str, checkpoint: str, keys) -> DataFrame:
    """Run in update mode, one folder per micro-batch; returns the newest row of every key.

    A repeated batch overwrites its own folder, so retries never add rows.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    run_batches(stream, store, checkpoint, "update")
    columns = stream.columns
    stored = stream.sparkSession.read.parquet(path)
    newest = F.max_by(F.struct(*[c for c in columns if c not in keys]), "batch_id").alias("_s")
    return stored.groupBy(*keys).agg(newest).select(*keys, "_s.*")


def run_batches(stream: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Hand every micro-batch of the available input to `store` (e.g. an upsert)."""
    query = (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
