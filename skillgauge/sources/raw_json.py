"""Raw hourly documents (parallel arrays) to forecast and observation rows.

A document is `{latitude, longitude, elevation, hourly: {time: [...], v: [...], ...}}`,
one per line or file. Schemas are explicit; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import haversine_km
from ..functions.temporal import lead_hours
from ..schemas import ELEV, ISSUE, LAT, LEAD, LOCATION, LON, MODEL, OBS_TIME, TARGET


def response_schema(array_names, extra: list[T.StructField] | None = None) -> T.StructType:
    hourly = [T.StructField("time", T.ArrayType(T.StringType()))]
    hourly += [T.StructField(n, T.ArrayType(T.DoubleType())) for n in array_names]
    place = [T.StructField(n, T.DoubleType()) for n in (LAT, LON, ELEV)]
    return T.StructType([*place, T.StructField("hourly", T.StructType(hourly)), *(extra or [])])


def read_responses(spark: SparkSession, path: str, array_names, extra=None) -> DataFrame:
    return spark.read.schema(response_schema(array_names, extra)).json(path)


def _hourly_fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema["hourly"].dataType.fields]


def lengths_match(df: DataFrame) -> Column:
    """Every hourly array present in the document is as long as `time`."""
    expected = F.size("hourly.time")
    checks = [
        F.col(f"hourly.{n}").isNull() | (F.size(f"hourly.{n}") == expected)
        for n in _hourly_fields(df)
        if n != "time"
    ]
    ok = F.lit(True)
    for check in checks:
        ok = ok & check
    return F.coalesce(ok, F.lit(False))


def timestamps_valid() -> Column:
    """Non-empty, all parseable, no duplicates."""
    times = F.col("hourly.time")
    parsed = F.transform(times, lambda t: F.try_to_timestamp(t))
    ok = (F.size(times) > 0) & ~F.exists(parsed, lambda t: t.isNull()) & (F.size(F.array_distinct(parsed)) == F.size(times))
    return F.coalesce(ok, F.lit(False))


def displacement_km() -> Column:
    """Distance from the requested to the returned point."""
    return haversine_km("requested_latitude", "requested_longitude", LAT, LON)


def document_checks(df: DataFrame, max_km: float = 50.0) -> DataFrame:
    """Add `reject_reason`: null for usable documents, otherwise the first failed rule."""
    reason = F.when(F.col("hourly.time").isNull(), "missing_time")
    reason = reason.when(~lengths_match(df), "array_length").when(~timestamps_valid(), "timestamps")
    if {"requested_latitude", "requested_longitude"} <= set(df.columns):
        limit = F.col("max_grid_distance_km") if "max_grid_distance_km" in df.columns else F.lit(max_km)
        usable = F.col(LAT).isNotNull() & F.col(LON).isNotNull()
        df = df.withColumn("location_distance_km", displacement_km())
        reason = reason.when(~usable, "missing_coordinates").when(F.col("location_distance_km") > limit, "too_far")
    return df.withColumn("reject_reason", reason)


def split_documents(df: DataFrame, max_km: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """(usable, quarantined) documents."""
    checked = document_checks(df, max_km)
    good = checked.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return good, checked.where(F.col("reject_reason").isNotNull())


def _zip(columns: dict[str, Column]) -> Column:
    """Array of structs from parallel arrays, with the given field names; a missing array is all null."""
    names = list(columns)
    present = [F.coalesce(columns[n], F.array()).alias(n) for n in names]
    zipped = F.arrays_zip(*present)
    return F.transform(zipped, lambda z: F.struct(*[z.getField(n).alias(n) for n in names]))


def _exploded(df: DataFrame, values: dict[str, Column | None]) -> DataFrame:
    """One row per hour with column `_time` and one double column per entry of `values`."""
    present = {name: column for name, column in values.items() if column is not None}
    keep = [c for c in df.columns if c != "hourly"]
    arrays = {"_time": F.col("hourly.time"), **present}
    rows = df.select(*keep, F.explode(_zip(arrays)).alias("_h"))
    out = [F.to_timestamp("_h._time").alias("_time")]
    for name in values:
        source = F.col(f"_h.{name}") if name in present else F.lit(None)
        out.append(source.cast("double").alias(name))
    return rows.select(*keep, *out)


def observations(df: DataFrame, variables) -> DataFrame:
    """One observation row per hour; variables the document lacks are null columns."""
    fields = set(_hourly_fields(df))
    rows = _exploded(df, {v: F.col(f"hourly.{v}") if v in fields else None for v in variables})
    return rows.withColumnRenamed("_time", OBS_TIME)


def forecasts(df: DataFrame, variables, issue_col: str = ISSUE, model_col: str = MODEL) -> DataFrame:
    """One forecast row per hour of one model run; the run's issue time and model are columns."""
    fields = set(_hourly_fields(df))
    rows = _exploded(df, {v: F.col(f"hourly.{v}") if v in fields else None for v in variables})
    rows = rows.withColumnsRenamed({"_time": TARGET, issue_col: ISSUE, model_col: MODEL})
    return rows.withColumn(LEAD, lead_hours(ISSUE, TARGET))


def lead_day_names(variable: str, day: int) -> list[str]:
    """Array names that may hold `variable` at lead `day`, best first (day 0 may be plain)."""
    # Spellings of a lead day in an array name.
    plain = [variable] if day == 0 else []
    suffixed = [f"{variable}_previous_day{day}", f"{variable}_previous_day_{day}", f"{variable}_day{day}"]
    return plain + suffixed


def previous_runs(df: DataFrame, variables, lead_days=tuple(range(1, 8))) -> DataFrame:
    """Fixed-lead forecasts whose lead day is part of the array name.

    Each day's issue time is target minus 24 hours per day. A day for which a
    document holds none of the variables yields no rows for that document.
    """
    fields = set(_hourly_fields(df))
    keep = [c for c in df.columns if c != "hourly"]
    per_day = []
    for day in lead_days:
        sources = {v: [F.col(f"hourly.{n}") for n in lead_day_names(v, day) if n in fields] for v in variables}
        if not any(sources.values()):
            continue
        arrays = {v: F.coalesce(*cols) for v, cols in sources.items() if cols}
        usable = F.lit(False)
        for column in arrays.values():
            usable = usable | column.isNotNull()
        packed = _hours_of_day(day, arrays, variables)
        per_day.append(F.when(usable, packed).otherwise(F.array().cast(_hour_array(variables))))
    if not per_day:
        raise ValueError("no lead day of any variable is present")
    rows = df.select(*keep, F.explode(F.concat(*per_day)).alias("_h"))
    target = F.to_timestamp("_h._time")
    return rows.select(
        *keep,
        (target - F.make_dt_interval(hours=F.col("_h.day") * 24)).alias(ISSUE),
        target.alias(TARGET),
        (F.col("_h.day") * 24).cast("int").alias(LEAD),
        *[F.col(f"_h.{v}").alias(v) for v in variables],
    )


def _hours_of_day(day: int, arrays: dict[str, Column], variables) -> Column:
    """Array of (day, time, variables) of one lead day."""

    def hour(h: Column) -> Column:
        values = [(h[v] if v in arrays else F.lit(None)).cast("double").alias(v) for v in variables]
        return F.struct(F.lit(day).alias("day"), h["_time"].alias("_time"), *values)

    return F.transform(_zip({"_time": F.col("hourly.time"), **arrays}), hour)


def _hour_array(variables) -> T.ArrayType:
    fields = [T.StructField("day", T.IntegerType()), T.StructField("_time", T.StringType())]
    return T.ArrayType(T.StructType(fields + [T.StructField(v, T.DoubleType()) for v in variables]))


def with_location(df: DataFrame, requests: DataFrame, key: str = "request_id") -> DataFrame:
    """Attach location id, name, requested point and extras of each request."""
    return df.join(requests, key, "left")


def request_columns(name: Column, latitude: Column, longitude: Column, slug: Column) -> list[Column]:
    return [
        slug.alias(LOCATION),
        name.alias("location_name"),
        latitude.alias("requested_latitude"),
        longitude.alias("requested_longitude"),
    ]
