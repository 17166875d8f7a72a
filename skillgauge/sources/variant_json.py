"""Raw hourly documents whose variables and lead days are found in the data, not given.

A document is kept as a VARIANT. One aggregate over all documents tells which
arrays and which plain fields they have between them; with those names the
documents take the shape that `raw_json` reads with a schema, so all of its checks and
readers apply. `long_hours` needs no names at all: it unfolds whatever arrays a
document has, in one pass.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ELEV, LAT, LON

# Spellings of a lead day at the end of an array name.
LEAD_DAY = r"^(.+?)(?:_previous_day_?|_day)([0-9]+)$"
PLACE = (LAT, LON, ELEV)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per line: `doc`, a VARIANT, null for a line that is no JSON; such lines are kept in `raw`."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    doc = F.try_parse_json("value")
    return lines.select(doc.alias("doc"), F.when(doc.isNull(), F.col("value")).alias("raw"))


def discovered(docs: DataFrame) -> tuple[list[str], list[str]]:
    """Names of the hourly arrays besides `time`, and of the other plain fields, over all documents; one row gets to the driver."""
    found = docs.agg(F.schema_of_variant_agg("doc").alias("s")).first()["s"]
    if not found or not found.startswith("OBJECT<"):
        return [], []
    fields = T.StructType.fromDDL("doc " + found.replace("OBJECT<", "STRUCT<"))["doc"].dataType.fields
    hourly = next((f.dataType for f in fields if f.name == "hourly"), None)
    arrays = [f.name for f in hourly.fields if f.name != "time"] if isinstance(hourly, T.StructType) else []
    nested = (T.StructType, T.ArrayType)
    return sorted(arrays), sorted(f.name for f in fields if f.name not in (*PLACE, "hourly") and not isinstance(f.dataType, nested))


def _at(*names: str) -> str:
    return "$" + "".join(f"['{n}']" for n in names)


def _array(*names: str, kind: str = "double"):
    return F.try_variant_get("doc", _at(*names), f"array<{kind}>")


def as_responses(docs: DataFrame, arrays: list[str], fields: list[str]) -> DataFrame:
    """The documents with columns: place, hourly arrays, and plain fields as text. An array that a document lacks is null."""
    hourly = F.struct(_array("hourly", "time", kind="string").alias("time"), *[_array("hourly", n).alias(n) for n in arrays])
    place = [F.try_variant_get("doc", _at(n), "double").alias(n) for n in PLACE]
    return docs.select(*place, hourly.alias("hourly"), *[F.try_variant_get("doc", _at(n), "string").alias(n) for n in fields])


def read_responses(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Documents in the shape of `raw_json.read_responses` and the names of their arrays, all found in the data."""
    docs = read_documents(spark, path)
    arrays, fields = discovered(docs)
    return as_responses(docs, arrays, fields), arrays


def lead_days(arrays: list[str]) -> tuple[list[str], list[int]]:
    """Variables and lead days that the array names spell; a name without a day is day 0."""
    parts = [(m.group(1), int(m.group(2))) if (m := re.match(LEAD_DAY, n)) else (n, 0) for n in arrays]
    return sorted({v for v, _ in parts}), sorted({d for _, d in parts})


def long_hours(docs: DataFrame, *fields: str) -> DataFrame:
    """place, `fields`, variable, lead_day, time, value: a row for each hour of each array that a document has.

    Arrays that are longer or shorter than `time` are unfolded to the shorter of both.
    """
    place = [F.try_variant_get("doc", _at(n), "double").alias(n) for n in PLACE]
    plain = [F.try_variant_get("doc", _at(n), "string").alias(n) for n in fields]
    base = docs.select(*place, *plain, F.try_variant_get("doc", _at("hourly"), "variant").alias("_h"), _array("hourly", "time", kind="string").alias("_times"))
    spark = docs.sparkSession
    each = base.lateralJoin(spark.tvf.variant_explode(F.col("_h").outer())).where(F.col("key") != "time")
    values = F.try_variant_get("value", "$", "array<double>")
    size = F.least(F.size("_times"), F.size(values))
    day = F.regexp_extract("key", LEAD_DAY, 2)
    named = each.where(size > 0).select(
        *PLACE,
        *fields,
        F.when(day != "", F.regexp_extract("key", LEAD_DAY, 1)).otherwise(F.col("key")).alias("variable"),
        F.when(day != "", day.cast("int")).otherwise(F.lit(0)).alias("lead_day"),
        F.slice("_times", F.lit(1), size).alias("time"),
        F.slice(values, F.lit(1), size).alias("value"),
    )
    pairs = F.arrays_zip("time", "value")
    rows = named.select(*PLACE, *fields, "variable", "lead_day", F.explode(pairs).alias("_p"))
    return rows.select(*PLACE, *fields, "variable", "lead_day", F.to_timestamp("_p.time").alias("time"), F.col("_p.value").alias("value"))
