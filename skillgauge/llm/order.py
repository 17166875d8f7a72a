"""Exact ranks of all rows in one global order, from a range-partitioned sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# monotonically_increasing_id: number of the partition above, place in it below.
PLACE_BITS = 33
# Working columns, named so that no column of a caller clashes.
PLACE, PART, BEFORE = "_rank_place", "_rank_part", "_rank_before"


def ranked(df: DataFrame, *order: str, rank: str = "rank", name: str = "ranked") -> DataFrame:
    """`df` with the place of each row in the ascending order of the columns `order`, from 0, nulls first.

    Rows are dealt by ranges of the order and sorted inside them, so no task holds
    more than its range; sums over the ranges' sizes (a row for each partition)
    make places global. Rows equal in all of `order` get neighbouring ranks.
    The places are written once, so every reader sees the same.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(spread.withColumn(PLACE, F.monotonically_increasing_id()), name)
    part = F.shiftright(F.col(PLACE), PLACE_BITS)
    sizes = placed.groupBy(part.alias(PART)).agg(F.count("*").alias("n"))
    before = sizes.select(PART, (F.sum("n").over(Window.orderBy(PART)) - F.col("n")).alias(BEFORE))
    at = F.col(BEFORE) + F.col(PLACE).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return placed.withColumn(PART, part).join(before, PART).withColumn(rank, at).drop(PLACE, PART, BEFORE)
