"""Best-fit packing of documents into sequences of several permitted lengths.

Documents become items: pieces of at most the longest permitted length. Items
are dealt to shards of a bounded number by a hash, and each shard is packed for
itself: items in falling order of length go to the open bin with the least room
that still holds them. If none does, a new bin is opened in the size whose cost
per filled place is least, judged by filling it ahead with what is left. Last,
every bin is cut down to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lengths count UTF-8 bytes, the tokens of a byte-level model, with one end mark per document.
CAPACITIES = (2048, 4096, 8192, 16384)
# What a sequence costs besides its places, in places.
OVERHEAD = 64
SHARD_ITEMS = 4096

PLACED = "doc_id bigint, piece bigint, start bigint, length bigint, bin_id string, capacity bigint, filled bigint, offset bigint"


def items(docs: DataFrame, length: Column, longest: int) -> DataFrame:
    """Pieces of at most `longest` places: doc_id, piece, start, length. Documents without places have none."""
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), length.cast("bigint").alias("places")).where("places > 0")
    return (
        sized.select("doc_id", "places", F.explode(F.sequence(F.lit(0), F.expr(f"(places - 1) div {longest}"))).alias("piece"))
        .withColumn("start", F.col("piece") * longest)
        .select("doc_id", F.col("piece").cast("bigint").alias("piece"), "start", F.least(F.lit(longest), F.col("places") - F.col("start")).alias("length"))
    )


def ahead(left: list[int], first: int, capacity: int) -> int:
    """Places filled in a bin of `capacity` that starts with `first` and takes the largest of `left` (rising) that fit."""
    room, filled, top = capacity - first, first, len(left)
    while (at := bisect_right(left, room, 0, top) - 1) >= 0:
        room -= left[at]
        filled += left[at]
        top = at
    return filled


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin of each item (in the order given, which falls), and per bin its final capacity and its filled places.

    Of bins with equal room the one opened last takes the item; of sizes with
    equal cost the smaller is opened.
    """
    sizes = sorted(capacities)
    left = sorted(lengths)
    open_bins: list[tuple[int, int]] = []  # (room, bin), rising
    chosen: list[int] = []
    filled: list[int] = []
    of_item: list[int] = []
    for n in lengths:
        left.pop(bisect_left(left, n))
        at = bisect_left(open_bins, (n, -1))
        if at < len(open_bins):
            room, bin_ = open_bins.pop(at)
        else:
            cost = [((c + overhead) / ahead(left, n, c), c) for c in sizes if c >= n]
            room, bin_ = min(cost)[1], len(chosen)
            chosen.append(room)
            filled.append(0)
        of_item.append(bin_)
        filled[bin_] += n
        if room > n:
            insort(open_bins, (room - n, bin_))
    return of_item, [sizes[bisect_left(sizes, f)] for f in filled], filled


def packed(
    docs: DataFrame,
    length: Column | None = None,
    capacities: Sequence[int] = CAPACITIES,
    overhead: int = OVERHEAD,
    shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """Where every piece of every document goes: bin, its capacity and filled places, and the offset in it.

    `length` is the number of places of a row; by default the bytes of its text
    and one end mark. A null text has length 0 and is in no bin; an empty text has
    its end mark only. Longer documents than the largest capacity are cut into
    pieces, of which none is lost. Repeated rows are packed each for itself.
    """
    if length is None:
        length = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.octet_length("text") + 1)
    pieces = items(docs, length, max(capacities))
    count = pieces.count()
    if not count:
        return docs.sparkSession.createDataFrame([], PLACED)
    shards = -(-count // shard_items)

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        of_item, capacity, filled = pack(frame["length"].tolist(), capacities, overhead)
        bins = np.array(of_item)
        before = frame["length"].groupby(bins).cumsum() - frame["length"]
        shard = int(frame["shard"].iloc[0])
        return pd.DataFrame(
            {
                "doc_id": frame["doc_id"].astype("Int64"),
                "piece": frame["piece"],
                "start": frame["start"],
                "length": frame["length"],
                "bin_id": [f"{shard}-{b}" for b in of_item],
                "capacity": np.array(capacity)[bins],
                "filled": np.array(filled)[bins],
                "offset": before,
            }
        )

    # The length is hashed too, so that rows without an id spread over the shards.
    shard = F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(shards))
    return pieces.withColumn("shard", shard).groupBy("shard").applyInPandas(fill, PLACED)


def sequences(docs: DataFrame, placed: DataFrame, end: int = 0) -> DataFrame:
    """The packed sequences themselves: bin_id, capacity and the bytes, filled up with `end` bytes.

    Needs ids that occur once. A bin's contents are at most its capacity, so
    gathering them in one row is bounded.
    """
    text = docs.select("doc_id", F.concat(F.encode("text", "utf-8"), F.lit(bytes([end]))).alias("bytes"))
    parts = placed.join(text, "doc_id").select(
        "bin_id", "capacity", "offset", F.expr("substring(bytes, CAST(start + 1 AS INT), CAST(length AS INT))").alias("part")
    )
    joined = parts.groupBy("bin_id", "capacity").agg(F.array_sort(F.collect_list(F.struct("offset", "part"))).alias("parts"))
    body = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["part"]))
    return joined.select("bin_id", "capacity", F.rpad(body, F.col("capacity").cast("int"), F.lit(bytes([end]))).alias("sequence"))
