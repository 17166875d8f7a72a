"""Helpers the operators of this subpackage share: folds, words, batches and stored intermediates."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

# Upper-case ASCII letters to lower case, everything else as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

# Texts of one batch are worked on in slices of about this many bytes, so that
# a worker's memory follows one long text, not ten thousand of them.
SLICE_BYTES = 8_000_000

# Bits that mark ids: 2 MB in blocks of 4 KB, and more than the ids of 30 GB of labelled texts.
ID_BITS = 1 << 24

# Bounds of an Arrow batch: rows, and bytes for long texts and sets.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def bounded_batches(df: DataFrame) -> None:
    """Sets the bounds for the session: Spark reads them when the plan runs, not when it is made."""
    for key, value in BATCHES.items():
        df.sparkSession.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(parts))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read back, so that nothing above runs again."""
    return materialize(df, f"llm-{name}")


def marked(rows: DataFrame, ids: DataFrame, name: str, *seed: int) -> DataFrame:
    """`rows` with `_marked`: true for every row whose doc_id is one of `ids`, and for few others (a null id is not).

    The hashes of the ids are marked in `ID_BITS` bits, a table of fixed size that Spark can send
    to every task, however many ids there are.
    """
    place = lambda: F.pmod(F.xxhash64(F.col("doc_id").cast("bigint"), *map(F.lit, seed)), F.lit(ID_BITS))
    places = ids.where("doc_id IS NOT NULL").select(place().alias("_place")).distinct()
    bits = places.groupBy(F.bitmap_bucket_number("_place").alias("_block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    bits = stored(bits, name)
    placed = rows.withColumn("_place", place()).withColumn("_block", F.bitmap_bucket_number("_place"))
    at = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.col("doc_id").isNotNull() & F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return placed.join(F.broadcast(bits), "_block", "left").select(*rows.columns, found.alias("_marked"))


def possible(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id may be one of `ids`, which a join on doc_id confirms: all that are, few others.

    So texts that the join would drop are not shuffled for it.
    """
    return marked(docs, ids, "id-bits").where("_marked").drop("_marked")


def settled(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of `docs` that are for certain the only one of their doc_id, which is one of `ids` (distinct), and all others.

    The ids of rows that are not so, because they repeat or are not in `ids`, are found without
    the texts and marked. So a row that is not marked needs no join, and its text is not shuffled.
    """
    counted = docs.groupBy("doc_id").agg(F.count("*").alias("_n"))
    unsure = counted.where("_n > 1").select("doc_id").union(counted.join(ids, "doc_id", "left_anti").select("doc_id"))
    # Another hash than that of `possible`, with which what it let through by chance shares a bit with one of `ids`.
    rows = marked(docs.where("doc_id IS NOT NULL"), unsure, "unsure-bits", 2)
    return rows.where("NOT _marked").drop("_marked"), rows.where("_marked").drop("_marked")


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[dict]], schema: str) -> DataFrame:
    """`function` over small Arrow batches; it yields column dictionaries for `schema`.

    Rows and bytes of a batch are bounded through the session, as a batch of long texts must fit a worker.
    """
    bounded_batches(df)
    target = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in function(batch):
                yield pa.RecordBatch.from_arrays([to_arrow(columns[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def partition_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str) -> DataFrame:
    """Like `arrow_map`, with all batches of a partition in one call, for sums over a partition."""
    bounded_batches(df)
    target = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in function(batches):
            yield pa.RecordBatch.from_arrays([to_arrow(columns[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def arrow_filter(df: DataFrame, keep: Callable[[list[str | None]], np.ndarray]) -> DataFrame:
    """The rows of `df`, with all their columns, for whose texts `keep` says so."""
    bounded_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            masks = [keep(texts[a:b]) for a, b in slices(texts)]
            if masks:
                yield batch.filter(pa.array(np.concatenate(masks).astype(bool)))

    return df.mapInArrow(run, df.schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def to_arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    if isinstance(values, np.ndarray) and values.dtype != object:
        return pa.array(values).cast(kind)
    return pa.array(values, kind)


def slices(texts: list[str | None], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of about `most` characters; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or "") + 16
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def binary_offsets(values: pa.Array) -> np.ndarray:
    """Where each value of a text or binary array starts in its bytes, and where the last one ends."""
    return np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset) if len(values) else np.zeros(1, np.int32)


class Words:
    """The words of several texts as codes into a vocabulary of distinct words.

    Words are runs without white space (space and 0x09-0x0D); `codes` has the
    words of all texts in order, `counts` the number per text.
    """

    def __init__(self, texts: list[str | None], lower: bool = False):
        raw = pa.array([(t or "").encode("utf-8", "surrogatepass") for t in texts], pa.binary()).view(pa.string())
        lists = pc.ascii_split_whitespace(pc.ascii_lower(raw) if lower else raw)
        flat, offsets = lists.flatten(), lists.offsets.to_numpy()
        # White space at either end splits off an empty word.
        full = np.diff(binary_offsets(flat)) > 0
        self.counts = np.diff(np.concatenate([[0], np.cumsum(full)])[offsets])
        encoded = flat.filter(pa.array(full)).view(pa.binary()).dictionary_encode()
        self.codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        found, ends = encoded.dictionary, binary_offsets(encoded.dictionary).tolist()
        held = found.buffers()[2].to_pybytes() if len(found) else b""
        self.vocabulary: list[bytes] = [held[a:b] for a, b in itertools.pairwise(ends)]
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts

    def owner(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes: every input bit changes every output bit."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h
