"""Language-model scores of texts: a unigram baseline and a causal self-attention model.

Counts of words cover all training documents. The attention model works on the
subword ids of lower-case words; it learns from consecutive windows that hold
every subword of every training document. Shards of windows are trained apart,
and the weights are averaged after each round.

Words that are frequent are counted in the tasks themselves; all others meet
their counts in a join, and as none of them is frequent, no join key is hot.
"""

from __future__ import annotations

import base64
import functools
import itertools
import math
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention
from .common import Words, arrow_map, partition_map, slices, stored

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# A word is broadcast with its count if it is more than this share of all
# tokens; there are at most 1 / HOT_SHARE of those.
HOT_SHARE = 5e-6
ROUNDS = 3
SLOT = 4096
# Windows in a training shard at least.
SHARD_WINDOWS = 4096
END = b""

SCORED = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_hot bigint, base_hot double, score double, "
    "rare array<struct<word:binary,n:int>>"
)


@functools.lru_cache(maxsize=2)
def encoder(ranks: bytes):
    """Byte-pair encoder of the vocabulary's first merges, which are a smaller vocabulary of the same kind."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    few = {k: v for k, v in table.items() if v < attention.END}
    return tiktoken.Encoding("subwords", pat_str=r"[\s\S]+", mergeable_ranks=few, special_tokens={}), {}


KNOWN_WORDS = 500_000


def subwords(words: list[bytes], ranks: bytes) -> list[array]:
    """Ids of each word with a space before it; a worker remembers a bounded number of words."""
    coder, known = encoder(ranks)
    if len(known) > KNOWN_WORDS:
        known.clear()
    out = list(map(known.get, words))
    for i in [i for i, ids in enumerate(out) if ids is None] if None in out else ():
        word = words[i]
        out[i] = known[word] = array("h", coder._encode_single_piece(b" " + word) if len(word) <= 64 else long_word(word, coder))
    return out


def long_word(word: bytes, coder) -> list[int]:
    """Merging takes long on long words: they are cut into pieces."""
    return [i for a in range(0, len(word), 64) for i in coder._encode_single_piece((b" " if a == 0 else b"") + word[a : a + 64])]


def with_ends(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of all texts, each text with its end (the code after the last word's), and their number in each text."""
    codes = np.full(len(words.codes) + len(words.counts), len(words.vocabulary))
    codes[np.arange(len(words.codes)) + words.owner()] = words.codes
    return codes, words.counts + 1


def subword_stream(words: Words, ranks: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subword ids of all texts one after the other, END behind each text; where each text starts, and its number of ids."""
    codes, counts = with_ends(words)
    ids = [*subwords(words.vocabulary, ranks), array("h", [attention.END])]
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    # The ids of a word are taken as one value of bytes.
    offsets = pa.array(np.concatenate([[0], np.cumsum(2 * sizes)]), pa.int64())
    taken = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, offsets.buffers()[1], pa.py_buffer(b"".join(ids))]).take(pa.array(codes))
    each = sizes[codes]
    ends = np.cumsum(each)
    stream = np.frombuffer(taken.buffers()[2], np.int16, int(ends[-1]) if len(ends) else 0)
    # Each text has a word at least: its end.
    starts = np.cumsum(counts) - counts
    return stream, (ends - each)[starts], np.add.reduceat(each, starts)


@dataclass(frozen=True)
class Model:
    """Bounded: weights of a fixed shape, and the words above HOT_SHARE."""

    weights: attention.Weights
    ranks: bytes
    hot: dict[bytes, int]
    tokens: int
    distinct: int


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all documents; the end of each text is counted as the empty word."""

    def count(batches):
        held: list[pa.Table] = []
        ends = size = 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ends += len(texts)
            for a, b in slices(texts):
                words = Words(texts[a:b], lower=True)
                n = np.bincount(words.codes, minlength=len(words.vocabulary))
                held.append(pa.table({"word": pa.array(words.vocabulary, pa.binary()), "n": n}))
                size += len(n)
                if size > 1_000_000:
                    yield from flush(held)
                    held, size = [], 0
        held.append(pa.table({"word": pa.array([END], pa.binary()), "n": np.array([ends])}))
        yield from flush(held)

    def flush(held):
        if held:
            summed = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).combine_chunks()
            yield {"word": summed.column("word").combine_chunks(), "n": summed.column("n_sum").combine_chunks()}

    partial = partition_map(docs.select("text"), count, "word binary, n bigint")
    return stored(partial.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "word-counts")


def training_windows(docs: DataFrame, ranks: bytes) -> DataFrame:
    """Consecutive windows over all subword ids of every document: ids (inputs and targets are neighbours in it) and a hash for dealing.

    The id before a window is its first input: END where the text starts. Each
    id, and the END behind a text, is a target in exactly one window.
    """

    def run(batch):
        numbers, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for a, b in slices(texts, 2_000_000):
            stream, starts, sizes = subword_stream(Words(texts[a:b], lower=True), ranks)
            per = -(-sizes // attention.WINDOW)
            owner = np.repeat(np.arange(len(sizes)), per)
            first = (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)) * attention.WINDOW
            lengths = np.minimum(attention.WINDOW, sizes[owner] - first) + 1
            # The id before a text's first is the END behind the text before.
            rows = attention.window_rows(stream, starts[owner] + first)
            values = rows[np.arange(attention.WINDOW + 1) < lengths[:, None]]
            keys = []
            for number, text, n in zip(numbers[a:b], texts[a:b], per.tolist(), strict=True):
                whole = xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"))
                # The id keeps the copies of one text from meeting in one shard.
                keys += [xxhash.xxh64_intdigest(f"{whole} {number} {w}") >> 1 for w in range(n)]
            yield {"ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values)), "key": np.array(keys, np.int64)}

    return stored(arrow_map(docs.select("doc_id", "text"), run, "ids array<smallint>, key bigint"), "windows")


def window_arrays(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and what is there of both (windows x WINDOW)."""
    starts = lists.offsets.to_numpy()
    inside = np.arange(attention.WINDOW) < (np.diff(starts) - 1)[:, None]
    values = np.concatenate([lists.values.to_numpy(), np.zeros(attention.WINDOW + 1, np.int16)])
    rows = np.lib.stride_tricks.sliding_window_view(values, attention.WINDOW + 1)[starts[:-1]]
    return np.where(inside, rows[:, :-1], np.int16(attention.END)), np.where(inside, rows[:, 1:], np.int16(0)), inside


def id_counts(windows: DataFrame) -> np.ndarray:
    """How often each id stands in the windows."""

    def count(batches):
        n = np.zeros(attention.IDS, np.int64)
        for batch in batches:
            n += np.bincount(batch.column("ids").flatten().to_numpy(), minlength=attention.IDS)
        yield {"id": np.arange(attention.IDS), "n": n}

    counted = partition_map(windows.select("ids"), count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(attention.IDS)
    for row in counted:
        counts[row["id"]] = row["n"]
    return counts


def by_shard(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.ListArray]]:
    """The windows of each shard, from batches in the order of shards."""
    shard, held = None, []
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, b in itertools.pairwise(edges):
            if a == b:
                continue
            if held and shards[a] != shard:
                yield shard, pa.concat_arrays(held)
                held = []
            shard = int(shards[a])
            held.append(batch.column("ids").slice(a, b - a))
    if held:
        yield shard, pa.concat_arrays(held)


def train(windows: DataFrame, rounds: int = ROUNDS) -> attention.Weights:
    """Weights of the model: in each round every shard trains on its part of the windows, then weights are averaged.

    A window is used in one round, each at its hash. Shards grow in number with
    the windows, so averages are taken in two steps. Only averaged weights, of a
    fixed number, get to the driver.
    """
    spark = windows.sparkSession
    weights = attention.initial(id_counts(windows))
    total = windows.count()
    shards = max(1, total // (SHARD_WINDOWS * rounds))
    parts = math.isqrt(shards)
    dealt = windows.withColumn("round", F.pmod(F.col("key"), F.lit(rounds))).withColumn("shard", F.pmod(F.xxhash64("key", "ids"), F.lit(shards)))
    for number in range(rounds):
        held = spark.sparkContext.broadcast(attention.flat(weights))

        def learn(batches):
            start = attention.unflat(held.value)  # noqa: B023
            mean, n, part = np.zeros(attention.SIZE), 0, 0
            for shard, lists in by_shard(batches):
                n += len(lists)
                mean += (attention.flat(attention.train(start, *window_arrays(lists))) - mean) * (len(lists) / n)
                part = shard % parts
            if n:
                slots = range(0, len(mean), SLOT)
                yield {"slot": [a // SLOT for a in slots], "part": [part] * len(slots), "n": [n] * len(slots), "v": [mean[a : a + SLOT] for a in slots]}

        def average(frame: pd.DataFrame) -> pd.DataFrame:
            mean = np.average(np.array(frame["v"].tolist()), axis=0, weights=frame["n"].to_numpy(float))
            return pd.DataFrame({"slot": [int(frame["slot"].iloc[0])], "n": [int(frame["n"].sum())], "v": [mean.tolist()]})

        mine = dealt.where(F.col("round") == number).select("shard", "key", "ids").repartition("shard").sortWithinPartitions("shard", "key")
        trained = partition_map(mine.select("shard", "ids"), learn, "slot int, part int, n bigint, v array<double>")
        some = trained.groupBy("slot", "part").applyInPandas(average, "slot int, n bigint, v array<double>")
        rows = some.groupBy("slot").applyInPandas(average, "slot int, n bigint, v array<double>").collect()
        if rows:
            weights = attention.unflat(np.concatenate([r["v"] for r in sorted(rows, key=lambda r: r["slot"])]))
    return weights


def fit(docs: DataFrame, ranks_path: str = RANKS) -> tuple[Model, DataFrame]:
    """The model of all of `docs`, and the table of word counts."""
    with open(ranks_path, "rb") as f:
        lines = f.read().splitlines()
    few = b"\n".join(line for line in lines if int(line.split()[1]) < attention.END)
    counts = word_counts(docs)
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = sums["n"] or 0, sums["v"]
    hot = {bytes(r["word"]): r["n"] for r in counts.where(F.col("n") > HOT_SHARE * tokens).collect()}
    weights = train(training_windows(docs, few))
    return Model(weights, few, hot, tokens, distinct), counts


def score_texts(texts: list[str | None], model: Model) -> dict:
    words = Words(texts, lower=True)
    vocabulary = [*words.vocabulary, END]
    # Words of all texts, each text with its end.
    codes, counts = with_ends(words)
    owner = np.repeat(np.arange(len(texts)), counts)

    hot = np.fromiter(map(model.hot.get, vocabulary, itertools.repeat(-1)), np.int64, len(vocabulary))
    divisor = model.tokens + model.distinct + 1
    known = hot[codes] >= 0
    logs = np.log10((np.maximum(hot, 0) + 1) / divisor)
    base = np.bincount(owner[known], weights=logs[codes[known]], minlength=len(texts))
    n_hot = np.bincount(owner[known], minlength=len(texts))
    pairs, often = np.unique(owner[~known] * len(vocabulary) + codes[~known], return_counts=True)
    rare = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(np.bincount(pairs // len(vocabulary), minlength=len(texts)))]), pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array(vocabulary, pa.binary()).take(pa.array(pairs % len(vocabulary))), pa.array(often, pa.int32())], names=["word", "n"]
        ),
    )
    stream, starts, sizes = subword_stream(words, model.ranks)
    return {
        "n_tokens": counts,
        "n_hot": n_hot,
        "base_hot": base,
        "score": attention.score(model.weights, stream, starts, sizes),
        "rare": rare,
    }


def score(docs: DataFrame, learn: Column, ranks_path: str = RANKS) -> DataFrame:
    """One row per document: tokens, known tokens, training tokens, unigram score and the model's score.

    `learn` says which documents the model may learn from. A null text counts as
    empty: one token, its end. Repeated rows are scored each for itself; without
    training documents all words are unknown.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model, counts = fit(docs.where(learn), ranks_path)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        ids, out, texts = batch.column("doc_id"), batch.column("held_out"), batch.column("text").to_pylist()
        for a, b in slices(texts, 2_000_000):
            yield {"doc_id": ids.slice(a, b - a), "held_out": out.slice(a, b - a)} | score_texts(texts[a:b], held.value)

    scored = arrow_map(docs.select("doc_id", (~learn).alias("held_out"), "text"), run, SCORED)
    # Row numbers are written with the rows, so that they stay the same for the join below.
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("x")).select("row", F.col("x.word").alias("word"), F.col("x.n").alias("times"))
    # The counts of a partition fit a table, so the words of the texts need no sort.
    met = rare.join(counts.hint("shuffle_hash"), "word", "left")
    divisor = float(model.tokens + model.distinct + 1)
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_rare"),
        F.sum(F.col("times") * F.log10((F.coalesce(F.col("n"), F.lit(0)) + 1) / F.lit(divisor))).alias("base_rare"),
    )
    return scored.drop("rare").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base_hot") + F.coalesce("base_rare", F.lit(0.0))).alias("base_score"),
        "score",
    )
